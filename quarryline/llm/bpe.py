"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

The vocabulary file fixes the merges. In each pre-token an Aho-Corasick automaton over all token
byte strings gives the longest token that starts at every byte. The encoder walks on with these
and backs up to the next shorter token where two neighbours could not stand side by side in the
result of the merges; a table of pairs, filled as pairs occur, remembers which can. Since every
prefix of a valid result is the result for that prefix, the walk ends with the exact merges, and
each byte position is given up once at most.
"""

from __future__ import annotations

import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_ranges, once, rows

#: Fixed value: how byte-level vocabularies of this family cut a text before the merges. The
#: classes L (letters), N (numbers) and S (white space) are written out by pre_token_pattern().
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
#: Pre-tokens that a task remembers before it starts over.
CACHE = 600_000
#: Pairs of tokens of which a task remembers whether they fit.
PAIRS = 2_000_000


#: Below this code point the classes are short lists, with which re is four times as fast.
NARROW = 0x250


def pre_token_pattern(limit: int = 0x110000) -> str:
    """PRE_TOKENS with explicit ranges, for texts of code points under limit. Python's own re has no
    Unicode classes but is faster than the module that has them, whose tables are not the libraries' either."""
    ranges = {k: class_ranges(cls, limit) for k, cls in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}
    return re.sub(r"\[\^?[SLN]+\]", lambda m: re.sub("[SLN]", lambda k: ranges[k[0]], m[0]), PRE_TOKENS)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabulary files write bytes: printable Latin-1 characters
    stand for themselves, the other bytes follow in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables for encoding and decoding, from a tokenizer file with byte-level merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token = [b""] * size
        for t, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in t)
        #: A merged token's two parts; a single byte is its own part. rank: place among the merges.
        self.parts = {i: (i, i) for t, i in vocab.items() if len(t) == 1}
        self.rank = dict.fromkeys(self.parts, -1)
        self.merged: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.merged.setdefault(pair, whole)
            self.parts.setdefault(whole, pair)
            self.rank.setdefault(whole, k)
        known = {self.token[i]: i for i in self.parts}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        for b, i in known.items():
            self.automaton.add_word(b.decode("latin-1"), i)
            self.shorter[i] = next((known[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in known), -1)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        for t, i in self.added.items():
            self.token[i] = t.encode()
        self.length = [len(t) for t in self.token]
        self.table = np.frombuffer(b"".join(self.token), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges of the joint bytes of tokens a and b leave just a and b.

        Undo merges from the last on. A merge across the border would have come first if the
        tokens that then met at the border have a merge of their own that precedes the next one
        to be undone."""
        found = self.fits.get((a, b))
        if found is None:
            found, left, right, until = True, a, b, 1 << 60
            while True:
                joint = self.merged.get((left, right))
                if joint is not None and self.rank[joint] < until:
                    found = False
                    break
                if self.rank[left] < 0 and self.rank[right] < 0:
                    break
                # Of equal merges the left one is applied first, so the right one is undone first
                # and a joint merge of equal rank would only lose against the left.
                if self.rank[left] > self.rank[right]:
                    until = self.rank[left]
                    left = self.parts[left][1]
                else:
                    until = self.rank[right] + 1
                    right = self.parts[right][0]
            if len(self.fits) > PAIRS:
                self.fits.clear()
            self.fits[a, b] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        text = piece.decode("latin-1")
        # Where the leftmost longest matches go together, the walk below would not back up.
        out = [i for _, i in self.automaton.iter_long(text)]
        fits = self.fits
        for pair in zip(out, out[1:], strict=False):
            if not (fits[pair] if pair in fits else self.compatible(*pair)):
                break
        else:
            return out
        n = len(piece)
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(text):
            start = end + 1 - self.length[i]
            # Matches come by their ends, so a later one is longer.
            longest[start] = i
        dead = bytearray(n + 1)
        out = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + self.length[token]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token < 0:
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
            else:
                out.append(token)
                at = end
                token = longest[at]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Copy each token's bytes from the table by its offsets."""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(start - (ends - size), size)
        return self.table[at].tobytes().decode("utf-8", "replace")


class Encoder:
    """Encodes texts with a bounded memory of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary, patterns: list[str]):
        self.vocabulary = vocabulary
        self.narrow, self.wide = (re.compile(p).findall for p in patterns)
        self.beyond = re.compile(f"[^\0-{chr(NARROW - 1)}]").search
        special = "|".join(map(re.escape, sorted(vocabulary.added, key=len, reverse=True)))
        self.special = re.compile(f"({special})") if special else None
        self.seen: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        pieces = self.wide(text) if self.beyond(text) else self.narrow(text)
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        try:
            return b"".join(map(seen.__getitem__, pieces))
        except KeyError:
            for p in pieces:
                if p not in seen:
                    seen[p] = array("i", self.vocabulary.encode_piece(p.encode())).tobytes()
            return b"".join(map(seen.__getitem__, pieces))

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.special is None or not self.special.search(text):
            return np.frombuffer(self.plain(text), "<i4")
        added = self.vocabulary.added
        return np.frombuffer(b"".join(
            np.array([added[p]], "<i4").tobytes() if p in added else self.plain(p) for p in self.special.split(text)), "<i4")


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def encode(documents: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids (array of int) for each row of documents (doc_id, text); with decoded, also
    decoded, the text made from the ids. path: the vocabulary file, readable on every machine.

    A null or empty text has no ids. A special token's string in a text is that token. Texts are
    taken whole; nulls in doc_id and repeated rows pass through, other columns are ignored, and an
    empty table gives an empty result.
    """
    patterns = [pre_token_pattern(NARROW), pre_token_pattern()]

    def each(batches):
        vocabulary = once(Vocabulary, path)
        encoder = Encoder(vocabulary, patterns)
        for d in rows(batches, 250):
            ids = [encoder(t) for t in d["text"]]
            out = [pa.array(d["doc_id"], pa.int64()), _lists(ids)]
            if decoded:
                out.append(pa.array([vocabulary.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "decoded"][: len(out)])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(each, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded for each row of tokens (doc_id, ids); null ids decode to an empty text."""
    def each(batches):
        vocabulary = once(Vocabulary, path)
        for d in rows(batches, 250):
            texts = [vocabulary.decode(np.array(i or [], np.int64)) for i in d["ids"]]
            yield pa.RecordBatch.from_arrays([pa.array(d["doc_id"], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(each, "doc_id long, decoded string")


def digests(documents: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of a round trip through encode and decode;
    with ids also the ids themselves."""
    both = encode(documents, path, decoded=True)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *(["ids"] if ids else []))
