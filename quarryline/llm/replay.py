"""Byte-level BPE by replaying merges over a corpus, and decoding by an offset table.

A task cuts its documents into pre-tokens and gathers blocks of them: at most ``WORDS`` distinct
pre-tokens (words) and ``PLACES`` occurrences, but never less than one document. The bytes of a
block's words lie end to end in one array; an inverted index holds, for the rank of each pair of
neighbours, the positions where such a pair stands. Ranks are then taken in ascending order, each
one is merged at all of its positions at once, and only the neighbours of merged places are looked
up and entered under their new ranks. Documents are gathered from the words' results.

One index over the words of all documents would need every pair of block and word to be shuffled
there and back, about twice the input; blocks need no shuffle and give the same ids.

Merging all positions of a rank together equals merging in each word the leftmost pair of least
rank, one at a time, unless a merge makes a pair of a rank not above its own. Words in which that
happens are noticed and done again by themselves, so the result is exact for any table of ranks.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_ranges, once, rows

#: Distinct words and occurrences after which a block is closed.
WORDS, PLACES = 400_000, 6_000_000
#: Below this code point the classes of a pattern are short lists, which re walks several times faster.
NARROW = 0x250


def explicit(pattern: str, limit: int = 0x110000) -> str:
    r"""pattern with the classes \p{L}, \p{N}, \s and \S written out as ranges of code points under
    limit, for Python's own re, which lacks two of them and has another idea of the third."""
    ranges = {cls: class_ranges(cls, limit) for cls in (r"\p{L}", r"\p{N}", r"\s")}

    def written(m: re.Match) -> str:
        if m[0].startswith("["):
            return re.sub(r"\\p\{[LN]\}|\\s", lambda k: ranges[k[0]], m[0])
        return f"[^{ranges[chr(92) + 's']}]" if m[0] == r"\S" else f"[{ranges[m[0]]}]"

    return re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\[sS]", written, pattern)


class Ranks:
    """The table of ranks: a token's rank is its id, and two neighbours may merge if their joint
    bytes have a rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, f))}
        size = max(self.rank.values()) + 1
        self.none = size  # no token; stands behind the last byte of a word
        self.token = [b""] * size
        for t, r in self.rank.items():
            self.token[r] = t
        self.byte = np.full(256, size, np.int64)
        for b in range(256):
            self.byte[b] = self.rank.get(bytes([b]), size)
        found = sorted((self.rank[t[:k]] * (size + 1) + self.rank[t[k:]], r) for t, r in self.rank.items()
                       for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank)
        self.key = np.array([k for k, _ in found] or [-1], np.int64)
        self.joint = np.array([r for _, r in found] or [-1], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.token])]).astype(np.int64)
        self.table = np.frombuffer(b"".join(self.token), np.uint8)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of neighbours' joint bytes, -1 where they have none."""
        key = left * (self.none + 1) + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.joint[at], -1)

    def alone(self, word: bytes) -> list[int]:
        """The ids of one word: the leftmost pair of least rank is merged until none has a rank."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            least, i = min((self.rank.get(parts[i] + parts[i + 1], self.none), i) for i in range(len(parts) - 1))
            if least == self.none:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, copied from the table by their offsets."""
        return self.table[_runs(self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids])].tobytes()


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Positions:
    """The inverted index: for each rank the positions at which a pair of that rank was seen."""

    def __init__(self, size: int):
        self.at: list[list[np.ndarray]] = [[] for _ in range(size)]

    def enter(self, position: np.ndarray, rank: np.ndarray) -> None:
        order = np.argsort(rank, kind="stable")
        position, rank = position[order], rank[order]
        starts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist()]
        for r, a, b in zip(rank[starts].tolist(), starts, [*starts[1:], len(rank)], strict=True):
            self.at[r].append(position[a:b])

    def take(self, rank: int) -> np.ndarray:
        """The positions of a rank in ascending order; they may be out of date."""
        found, self.at[rank] = self.at[rank], []
        return np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in turn, end of each word's ids), by applying every merge in rank order."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(words) else 0
    sym = np.append(ranks.byte[np.frombuffer(b"".join(words), np.uint8)], ranks.none)
    if n and int(sym[:n].max()) == ranks.none:
        raise ValueError("the table of ranks lacks a byte")
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends[sizes > 0] - 1] = n
    before[(ends - sizes)[sizes > 0]] = n
    pair = ranks.pairs(sym[:n], sym[after[:n]])
    pair = np.append(pair, -1)
    redo = np.zeros(len(words), bool)  # words whose result comes by itself
    whole = np.fromiter((ranks.rank.get(w, -1) for w in words), np.int64, len(words))
    pair[:n][np.repeat(whole >= 0, sizes)] = -1  # a word that is a token needs no merges

    index = Positions(ranks.none)
    first = np.flatnonzero(pair >= 0)
    if len(first):
        index.enter(first, pair[first])
    for r in range(ranks.none):
        if not index.at[r]:
            continue
        left = index.take(r)
        left = left[pair[left] == r]
        if not len(left):
            continue
        # Of overlapping pairs the first, third, ... of a run are merged.
        joined = np.append(False, after[left[:-1]] == left[1:])
        if joined.any():
            place = np.arange(len(left))
            start = np.maximum.accumulate(np.where(joined, 0, place))
            left = left[(place - start) % 2 == 0]
        right = after[left]
        beyond, own = after[right], sym[left]
        sym[left], sym[right], pair[right] = r, -1, -1
        after[left] = beyond
        before[beyond] = left
        ahead = before[left]
        # Between two merges side by side the pair of the merged token and the next one's left part stood for a moment.
        passing = left[sym[ahead] == r]
        if len(passing):
            brief = ranks.pairs(np.full(len(passing), r), own[sym[ahead] == r])
            passing = passing[(brief >= 0) & (brief <= r)]
        touched = np.unique(np.concatenate([left, ahead[ahead < n]]))
        now = ranks.pairs(sym[touched], sym[after[touched]])
        pair[touched] = now
        early = np.concatenate([touched[(now >= 0) & (now <= r)], passing])
        if len(early):
            for w in set(np.searchsorted(ends, early, "right").tolist()):
                redo[w] = True
                pair[ends[w] - sizes[w] : ends[w]] = -1
            now = pair[touched]
        if (now >= 0).any():
            index.enter(touched[now >= 0], now[now >= 0])

    alive = sym[:n] >= 0
    counts = np.add.reduceat(np.append(alive, False).astype(np.int64), np.minimum(ends - sizes, n)) * (sizes > 0) if len(words) else ends
    special = {w: [int(whole[w])] for w in np.flatnonzero(whole >= 0).tolist()}
    special |= {w: ranks.alone(words[w]) for w in np.flatnonzero(redo).tolist()}
    alive &= ~np.repeat((whole >= 0) | redo, sizes)
    for w, ids in special.items():
        counts[w] = len(ids)
    upto = np.cumsum(counts)
    out = np.empty(int(upto[-1]) if len(words) else 0, np.int64)
    plain = np.ones(len(out), bool)
    for w, ids in special.items():
        out[upto[w] - len(ids) : upto[w]] = ids
        plain[upto[w] - len(ids) : upto[w]] = False
    out[plain] = sym[:n][alive]
    return out, upto


class Block:
    """Documents on their way: for each the numbers of its words, and the words themselves."""

    def __init__(self, patterns: list[str]):
        self.narrow, self.wide = (re.compile(p).findall for p in patterns)
        self.beyond = re.compile(f"[^\0-{chr(NARROW - 1)}]").search
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.doc_ids: list[int | None] = []
        self.texts: list[np.ndarray] = []
        self.places = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        text, number = text or "", self.number
        found = (self.wide if self.beyond(text) else self.narrow)(text)
        try:
            own = array("i", map(number.__getitem__, found))
        except KeyError:
            for word in found:
                if word not in number:
                    number[word] = len(number)
            own = array("i", map(number.__getitem__, found))
        self.doc_ids.append(doc_id)
        self.texts.append(np.frombuffer(own, np.int32) if own else np.zeros(0, np.int32))
        self.places += len(own)

    @property
    def full(self) -> bool:
        return len(self.number) >= WORDS or self.places >= PLACES

    def encoded(self, ranks: Ranks):
        """(doc_id, ids) of each document; the block is empty afterwards."""
        ids, upto = replay([w.encode() for w in self.number], ranks)
        size = np.diff(upto, prepend=0)
        start, ids = upto - size, ids.astype(np.int32)
        docs = list(zip(self.doc_ids, self.texts, strict=True))
        self.clear()
        for doc_id, own in docs:
            yield doc_id, ids[_runs(start[own], size[own])]


def encode(documents: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids (array of int) for each row of documents (doc_id, text); with decoded, also
    decoded, the bytes that the ids stand for. path: a file of base64 tokens and ranks, readable on
    every machine; pattern: how a text is cut before the merges, each match by itself.

    A null or empty text has no ids; what the pattern leaves out has none either. Texts are taken
    whole and have no special tokens. Nulls in doc_id and repeated rows pass through, other columns
    are ignored, and an empty table gives an empty result.
    """
    patterns = [explicit(pattern, NARROW), explicit(pattern)]
    names = ["doc_id", "ids", "decoded"][: 2 + decoded]

    def each(batches):
        ranks = once(Ranks, path)
        block = Block(patterns)

        def results():
            held, size = [], 0
            for doc_id, ids in block.encoded(ranks):
                held.append((doc_id, ids))
                size += len(ids)
                if len(held) >= 1000 or size >= 1_000_000:
                    yield record(held)
                    held, size = [], 0
            if held:
                yield record(held)

        def record(held):
            ends = np.cumsum([0, *(len(i) for _, i in held)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *(i for _, i in held)])))
            out = [pa.array([d for d, _ in held], pa.int64()), lists]
            if decoded:
                out.append(pa.array([ranks.decode(i) for _, i in held], pa.binary()))
            return pa.RecordBatch.from_arrays(out, names)

        for d in rows(batches, 250):
            for doc_id, text in zip(d["doc_id"], d["text"], strict=True):
                block.add(doc_id, text)
                if block.full:
                    yield from results()
        yield from results()

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(each, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded (the bytes) for each row of tokens (doc_id, ids); null ids give no bytes."""
    def each(batches):
        ranks = once(Ranks, path)
        for d in rows(batches, 250):
            found = [ranks.decode(np.array(i or [], np.int64)) for i in d["ids"]]
            yield pa.RecordBatch.from_arrays([pa.array(d["doc_id"], pa.int64()), pa.array(found, pa.binary())], ["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(each, "doc_id long, decoded binary")


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of a round trip through encode and decode."""
    both = encode(documents, path, pattern, decoded=True)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
