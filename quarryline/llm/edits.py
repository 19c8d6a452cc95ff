"""Token counts that follow edits, with a segment tree over pre-tokens for each document.

A document's pre-tokens are dealt in order to leaves. The tree holds the characters and tokens
below each node, so the root has the document's count and a position is found by descent. An edit
is re-encoded from the start of the leaf that holds the second character before it, since the cut
into pre-tokens looks two characters ahead at most, up to the first old leaf border behind it that
is a border of the new cut as well: from there on the cut depends on unchanged text only. The
region goes into its first leaf, the other leaves touched become empty, and the sums on their ways
to the root are updated; a region of more than two leaves' pieces is dealt to leaves anew, and where these are
more than were touched the tree is built again from its leaves' sums, without a look at their text. Strings of special tokens are ordinary text here.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE, NARROW, Encoder, Vocabulary, pre_token_pattern
from .common import cut, once

#: Pre-tokens of a leaf.
LEAF = 32


class Counter:
    """Cuts texts and counts the tokens of pieces, with a bounded memory of pieces."""

    def __init__(self, path: str, patterns: Iterable[str]):
        self.encoder = Encoder(Vocabulary(path), list(patterns))
        self.sizes: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        e = self.encoder
        return e.wide(text) if e.beyond(text) else e.narrow(text)

    def tokens(self, pieces: list[str]) -> list[int]:
        sizes = self.sizes
        if len(sizes) > CACHE:
            sizes.clear()
        try:
            return list(map(sizes.__getitem__, pieces))
        except KeyError:
            for p in pieces:
                if p not in sizes:
                    sizes[p] = len(self.encoder.vocabulary.encode_piece(p.encode()))
            return list(map(sizes.__getitem__, pieces))


def tree(values: np.ndarray) -> np.ndarray:
    """Sums over a binary tree of values: node 1 is the root, node i has children 2i and 2i + 1."""
    size = 1
    while size < len(values):
        size *= 2
    out = np.zeros(2 * size, np.int32)
    out[size : size + len(values)] = values
    while size > 1:
        out[size // 2 : size] = out[size : 2 * size].reshape(-1, 2).sum(1)
        size //= 2
    return out


def put(sums: np.ndarray, leaf: int, value: int) -> None:
    i = len(sums) // 2 + leaf
    change = value - int(sums[i])
    while i and change:
        sums[i] += change
        i //= 2


def locate(sums: np.ndarray, position: int) -> tuple[int, int]:
    """Leaf of the character at position, and the characters before that leaf. The end of the text
    belongs to the last leaf that is not empty."""
    position = max(0, min(position, int(sums[1]) - 1))
    i, before = 1, 0
    while i < len(sums) // 2:
        i *= 2
        if position - before >= sums[i]:
            before += int(sums[i])
            i += 1
    return i - len(sums) // 2, before


def build(counter: Counter, text: str, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Trees of characters and tokens."""
    pieces = counter.pieces(text)
    n = len(pieces)
    if not n:
        return tree(np.zeros(1, np.int32)), tree(np.zeros(1, np.int32))
    at = np.arange(0, n, leaf)
    chars = np.add.reduceat(np.fromiter(map(len, pieces), np.int32, n), at)
    return tree(chars), tree(np.add.reduceat(np.array(counter.tokens(pieces), np.int32), at))


def edited(counter: Counter, text: str, chars: np.ndarray, tokens: np.ndarray, start: int, removed: int, inserted: str,
           leaf: int = LEAF) -> tuple[str, np.ndarray, np.ndarray, int]:
    """The text after one edit, both trees (updated in place unless they have grown), and the characters that
    were cut anew."""
    n = len(text)
    start = max(0, min(start, n))
    stop = max(start, min(start + removed, n))
    out = text[:start] + inserted + text[stop:]
    shift = len(out) - n
    size = len(chars) // 2
    first, begin = locate(chars, start - 2)
    last, before = locate(chars, stop)
    end = before + int(chars[size + last])
    while end < n:
        # Of a part's pieces only the last can go on in the whole text, so the others are borders.
        found = counter.pieces(out[begin : end + shift + 64])
        ends = list(accumulate(map(len, found)))
        at = bisect_left(ends, end + shift - begin)
        if at < len(ends) - 1 and ends[at] == end + shift - begin:
            pieces = found[: at + 1]
            break
        last += 1
        end += int(chars[size + last])
    else:
        pieces = counter.pieces(out[begin:])
    stop_leaf = last + 1 if end < n else size
    at = range(0, len(pieces), leaf) if len(pieces) > 2 * leaf else [0]
    new_chars = [sum(map(len, pieces[i : i + leaf] if len(at) > 1 else pieces)) for i in at]
    new_tokens = [sum(counter.tokens(pieces[i : i + leaf] if len(at) > 1 else pieces)) for i in at]
    if len(new_chars) > stop_leaf - first:
        chars, tokens = (_grown(old, first, stop_leaf, new) for old, new in ((chars, new_chars), (tokens, new_tokens)))
    else:
        for k in range(first, stop_leaf):
            own = k - first < len(new_chars)
            put(chars, k, new_chars[k - first] if own else 0)
            put(tokens, k, new_tokens[k - first] if own else 0)
    return out, chars, tokens, sum(new_chars)


def _grown(sums: np.ndarray, first: int, stop: int, new: list[int]) -> np.ndarray:
    """A tree with new leaves in place of those from first to stop. Every leaf that holds characters holds
    tokens, so both trees lose the same empty leaves."""
    size = len(sums) // 2
    leaves = np.concatenate([sums[size : size + first], np.array(new, np.int32), sums[size + stop :]])
    return tree(leaves[leaves > 0]) if (leaves > 0).any() else tree(np.zeros(1, np.int32))


def _named(documents: DataFrame) -> DataFrame:
    """doc_id, text and a name for both, without nulls: key and crc."""
    doc = F.col("doc_id").cast("long")
    text = F.col("text").cast("string")
    return documents.select(doc.alias("doc_id"), text.alias("text"), F.coalesce(doc, F.lit(-1)).alias("key"),
                            F.xxhash64(doc.isNull(), F.coalesce(text, F.lit(""))).alias("crc"))


def _lists(trees: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, trees)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *trees])))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays that may be written to."""
    values, at = column.flatten().to_numpy().astype(np.int32), np.cumsum([0, *column.value_lengths().to_pylist()])
    return [values[i:j] for i, j in zip(at, at[1:], strict=False)]


def _parts(batches, size: int = 250):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def trees(documents: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, key and crc (the name of doc_id and text), chars and tokens (the trees' sums) for each
    row of documents. A null text counts as an empty one."""
    patterns = (pre_token_pattern(NARROW), pre_token_pattern())

    def each(batches):
        counter = once(Counter, path, patterns)
        for part in _parts(batches):
            both = [build(counter, t or "", leaf) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "key", "crc")), *(_lists([b[i] for b in both]) for i in (0, 1))],
                ["doc_id", "key", "crc", "chars", "tokens"])

    return _named(documents).mapInArrow(each, "doc_id long, key long, crc long, chars array<int>, tokens array<int>")


def recount(documents: DataFrame, state: DataFrame, edits: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """Applies edits (doc_id, seq, start, removed, inserted) to the rows of documents by the trees in
    state (see trees()). For each row: doc_id, text and trees after the edits, tokens_before,
    tokens_after, n_edits and recut_chars (characters that were cut and encoded anew).

    Edits of a doc_id apply to each of its rows in order of seq, then start; a position is one in the
    text as the edit finds it and is moved into the text if it lies outside. Edits without doc_id
    or start are left out, a null inserted text is empty, a null removed is 0. Rows without edits
    or without doc_id stay as they are. Empty tables give no rows or no edits.

    Edits find the names of their documents first, so that texts and trees meet them by these names
    and are dealt out once.
    """
    patterns = (pre_token_pattern(NARROW), pre_token_pattern())
    script = edits.where("doc_id is not null and start is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"),
            F.coalesce(F.col("removed").cast("long"), F.lit(0)).alias("removed"), F.coalesce("inserted", F.lit("")).alias("inserted")))).alias("edits"))
    names = state.select("doc_id", "key", "crc").distinct().join(script, "doc_id").select("key", "crc", "edits")
    stored = state.select("key", "crc", "chars", "tokens").dropDuplicates(["key", "crc"])
    joined = _named(documents).join(stored, ["key", "crc"]).join(names, ["key", "crc"], "left")

    def each(batches):
        counter = once(Counter, path, patterns)
        for part in _parts(batches):
            out: dict[str, list] = {k: [] for k in ("text", "before", "after", "edits", "recut")}
            chars, tokens = _arrays(part.column("chars")), _arrays(part.column("tokens"))
            kept = []
            for text, c, t, script in zip(part.column("text").to_pylist(), chars, tokens, part.column("edits").to_pylist(), strict=True):
                before, recut = int(t[1]), 0
                for e in script or ():
                    text, c, t, n = edited(counter, text or "", c, t, e["start"], e["removed"], e["inserted"], leaf)
                    recut += n
                kept.append((c, t))
                for k, v in zip(out, (text, before, int(t[1]), len(script or ()), recut), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(out["text"], pa.string()), _lists([c for c, _ in kept]), _lists([t for _, t in kept]),
                 *(pa.array(out[k], pa.int64()) for k in ("before", "after", "edits", "recut"))],
                ["doc_id", "text", "chars", "tokens", "tokens_before", "tokens_after", "n_edits", "recut_chars"])

    return joined.select("doc_id", "text", "chars", "tokens", "edits").mapInArrow(
        each, "doc_id long, text string, chars array<int>, tokens array<int>, tokens_before long, tokens_after long, n_edits long, recut_chars long")


def revision(documents: DataFrame) -> DataFrame:
    """An edit script for every document, as a revision would leave it: a word replaced after a
    third, a remark put in after two thirds, the first character gone."""
    n = F.col("n")
    edit = lambda seq, start, removed, inserted: F.struct(
        F.lit(seq).alias("seq"), start.cast("long").alias("start"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))
    script = F.array(edit(0, F.floor(n / 3), 7, " revised "), edit(1, F.floor(2 * n / 3), 0, " (see note 12)\n"), edit(2, F.lit(0), 1, ""))
    sizes = documents.groupBy("doc_id").agg(F.min(F.length(F.coalesce("text", F.lit("")))).alias("n"))
    return sizes.select("doc_id", F.inline(script))


def counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, tokens_before, tokens_after, n_edits, recut_chars, n_chars and text_crc32 after revision()."""
    state = cut(trees(documents, path))
    done = recount(documents, state, revision(documents), path)
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "tokens_before", "tokens_after", "n_edits", "recut_chars", F.length(text).cast("long").alias("n_chars"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
