"""Benchmark decontamination with a generalised suffix automaton over test items.

Items and documents are taken as lower-cased words. The automaton of a block of items follows the
words of a document and tracks the length of the longest match that ends at each word. A window is
``width`` consecutive words of an item, or a whole item of fewer words; a document word inside an
occurrence of a window is hit. Items are few beside documents, so a block of them travels to every
task; its size is counted, and more items than one block holds are handled in further passes.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rows, spare

#: Bytes of item texts in one automaton; it is the bound on what each pass sends to the tasks.
BLOCK_BYTES = 4 << 20
#: Lower-cases A-Z, keeps 0-9, a-z and all bytes beyond ASCII, and makes white space of the rest.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences, and for each state the items with windows there."""

    def __init__(self, items: list[tuple[str | None, str | bytes]], width: int):
        self.width = width
        self.ids: dict[bytes, int] = {}
        seqs = [(i, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for i, t in items if (ws := words(t))]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, seq in seqs:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.shortest = min((min(len(s), width) for _, s in seqs), default=0)
        pairs = {a * len(self.ids) + b for _, s in seqs for a, b in zip(s, s[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        #: State of a full window -> items; state of a short item -> its length and items.
        self.windows: dict[int, set] = {}
        self.short: dict[int, tuple[int, set]] = {}
        for i, seq in seqs:
            state = length = 0
            for c in seq:
                state, length = self._step(state, length, c)
                if length >= width:
                    self.windows.setdefault(self._up(state, width), set()).add(i)
            if len(seq) < width:
                self.short.setdefault(self._up(state, len(seq)), (len(seq), set()))[1].add(i)
        # For each state the nearest one on its way to the root, itself included, that ends a short item.
        self.ends = [-1] * len(self.len)
        for v in sorted(range(len(self.len)), key=self.len.__getitem__):
            self.ends[v] = v if v in self.short else self.ends[self.link[v]] if self.link[v] >= 0 else -1

    def _new(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of q for the strings that p reaches by c."""
        clone = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier item has this already
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, c)
        cur, p = self._new(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return cur

    def _step(self, state: int, length: int, c: int) -> tuple[int, int]:
        while state and c not in self.next[state]:
            state = self.link[state]
            length = self.len[state]
        to = self.next[state].get(c)
        return (to, length + 1) if to is not None else (0, 0)

    def _up(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a match that ends in state."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Maximal runs [start, end) of hit words, the items with occurring windows, and the length
        of the longest match. Only stretches whose words and word pairs all stem from the items are
        followed; anywhere else the automaton would fall back to its root."""
        n = len(ws)
        if not n or not self.shortest:
            return [], set(), 0
        ids = np.fromiter(map(self.ids.get, ws, repeat(-1)), np.int64, n)
        known = ids >= 0
        pair = ids[:-1] * len(self.ids) + ids[1:]
        at = np.searchsorted(self.pairs, pair)
        linked = np.zeros(n + 1, bool)  # linked[i]: words i-1 and i can stand in one match
        if len(self.pairs):
            linked[1:n] = known[:-1] & known[1:] & (self.pairs[np.minimum(at, len(self.pairs) - 1)] == pair)
        starts = np.flatnonzero(known & ~linked[:-1])
        stops = np.flatnonzero(known & ~linked[1:]) + 1
        delta, items, longest = np.zeros(n + 1, np.int64), set(), 0
        enough = stops - starts >= self.shortest
        longest = int(min((stops - starts).max(initial=0), 1))
        for start, stop in zip(starts[enough].tolist(), stops[enough].tolist(), strict=True):
            state = length = 0
            for i, c in enumerate(ids[start:stop].tolist(), start):
                state, length = self._step(state, length, c)
                longest = max(longest, length)
                if length >= self.width:
                    items |= self.windows.get(self._up(state, self.width), set())
                    delta[i - self.width + 1] += 1
                    delta[i + 1] -= 1
                e = self.ends[state]
                while e >= 0:
                    m, found = self.short[e]
                    if m <= length:
                        items |= found
                        delta[i - m + 1] += 1
                        delta[i + 1] -= 1
                    e = self.ends[self.link[e]]
        hit = np.concatenate([[False], np.cumsum(delta[:-1]) > 0, [False]])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), items, longest


#: Words and bytes at which an item is cut into pieces that share width - 1 words.
PIECE_WORDS, PIECE_BYTES = 4096, 1 << 16


def _pieces(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, text) of the distinct items, long ones in pieces which together have the item's windows."""
    def each(batches):
        for d in rows(batches):
            ids, texts = [], []
            for i, text in zip(d["item_id"], d["text"], strict=True):
                ws, start, at, size = words(text), 0, 0, 0
                while at < len(ws):
                    size += len(ws[at]) + 1
                    at += 1
                    full = at - start >= width and (at - start >= PIECE_WORDS or size >= PIECE_BYTES)
                    if full or at == len(ws):
                        ids.append(i)
                        texts.append(b" ".join(ws[start:at]))
                        start, size = at - width + 1, sum(map(len, ws[max(0, at - width + 1):at])) + width
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], ["item_id", "text"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return cut(items.mapInArrow(each, "item_id string, text binary").distinct())


def _blocks(benchmark: DataFrame, block_bytes: int, width: int) -> list[DataFrame]:
    """Parts of the items, chosen by hash, of which none has more than block_bytes; only a single
    piece may. Sizes are counted; more parts are made until all keep the bound."""
    pieces = _pieces(benchmark, width)
    size = F.octet_length("text") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 1
    part = lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    total = pieces.agg(F.sum(size)).first()[0] or 0
    n = 1 if total <= block_bytes else -(-total * 5 // (4 * block_bytes))
    while pieces.groupBy(part(n)).agg(F.sum(size).alias("size"), F.count("*").alias("n")).where(f"size > {block_bytes} and n > 1").count():
        n = 2 * n
    return [pieces.where(part(n) == i) if n > 1 else pieces for i in range(n)]


def _collected(block: DataFrame) -> list[tuple[str | None, bytes]]:
    """The rows of one block, at most block_bytes."""
    return [(r.item_id, bytes(r.text)) for r in block.collect()]


SPANS = "doc_id long, n_words long, spans array<struct<start:int,stop:int>>, items array<string>, longest int"


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = 13, block_bytes: int = BLOCK_BYTES,
                  row: str | None = None) -> DataFrame:
    """For each row of documents (doc_id, text): doc_id, n_words, spans (word ranges [start, stop)
    inside windows of benchmark items), items (their sorted distinct item_ids, as strings) and
    longest (words of the longest match, which may end at a piece of PIECE_WORDS words). row: a column that tells rows apart, returned as well.

    Null and empty texts have no words and no spans; items without words have no windows; items
    without item_id make hits but are not listed; repeated items and rows count as they are. Other
    columns are ignored. Empty tables give no spans or no rows.
    """
    blocks = _blocks(benchmark, block_bytes, width)
    keep = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    chosen = documents.select(*keep, *([F.col(f"`{row}`").cast("long").alias("_row")] if row else []))
    if len(blocks) == 1:
        return _scanned(chosen, blocks[0], width)
    if row is None:
        # Several passes meet by row, so rows need a name that repeated doc_ids don't give.
        chosen = cut(chosen.withColumn("_row", F.monotonically_increasing_id()))
    # Each pass ends before the next block is fetched, so the driver holds one at a time.
    passes = [cut(_scanned(chosen, block, width)) for block in blocks]
    merged = passes[0]
    for p in passes[1:]:
        merged = merged.union(p)
    out = merged.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"))
    return out.select("doc_id", "n_words", "spans", "items", "longest", "_row").mapInArrow(_joined, SPANS + ", _row long")


def _joined(batches):
    """Unions of the spans that several passes found."""
    for d in rows(batches):
        spans = []
        for found in d["spans"]:
            out: list[dict] = []
            for s in sorted(found, key=lambda s: s["start"]):
                if out and s["start"] <= out[-1]["stop"]:
                    out[-1]["stop"] = max(out[-1]["stop"], s["stop"])
                else:
                    out.append(dict(s))
            spans.append(out)
        yield pa.RecordBatch.from_pydict(
            {"doc_id": d["doc_id"], "n_words": d["n_words"], "spans": spans, "items": d["items"], "longest": d["longest"],
             "_row": d["_row"]}, schema=pa.schema([*_FIELDS, ("_row", pa.int64())]))


_FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()),
           ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
           ("items", pa.list_(pa.string())), ("longest", pa.int32())]


def _scanned(documents: DataFrame, block: DataFrame, width: int) -> DataFrame:
    items = _collected(block)
    named = "_row" in documents.columns

    def each(batches):
        automaton = Automaton(items, width)
        schema = pa.schema([*_FIELDS, *([("_row", pa.int64())] if named else [])])
        for d in rows(batches):
            out: dict[str, list] = {"doc_id": d["doc_id"], "n_words": [], "spans": [], "items": [], "longest": []}
            for text in d["text"]:
                ws = words(text)
                spans, found, longest = automaton.scan(ws)
                out["n_words"].append(len(ws))
                out["spans"].append([{"start": a, "stop": b} for a, b in spans])
                out["items"].append(sorted(i for i in found if i is not None))
                out["longest"].append(longest)
            if named:
                out["_row"] = d["_row"]
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return documents.mapInArrow(each, SPANS + ", _row long" * named)


def n_hit():
    return F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"]), F.lit(0).cast("long"))


def is_contaminated(coverage_percent: int = 5):
    return (n_hit() > 0) & (100 * n_hit() >= coverage_percent * F.col("n_words"))


def digests(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of documents."""
    found = contamination(documents, benchmark)
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, coverage_percent: int = 5,
                        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents without the rows of which benchmark windows cover coverage_percent of the words or
    more. The other rows stay as they are, with all their columns."""
    blocks = _blocks(benchmark, block_bytes, 13)
    if len(blocks) > 1:
        (row,) = spare(documents, "row")
        named = cut(documents.withColumn(row, F.monotonically_increasing_id()))
        bad = contamination(named, benchmark, 13, block_bytes, row).where(is_contaminated(coverage_percent)).select(F.col("_row").alias(f"{row}_bad"))
        return named.join(bad, F.col(row) == F.col(f"{row}_bad"), "left_anti").drop(row)
    items = _collected(blocks[0])

    def each(batches):
        automaton = Automaton(items, 13)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keep = []
                for text in part.column("text").to_pylist():
                    ws = words(text)
                    hit = sum(b - a for a, b in automaton.scan(ws)[0])
                    keep.append(not hit or 100 * hit < coverage_percent * len(ws))
                yield part.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(each, documents.schema)


def without_spans(documents: DataFrame, benchmark: DataFrame, max_length: int = 13) -> DataFrame:
    """doc_id, text of each row of documents, with every span of max_length or more hit words cut
    out of the text. A null text stays null."""
    named = cut(documents.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()))
    found = contamination(named, benchmark, row="_row").select("_row", "spans")

    def each(batches):
        word = re.compile(rb"[^ ]+")
        for d in rows(batches):
            texts = []
            for text, spans in zip(d["text"], d["spans"], strict=True):
                cuts = [(s["start"], s["stop"]) for s in spans if s["stop"] - s["start"] >= max_length]
                if cuts:
                    raw = text.encode("utf-8", "surrogatepass")
                    at = [m.span() for m in word.finditer(raw.translate(FOLD))]
                    left, out = 0, []
                    for a, b in cuts:
                        out.append(raw[left : at[a][0]])
                        left = at[b - 1][1]
                    text = b"".join([*out, raw[left:]]).decode("utf-8", "surrogatepass")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(d["doc_id"], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return named.join(found, "_row").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(
        each, "doc_id long, text string")
