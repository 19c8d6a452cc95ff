"""Near-duplicate lines by deletion neighbourhoods, keeping the earliest.

Lines are compared with A-Z lower-cased and their words joined by one space. Equal lines become one
first, in the place of the earliest, however short they are. Two lines are near if one word
changed, added or left out turns one into the other and the longer one has ``min_words`` words or more;
where both have fewer words, likewise with one character and ``min_chars`` characters (a line of a script
without spaces is one word). Other lines are near to equal ones only: one word or character is too
much of them.

Each distinct line that can have a neighbour emits the hash of itself and, if it is long enough, of every
variant with one unit (word or character) deleted. A line that is one unit short of a bound emits itself
only, and one of ``min_words`` - 1 words both as words and as characters:

* lines with the same variant at the same place differ in that unit only;
* a line that equals another's variant lacks that unit only.

So the earliest line under a key and place, or under a key beside lines that equal it, is near to
all the others there; no pairs within a key are needed, and a group of any size costs its rows.
Minima are taken before the shuffle and joined to the rows of keys that several lines have, so that
Spark can split a hot key. What a line was removed for is then checked by edit distance on the
units themselves. A line near to another shares with it a run of units at its start or at its end,
so lines that share neither with any other emit nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut, mixed, rows, seeds, spare

#: Least lengths of the longer of two lines that one changed word, or one changed character, leaves near.
MIN_WORDS, MIN_CHARS = 8, 20


def normalised(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def units(line: bytes, min_words: int, min_chars: int) -> list[tuple[bytes, Sequence, bool]]:
    """Ways to compare a normalised line: kind, units (words as bytes, or characters as a string), and whether
    it is long enough to be near to a line that lacks one."""
    words = line.split(b" ")
    out: list[tuple[bytes, Sequence, bool]] = []
    if len(words) >= min_words - 1:
        out.append((b"w", words, len(words) >= min_words))
    if len(words) < min_words:
        chars = line.decode("utf-8", "surrogatepass")
        if len(chars) >= min_chars - 1:
            out.append((b"c", chars, len(chars) >= min_chars))
    return out


def _bytes(part: Sequence) -> bytes:
    return part.encode("utf-8", "surrogatepass") if isinstance(part, str) else b" ".join(part)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def ends(kind: bytes, u: Sequence) -> list[int]:
    """Keys of which near lines share one: the first and the last units of a line of n, about half of
    them, and as a line of n - 1 has them where that is another number."""
    n = len(u)
    half = 2 * (n // 4)
    out = []
    for size in {half, 2 * ((n - 1) // 4)}:
        out += [_signed(xxhash.xxh3_64_intdigest(b"%bp%d " % (kind, size) + _bytes(u[:size]))),
                _signed(xxhash.xxh3_64_intdigest(b"%bs%d " % (kind, size) + _bytes(u[n - size:])))]
    return out


def variants(kind: bytes, u: Sequence) -> np.ndarray:
    """Hash of the line, then of the line without its first unit, its second, and so on; a hash
    stands for the remaining units in order, their number and kind."""
    n = len(u)
    if kind == b"c":
        u = [c.encode("utf-8", "surrogatepass") for c in u]
    h = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, u), np.uint64, n))
    base = seeds(1, 23 if kind == b"w" else 29)[0]
    with np.errstate(over="ignore"):
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base), dtype=np.uint64)])
        # Sum over places i of h[i] * power[i]: what stands behind a deleted unit moves one place forward.
        terms = h * power[:n]
        upto = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        moved = np.concatenate([[np.uint64(0)], np.cumsum(h[1:] * power[: n - 1], dtype=np.uint64)])
        without = upto[:n] + (moved[n - 1] - moved[:n])
        return np.concatenate([[mixed(upto[n:] + np.uint64(n))[0]], mixed(without + np.uint64(n - 1))])


def near(a: Sequence, b: Sequence) -> bool:
    """Whether the edit distance of two sequences is one at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def _lines(documents: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """A row for each line with a word of documents (doc_id, text, whole): doc_id, whole, place, hash of the
    line, and the keys of its ends (null where it has no units)."""
    def each(batches):
        for d in rows(batches):
            docs, wholes, places, names, keys = [], [], [], [], []
            for doc, text, whole in zip(d["doc_id"], d["text"], d["whole"], strict=True):
                for place, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    line = normalised(line)
                    if line:
                        found = units(line, min_words, min_chars)
                        docs.append(doc)
                        wholes.append(whole)
                        places.append(place)
                        names.append(xxhash.xxh3_128_digest(line))
                        keys.append([k for kind, u, _ in found for k in ends(kind, u)] or None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(wholes, pa.int64()), pa.array(places, pa.int32()), pa.array(names, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "whole", "place", "line", "ends"])

    return documents.mapInArrow(each, "doc_id long, whole long, place int, line binary, ends array<long>")


#: Lines of a document that its place in the order leaves room for.
PLACES = 1 << 31


def _order() -> Column:
    """A line's place in the corpus as one number, of which hash aggregation can keep the least."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit(str(1 << 63)).cast("decimal(19,0)"))
    return (doc * F.lit(PLACES).cast("decimal(10,0)") + F.col("place")).cast("decimal(38,0)")


def _texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(first, text) of the wanted lines (doc_id, whole, place, line, first), as normalised. Rows are met by
    doc_id and the hash of their whole text, so rows without doc_id are as many keys as they have texts."""
    def each(batches):
        for d in rows(batches, 200):
            firsts, texts = [], []
            for text, places, names, orders in zip(d["text"], d["places"], d["names"], d["orders"], strict=True):
                split = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                for p, name, first in zip(places, names, orders, strict=True):
                    line = normalised(split[p]) if p < len(split) else b""
                    if xxhash.xxh3_128_digest(line) == name:  # another row of this doc_id may have another text
                        firsts.append(first)
                        texts.append(line)
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.decimal128(38, 0)), pa.array(texts, pa.binary())], ["first", "line"])

    by_doc = wanted.groupBy("doc_id", "whole").agg(F.collect_list(F.struct("place", "line", "first")).alias("x")).select(
        F.col("doc_id").alias("of"), F.col("whole").alias("as"), F.col("x.place").alias("places"), F.col("x.line").alias("names"), F.col("x.first").alias("orders"))
    found = documents.join(by_doc, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("whole") == F.col("as"))).select("text", "places", "names", "orders").mapInArrow(
        each, "first decimal(38,0), line binary")
    return found.dropDuplicates(["first", "line"])


def _keys(texts: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """(key, at, first): at is the deleted unit's place, or -1 for the line itself."""
    def each(batches):
        for d in rows(batches, 500):
            found = [(i, variants(kind, u)[: None if long else 1]) for i, line in enumerate(d["line"]) for kind, u, long in units(line, min_words, min_chars)]
            keys, sizes = [k for _, k in found], [len(k) for _, k in found]
            names = np.repeat(np.array([i for i, _ in found], np.int64), sizes)
            at = np.concatenate([np.arange(n) - 1 for n in sizes]) if sizes else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)), pa.array(at.astype(np.int32)),
                 pa.array(d["first"], pa.decimal128(38, 0)).take(pa.array(names.astype(np.int64)))], ["key", "at", "first"])

    return texts.select("line", "first").mapInArrow(each, "key long, at int, first decimal(38,0)")


def _confirmed(pairs: DataFrame, texts: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """first of the pairs (first, earlier) of which the lines are near by their units."""
    def each(batches):
        for d in rows(batches):
            keep = []
            for n, a, b in zip(d["first"], d["line"], d["other"], strict=True):
                others = {kind: (y, long) for kind, y, long in units(b, min_words, min_chars)}
                if any(kind in others and (long or others[kind][1]) and near(x, others[kind][0]) for kind, x, long in units(a, min_words, min_chars)):
                    keep.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.decimal128(38, 0))], ["first"])

    other = texts.select(F.col("first").alias("earlier"), F.col("line").alias("other"))
    return pairs.join(texts, "first").join(other, "earlier").select("first", "line", "other").mapInArrow(
        each, "first decimal(38,0)").distinct()


def duplicate_lines(documents: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """From documents (doc_id, text, whole, a hash of the text): (doc_id, whole, place, line) of every line
    to be removed, line being its hash. A line goes if an earlier one is equal or near to it, whether or not the earlier one
    goes itself. Order: doc_id (null last), then place in the text."""
    limits = min_words, min_chars
    lines = cut(_lines(documents, *limits).withColumn("own", _order()))
    distinct = cut(lines.groupBy("line").agg(F.min("own").alias("first"), F.max("own").alias("last"), F.min_by("whole", "own").alias("whole"), F.first("ends").alias("ends")))
    # Lines that share an end with another line.
    by_end = distinct.select("line", "first", "whole", F.explode("ends").alias("end"))
    twice = cut(by_end.groupBy("end").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select("end"))
    candidates = by_end.join(twice, "end").select("line", "first", "whole").distinct()
    # The order holds the document and the place of a line's first occurrence.
    doc = F.expr(f"if(first >= {1 << 63}BD * {PLACES}BD, null, (first - pmod(first, {PLACES}BD)) div {PLACES}BD)")
    wanted = candidates.select(doc.alias("doc_id"), "whole", F.expr(f"cast(pmod(first, {PLACES}BD) as int)").alias("place"), "line", "first")
    texts = cut(_texts(documents, wanted))
    keys = _keys(texts, *limits)
    # Under one key a line itself (at = -1) faces variants of longer lines, and these face it and each other.
    of_key = cut(keys.groupBy("key").agg(
        F.min("first").alias("a"), F.max("first").alias("b"), F.min(F.when(F.col("at") == -1, F.col("first"))).alias("equal"),
        F.min(F.when(F.col("at") >= 0, F.col("first"))).alias("variant")).where("a < b").drop("a", "b"))
    met = cut(keys.join(of_key, "key"))
    of_place = cut(met.groupBy("key", "at").agg(F.min("first").alias("same_place")))
    earlier = F.when(F.col("at") == -1, F.col("variant")).otherwise(F.least("same_place", "equal"))
    pairs = met.join(of_place, ["key", "at"]).select("first", earlier.alias("earlier")).where("earlier < first").distinct()
    near_lines = _confirmed(pairs, texts, *limits).withColumn("near", F.lit(True))
    verdicts = cut(distinct.join(near_lines, "first", "left").where("first < last or near").select("line", "first", "near"))
    return lines.select("doc_id", "whole", "place", "line", "own").join(verdicts, "line").where("own > first or near").select("doc_id", "whole", "place", "line")


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, drop_emptied: bool = False,
                count_as: str | None = None) -> DataFrame:
    """documents with the columns given, text without the lines that equal or nearly equal an
    earlier line of the table. count_as: name of a further column, the number of lines removed; it
    must not be a column of documents.

    Null and empty texts and lines without a word stay as they are. Rows that share a doc_id are
    one document: a line at the same place in them is one line. Rows without doc_id share their lines
    likewise, after all others. With drop_emptied, rows that lose lines and keep no word are left
    out. An empty table gives no rows.
    """
    if count_as is not None and spare(documents, count_as) != [count_as]:
        raise ValueError(f"documents have a column {count_as} already")
    text = F.col("text").cast("string")
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("whole"))
    # Sets drop what repeated rows give twice; a distinct() here would hold a hot line's rows in one task.
    gone = duplicate_lines(chosen, min_words, min_chars).groupBy("doc_id", "whole").agg(F.collect_set(F.struct("place", "line")).alias("x"))
    of, whole, found = spare(documents, "of", "whole", "found")
    gone = gone.select(F.col("doc_id").alias(of), F.col("whole").alias(whole), F.col("x").alias(found))
    joined = documents.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(whole)), "left").drop(of, whole)
    fields = list(documents.schema.fields)
    at = documents.columns.index("text")

    def each(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts, counts, keep = [], [], []
                for text, found in zip(part.column(at).to_pylist(), part.column(len(fields)).to_pylist(), strict=True):
                    n = 0
                    if found and text:
                        split = text.split("\n")
                        drop = {f["place"] for f in found if f["place"] < len(split) and f["line"] == xxhash.xxh3_128_digest(
                            normalised(split[f["place"]].encode("utf-8", "surrogatepass")))}
                        n, text = len(drop), "\n".join(x for i, x in enumerate(split) if i not in drop)
                    texts.append(text)
                    counts.append(n)
                    keep.append(not (drop_emptied and n and not text.encode("utf-8", "surrogatepass").split()))
                cols = [pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(fields))]
                more = [] if count_as is None else [pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *more], schema.names).filter(pa.array(keep, pa.bool_()))

    schema = StructType(fields + ([] if count_as is None else [StructField(count_as, LongType())]))
    return joined.mapInArrow(each, schema)


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 of the text that stays (null for a null text)."""
    newlines = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    before = documents.select("doc_id", "text", (newlines + 1).cast("long").alias("n_lines"))
    after = dedup_lines(before, count_as="n_removed")
    return after.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))
