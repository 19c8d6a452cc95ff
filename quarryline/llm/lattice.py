"""Document likelihood under a subword lattice.

A document is its lower-cased words and one end. A word is spelled as a mark of its start and its
bytes; every way to cut this into pieces of an existing vocabulary, or into single bytes, is a
path of the word's lattice. Pieces have unigram probabilities; a forward recursion sums the paths
in log space, and since no piece crosses a word the document's marginal probability is the product
over its words and the end. The mark is none of a text's bytes, so texts and sequences of pieces
match one to one and the probabilities of all texts sum to 1 at most. The vocabulary's own scores
are the starting weights; expectation maximisation over all words of the training documents then
fits them to the corpus (with rounds=0 the starting weights stay).

Each block of documents is stored as its distinct words and a sparse matrix of counts. Words meet
the corpus-wide table once for each block rather than once for each document, and the text is read
once. Blocks close at a bound of words, so none grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words in a block of documents at which it closes.
BLOCK_WORDS = 1 << 22
ROUNDS = 1
#: Added to each piece's expected count, so that none becomes impossible.
ADDED = 0.1
#: The mark of a word's start in piece names, and the byte that stands for it: no text in UTF-8 has it,
#: so a word that contains the mark's character is spelled by that character's bytes.
SHOWN, MARK = "▁".encode(), b"\xff"
END = b""  # no word is empty


class Pieces:
    """A trie of the pieces as a table of steps, for lattices of whole batches of words at once."""

    def __init__(self, names: list[bytes], scores: np.ndarray):
        child: dict[tuple[int, int], int] = {}
        self.piece = [-1]
        for i, name in enumerate(names):
            node = 0
            for c in name:
                node = child.setdefault((node, c), len(self.piece))
                if node == len(self.piece):
                    self.piece.append(-1)
            self.piece[node] = i
        self.piece = np.array(self.piece, np.int32)
        self.first = np.array([child[0, c] for c in range(256)], np.int32)
        # Bytes that no piece has behind its first share a class without steps.
        inner = sorted({c for node, c in child if node})
        self.cls = np.zeros(256, np.int64)
        self.cls[inner] = np.arange(1, len(inner) + 1)
        self.step = np.zeros((len(self.piece), len(inner) + 1), np.int32)
        for (node, c), to in child.items():
            if node:
                self.step[node, self.cls[c]] = to
        self.scores = scores

    def edges(self, m: np.ndarray):
        """For words of one length, the columns of m: (start, length, words, pieces) of all lattice edges."""
        size, n = m.shape
        cls, everyone = self.cls[m], np.arange(n)
        for start in range(size):
            at, node = everyone, self.first[m[start]]
            yield start, 1, at, self.piece[node]
            for length in range(2, size - start + 1):
                node = self.step[node, cls[start + length - 1, at]]
                alive = np.flatnonzero(node)
                if not len(alive):
                    break
                at, node = at[alive], node[alive]
                p = self.piece[node]
                hit = np.flatnonzero(p >= 0)
                if len(hit):
                    yield start, length, at[hit], p[hit]


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece file as bytes and their log weights: the file's scores fall by rank,
    and exp(-log(2 + rank)) is the usual law of frequency by rank. Single bytes complete the
    vocabulary, and the end stands last."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([b]): -np.log(2.0 + m.get_piece_size()) for b in range(256)}
    for i in range(m.get_piece_size()):
        if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)) and m.get_score(i) > -1e6:
            b = m.id_to_piece(i).encode()
            b = MARK + b[len(SHOWN):] if b.startswith(SHOWN) else b
            # Lower-cased words meet no capitals, and a mark stands only at a word's start.
            if b == b.lower() and SHOWN not in b:
                weight[b] = max(weight.get(b, -np.inf), -np.log(2.0 - m.get_score(i)))
    names = [*weight, END]
    w = np.array([*weight.values(), -np.log(2.0)])
    return names, w - np.log(np.exp(w).sum())


def by_length(words: list[bytes], most: int = 1 << 17):
    """(places, matrix with a word in each column) for words of one spelled length, in parts of
    bounded size."""
    spelled = [MARK + w for w in words]
    order: dict[int, list[int]] = {}
    for i, s in enumerate(spelled):
        order.setdefault(len(s), []).append(i)
    for size, at in order.items():
        step = max(1, most // size)
        for k in range(0, len(at), step):
            part = at[k : k + step]
            yield np.array(part), np.frombuffer(b"".join(spelled[i] for i in part), np.uint8).reshape(-1, size).T.copy()


def forward(pieces: Pieces, m: np.ndarray, keep: bool = False):
    """Log marginal probability of each word of m; with keep, also the table and the edges."""
    size, n = m.shape
    alpha = np.full((size + 1, n), -np.inf)
    alpha[0] = 0.0
    edges = []
    for start, length, at, p in pieces.edges(m):
        to = start + length
        alpha[to, at] = np.logaddexp(alpha[to, at], alpha[start, at] + pieces.scores[p])
        if keep:
            edges.append((start, to, at, p))
    return (alpha, edges) if keep else alpha[size]


def gathered(batches, size: int = 100_000):
    """Arrow batches joined to tables of size rows or a little more, as many short steps cost more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def expected(pieces: Pieces, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words, each taken counts times."""
    out = np.zeros(len(pieces.scores))
    for at, m in by_length(words):
        alpha, edges = forward(pieces, m, keep=True)
        size, n = m.shape
        beta = np.full((size + 1, n), -np.inf)
        beta[size] = 0.0
        for start, to, rows, p in reversed(edges):
            beta[start, rows] = np.logaddexp(beta[start, rows], beta[to, rows] + pieces.scores[p])
        for start, to, rows, p in edges:
            share = np.exp(alpha[start, rows] + pieces.scores[p] + beta[to, rows] - alpha[size, rows])
            out += np.bincount(p, share * counts[at[rows]], len(out))
    return out


BLOCK = "block long, doc_ids binary, held binary, starts binary, columns binary, times binary, words array<binary>, train array<long>"


def _blocks(documents: DataFrame, block_words: int) -> DataFrame:
    """One row for each block of documents: see the module's text. held: 1 for held-out rows."""
    def each(batches):
        task = TaskContext.get()
        name, done = (task.partitionId() if task else 0) << 32, 0
        ids: dict[bytes, int] = {}
        doc_ids, held, starts, columns, times = [], [], [0], [], []
        train = np.zeros(0, np.int64)

        def closed():
            yield pa.RecordBatch.from_arrays([
                pa.array([name + done]), *(pa.array([np.concatenate(x).astype(t).tobytes()], pa.binary()) for x, t in (
                    ([np.array(doc_ids, np.int64)], "<i8"), ([np.array(held, np.uint8)], "u1"), ([np.array(starts)], "<i8"),
                    ([np.zeros(0, np.int64), *columns], "<i4"), ([np.zeros(0, np.int64), *times], "<i4"))),
                pa.array([list(ids)], pa.list_(pa.binary())), pa.array([train[: len(ids)].tolist()], pa.list_(pa.int64()))],
                ["block", "doc_ids", "held", "starts", "columns", "times", "words", "train"])

        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                d = batch.slice(at, 500).to_pydict()
                for doc, text, out in zip(d["doc_id"], d["text"], d["held_out"], strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                    for w in words:
                        if w not in ids:
                            ids[w] = len(ids)
                    col, n = np.unique(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), return_counts=True)
                    if len(train) < len(ids):
                        train = np.concatenate([train, np.zeros(max(len(ids) - len(train), len(train), 1024), np.int64)])
                    if not out:
                        train[col] += n
                    doc_ids.append(-1 if doc is None else doc)
                    held.append(int(out) + 2 * (doc is None))
                    starts.append(starts[-1] + len(col))
                    columns.append(col)
                    times.append(n)
                    total += len(words)
                    if total >= block_words:
                        yield from closed()
                        ids, doc_ids, held, starts, columns, times, total = {}, [], [], [0], [], [], 0
                        train, done = np.zeros(0, np.int64), done + 1
        if doc_ids:
            yield from closed()

    doc = F.col("doc_id").cast("long")
    held = F.coalesce(F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))
    return documents.select(doc.alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out")).mapInArrow(each, BLOCK)


def _fitted(table: DataFrame, names: list[bytes], scores: np.ndarray, ends: int) -> np.ndarray:
    """One round of expectation maximisation over the training words of table (word, train). Each
    task sends the expected counts of the pieces, as many numbers as the vocabulary has."""
    def each(batches):
        pieces, total = Pieces(names[:-1], scores[:-1]), np.zeros(len(names) - 1)
        for part in gathered(batches):
            total += expected(pieces, part.column("word").to_pylist(), part.column("train").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["piece", "uses"])

    found = table.where("train > 0").select("word", "train").mapInArrow(each, "piece long, uses double")
    uses = np.zeros(len(names))
    for r in found.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
        uses[r.piece] = r.uses
    uses[-1] = ends
    uses += ADDED
    return np.log(uses / uses.sum())


def score(documents: DataFrame, path: str, block_words: int = BLOCK_WORDS, rounds: int = ROUNDS) -> DataFrame:
    """For each row of documents (doc_id, text): doc_id, held_out (crc32 of the doc_id as text is 0
    modulo 10), n_tokens, n_known, train_tokens, base_score, score and start_score, all log10. start_score is
    the text's probability under the scores that the vocabulary came with, score that under the scores after
    `rounds` of fitting. The model and the base count only rows that are not held out. path: a sentencepiece
    file, read on the driver.

    A null or empty text is the end alone. A null doc_id trains. Repeated rows count as often as
    they stand; other columns are ignored; an empty table gives no rows.
    """
    blocks = cut(_blocks(documents, block_words))
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("words", "train")).alias("place", "x")).select(
        "block", "place", F.col("x.words").alias("word"), F.col("x.train").alias("train"))
    table = cut(pairs.groupBy("word").agg(F.sum("train").alias("train")))

    def ended(batches):
        for batch in batches:
            n = sum(int((np.frombuffer(h, np.uint8) & 1 == 0).sum()) for h in batch.column("held").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    ends = blocks.select("held").mapInArrow(ended, "n long").agg(F.sum("n")).first()[0] or 0
    known, tokens = table.where("train > 0").agg(F.count("*"), F.sum("train")).first()
    all_tokens, distinct = (tokens or 0) + ends, known + (ends > 0)
    names, scores = vocabulary(path)
    given = scores
    for _ in range(rounds if known else 0):
        scores = _fitted(table, names, scores, ends)

    def marginal(batches):
        fitted, first = Pieces(names[:-1], scores[:-1]), Pieces(names[:-1], given[:-1])
        for part in gathered(batches):
            words, out, start = part.column("word").to_pylist(), np.zeros(part.num_rows), np.zeros(part.num_rows)
            for places, m in by_length(words):
                out[places] = forward(fitted, m)
                start[places] = forward(first, m)
            yield from part.append_column("log_p", pa.array(out)).append_column("log_0", pa.array(start)).to_batches()

    scored = cut(table.mapInArrow(marginal, "word binary, train long, log_p double, log_0 double"))
    answers = pairs.select(F.col("block").alias("of"), "place", "word").join(scored, "word").select("of", "place", "train", "log_p", "log_0")
    base_floor = float(all_tokens + 0.1 * (distinct + 1))
    end_base, end_score, end_start = np.log10((ends + 0.1) / base_floor), float(scores[-1] / np.log(10)), float(given[-1] / np.log(10))

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        place = right.column("place").to_numpy()
        train, log_p, log_0 = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        for own, c in ((train, "train"), (log_p, "log_p"), (log_0, "log_0")):
            own[place] = right.column(c).to_numpy()
        base = np.log10((train + 0.1) / base_floor)
        out = []
        for d in left.to_pylist():
            doc, held = np.frombuffer(d["doc_ids"], "<i8"), np.frombuffer(d["held"], "u1")
            starts, col = np.frombuffer(d["starts"], "<i8"), np.frombuffer(d["columns"], "<i4")
            times = np.frombuffer(d["times"], "<i4")
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[starts])  # noqa: B023, E731
            # Differences of running sums lose digits, so doubles are summed row by row.
            rowsum = lambda v: np.add.reduceat(np.append(v, 0.0), starts[:-1]) * (np.diff(starts) > 0)  # noqa: B023, E731
            out.append(pa.table({
                "doc_id": pa.array(doc, pa.int64(), mask=held >= 2), "held_out": pa.array(held & 1 == 1),
                "n_tokens": total(times) + 1, "n_known": total(times * (train[col] > 0)) + int(ends > 0),
                "train_tokens": np.full(len(doc), all_tokens, np.int64),
                "base_score": rowsum(times * base[col]) + end_base, "score": rowsum(times * log_p[col]) / np.log(10) + end_score,
                "start_score": rowsum(times * log_0[col]) / np.log(10) + end_start}))
        return pa.concat_tables(out) if out else _EMPTY

    return blocks.select("block", "doc_ids", "held", "starts", "columns", "times").groupBy("block").cogroup(
        answers.groupBy("of")).applyInArrow(
        summed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, start_score double")


_EMPTY = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("start_score", pa.float64())]).empty_table()
