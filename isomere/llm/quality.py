"""Quality classifier: a factorisation machine over hashed words and structure.

A text becomes a sparse row: one indicator for the quantile bin of each
structure statistic (repetition, case, punctuation, length and so on) and
hashed words with length-normalised log counts. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

which takes time linear in the entries of the row. It is fitted on at most
``max_rows`` labelled rows (in the order of a hash of the id), whose features,
not texts, reach the driver; scoring reads every whole text.

Null texts count as empty and get a score like any other; rows with a null or
other label than 0 and 1, or a null id, are not learned from, nor are ids whose
labels disagree; with no labels, or one class only, every score is the share of
ones (0.5 without labels). Labels that repeat an id count once; of texts that
share an id the smallest is learned from. Repeated rows are scored alike; very
long texts cost memory as their words do; an empty table gives an empty table;
other columns pass through, whatever their names.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..runtime import ship
from .batches import by_bytes

BUCKETS, BINS, RANK = 1 << 15, 8, 4
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_MARKS = b"!?"
_SYMBOLS = b"#$%&*|<>=_^~@\\{}[]+"
_STOPS = b".,;:"
_HIGH = bytes(range(128, 256))
STATS = ("words", "distinct", "doubled", "top_word", "upper", "digits", "marks", "symbols", "stops", "high", "word_length", "lines", "same_lines", "same_sentences", "bare_words", "longest_word")


def statistics(raw: bytes) -> tuple[list[float], Counter]:
    """Structure statistics and word counts of a text's UTF-8 bytes."""
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    counts = Counter(words)
    share = lambda some: (len(raw) - len(raw.translate(None, some))) / size
    lines = [x for x in raw.split(b"\n") if x]
    sentences = [x for x in raw.replace(b"\n", b".").split(b".") if len(x) > 8]
    return [
        np.log1p(n), len(counts) / max(1, n), sum(map(eq, words, words[1:])) / max(1, n), max(counts.values(), default=0) / max(1, n),
        share(_UPPER), share(_DIGIT), share(_MARKS), share(_SYMBOLS), share(_STOPS), share(_HIGH), (size - n) / max(1, n), len(lines) / max(1, n),
        1 - len({*lines}) / max(1, len(lines)), 1 - len({*sentences}) / max(1, len(sentences)), sum(map(bytes.isalpha, counts)) / max(1, len(counts)), np.log1p(max(map(len, counts), default=0)),
    ], counts


def entries(counts: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and their values; the values have length one together."""
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at = np.fromiter(map(crc32, counts), np.uint32, len(counts)) % BUCKETS
    x = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    return at.astype(np.int32), (x / np.sqrt((x * x).sum())).astype(np.float32)


@dataclass
class Machine:
    """A fitted machine; ``cuts`` are the inner bin edges of each statistic."""

    prior: float
    cuts: np.ndarray | None = None
    w0: float = 0.0
    w: np.ndarray | None = None
    v: np.ndarray | None = None

    def rows(self, stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = len(STATS)
        bins = np.empty((len(stats), m), np.int32)
        for j in range(m):
            bins[:, j] = BUCKETS + j * BINS + np.searchsorted(self.cuts[j], stats[:, j], side="right")
        at = np.concatenate([x for i, (a, _) in enumerate(words) for x in (bins[i], a)])
        val = np.concatenate([x for _, b in words for x in (np.full(m, 0.25, np.float32), b)])
        starts = np.cumsum([0, *(m + len(a) for a, _ in words)])[:-1]
        return at, val, starts

    def raw(self, at: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        y = self.w0 + np.add.reduceat(self.w[at] * val, starts)
        vx = self.v[at] * val[:, None]
        s = np.add.reduceat(vx, starts)
        return y + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.w is None or not texts:
            return np.full(len(texts), self.prior)
        found = [statistics((t or "").encode()) for t in texts]
        y = self.raw(*self.rows(np.array([s for s, _ in found]), [entries(c) for _, c in found]))
        return 1 / (1 + np.exp(-np.clip(y.astype(np.float64), -30, 30)))


def fit(stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 60, rate: float = 0.08, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Full-batch Adam on the logistic loss; deterministic."""
    n = len(labels)
    if not n or labels.min() == labels.max():
        return Machine(float(labels.mean()) if n else 0.5)
    cuts = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    # the tails matter most: the last edges move to the outer quantiles
    cuts[:, 0], cuts[:, -1] = np.quantile(stats, 0.03, axis=0), np.quantile(stats, 0.97, axis=0)
    m = Machine(float(labels.mean()), np.sort(cuts, axis=1))
    at, val, starts = m.rows(stats, words)
    size = BUCKETS + BINS * len(STATS)
    rng = np.random.default_rng(seed)
    m.w, m.v = np.zeros(size, np.float32), rng.normal(0, 0.05, (size, RANK)).astype(np.float32)
    owner = np.repeat(np.arange(n), np.diff([*starts, len(at)]))
    state = [np.zeros_like(p, np.float32) for p in (m.w, m.v, m.w, m.v)]
    b_m = b_v = 0.0
    m.w0 = float(np.log(labels.mean() / (1 - labels.mean())))
    for t in range(1, epochs + 1):
        vx = m.v[at] * val[:, None]
        s = np.add.reduceat(vx, starts)
        y = m.w0 + np.add.reduceat(m.w[at] * val, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
        g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels) / n
        gx = g[owner] * val
        grads = np.bincount(at, gx, size), np.stack([np.bincount(at, gx * (s[owner, f] - vx[:, f]), size) for f in range(RANK)], 1)
        for k, (p, d) in enumerate(zip((m.w, m.v), grads, strict=True)):
            d = (d * n / 8 + decay * p).astype(np.float32)
            state[k] = 0.9 * state[k] + 0.1 * d
            state[k + 2] = 0.99 * state[k + 2] + 0.01 * d * d
            p -= rate * (state[k] / (1 - 0.9**t)) / (np.sqrt(state[k + 2] / (1 - 0.99**t)) + 1e-4)
        b_m, b_v = 0.9 * b_m + 0.1 * g.sum(), 0.99 * b_v + 0.01 * g.sum() ** 2
        m.w0 -= rate * (b_m / (1 - 0.9**t)) / (np.sqrt(b_v / (1 - 0.99**t)) + 1e-6)
    return m


def remainder(id_col: str, by: int):
    """crc32 of the id as text, modulo ``by``; null ids have none."""
    return F.crc32(F.col(id_col).cast("string")) % by


def sample(docs: DataFrame, labels: DataFrame, label: str, by: int, held: int, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled ids outside the held-out fold, a row each.

    Labels that repeat an id count once, an id whose labels disagree not at all;
    of texts that share an id the smallest is taken.
    """
    some = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder("doc_id", by) != held))
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_most")).filter("y = _most").drop("_most")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, by: int = 5, held: int = 0, max_rows: int = 5000) -> Machine:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 1):
                found = [statistics((t or "").encode()) for t in part.column(1).to_pylist()]
                words = [entries(c) for _, c in found]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([s for s, _ in found], pa.list_(pa.float64())), pa.array([a.tobytes() for a, _ in words], pa.binary()), pa.array([b.tobytes() for _, b in words], pa.binary())], ["doc_id", "y", "stats", "at", "val"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample(docs, labels, "quality", by, held, max_rows).mapInArrow(run, f"doc_id {kind}, y int, stats array<double>, at binary, val binary").toArrow().to_pylist()
    got.sort(key=lambda r: str(r["doc_id"]))
    return fit(np.array([r["stats"] for r in got], np.float64).reshape(len(got), len(STATS)), [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["val"], np.float32)) for r in got], np.array([r["y"] for r in got], np.float64))


def scored(docs: DataFrame, machine: Machine, out: str = "score", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, by default), whatever their names, and the score as one more, called ``out`` (a column of that name is replaced)."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(machine)
    names = [c for c in (docs.columns if keep is None else keep) if c != out]
    at = names.index(text_col) if text_col in names else -1
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *([F.col(f"`{text_col}`").cast("string").alias("text")] if at < 0 else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column(1) if at < 0 else batch.column(0).field(at).cast(pa.string())
            done = 0
            for part in by_bytes(pa.RecordBatch.from_arrays([texts], ["text"]), 0, 256):
                scores = m.score(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, part.num_rows), pa.array(scores, pa.float64())], ["row", "score"])
                done += part.num_rows

    scores = packed.mapInArrow(run, StructType([StructField("row", packed.schema["row"].dataType), StructField("score", DoubleType())]))
    return scores.select(*(F.col(f"row.`{c}`") for c in names), F.col("score").alias(out))
