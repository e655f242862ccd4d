"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read the same symbols (insult, threat, target, negation,
report, clause end, other): the insult machine passes on the weight of the
word, the threat machine emits a weight for a threatening verb and more when a
target follows, the target machine a weight for an insult in a clause that
addresses someone; the negation and report machines scale what stands in their
reach. Their composition, built lazily as a product automaton, scores each
clause; a logistic model over the strongest clause, their sum and their density
turns that into a score.

The lexicon of insults starts from the short list below and is extended by
words of the labelled rows (at most ``max_rows`` ids, in the order of a hash of
the id) that mark toxic rows beyond chance in at least three different
contexts, so that the words of one copied text do not count. How much evidence
and how much lift a word needs is chosen by cross-validation among these rows
alone. Word counts, and the few tokens around possible words, reach the driver,
not texts. Every whole text is scored.

Null texts count as empty; rows with a null id or a label other than 0 and 1
are not learned from, nor are ids whose labels disagree; labels that repeat an
id count once, and of texts that share an id the smallest is learned from;
without both classes the weights below are used. Repeated rows are scored
alike, very long texts a token at a time; an empty table gives an empty table;
other columns are dropped.
"""
from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .batches import by_bytes
from .quality import sample

_token = re.compile(r"\w+(?:(?<=n)'t(?!\w))?|[.!?;:\n]")

SEED = frozenset("idiot idiots moron morons stupid pathetic worthless scum trash loser losers clown disgusting imbecile bastard dummkopf trottel abschaum versager widerlich imbécile crétin salaud connard minable imbécil estúpido estúpida escoria basura asqueroso idiota".split())
CLASSES = {
    "THREAT": frozenset("kill hurt destroy beat burn crush murder stab shoot strangle punch töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split()),
    "TARGET": frozenset("you your yours yourself du dich dir dein ihr euch tu toi te ton vous votre tú ti usted ustedes vosotros".split()),
    "NEGATE": frozenset("not never no without cannot isn't aren't wasn't weren't ain't don't doesn't didn't won't wouldn't can't couldn't shouldn't haven't hasn't hadn't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()),
    "REPORT": frozenset("said says called quoted wrote reported alleged sagte nannte schrieb berichtete dit appelé écrit rapporté dijo llamó escribió".split()),
    "END": frozenset(".!?;:\n"),
}
SEED_WEIGHT = 3.0
#: Tokens beyond which no machine remembers, other than to the end of a clause.
REACH = 3
#: Folds of the labelled rows, and what a learned word may need: evidence (twice the log likelihood ratio) and lift; the strictest first.
FOLDS, GRID = 4, tuple((e, l) for e in (30.0, 15.0, 8.0) for l in (60.0, 20.0))
CONTEXTS = 3


def tokens_of(text: str | None) -> list[str]:
    return _token.findall((text or "").lower().replace("\u2019", "'"))


# Each machine gives its next state, a weight to add, the share of the word's own weight, and a factor.


def _insult(state: int, s: str) -> tuple[int, float, float, float]:
    return 0, 0.0, float(s == "INSULT"), 1.0


def _threat(state: int, s: str) -> tuple[int, float, float, float]:
    if s == "THREAT":
        return 3, 0.2, 0.0, 1.0
    if s == "END" or not state:
        return 0, 0.0, 0.0, 1.0
    return (0, 0.8, 0.0, 1.0) if s == "TARGET" else (state - 1, 0.0, 0.0, 1.0)


def _target(state: int, s: str) -> tuple[int, float, float, float]:
    if s in ("TARGET", "END"):
        return int(s == "TARGET"), 0.0, 0.0, 1.0
    return state, 0.5 if state and s == "INSULT" else 0.0, 0.0, 1.0


def _negate(state: int, s: str) -> tuple[int, float, float, float]:
    if s == "NEGATE":
        return 2, 0.0, 0.0, 1.0
    return (0 if s == "END" else max(0, state - 1)), 0.0, 0.0, 0.6 if state else 1.0


def _report(state: int, s: str) -> tuple[int, float, float, float]:
    if s in ("REPORT", "END"):
        return int(s == "REPORT"), 0.0, 0.0, 1.0
    return state, 0.0, 0.0, 0.8 if state else 1.0


class Grammar:
    """The product of the five machines; a transition gives the next state, a weight to add, the share of the word's weight and a factor."""

    parts = (_insult, _threat, _target, _negate, _report)

    def __init__(self) -> None:
        self.arcs: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], float, float, float]] = {}

    def step(self, state: tuple[int, ...], s: str) -> tuple[tuple[int, ...], float, float, float]:
        if (arc := self.arcs.get((state, s))) is None:
            moves = [m(q, s) for m, q in zip(self.parts, state, strict=True)]
            factor = 1.0
            for x in moves:
                factor *= x[3]
            arc = self.arcs[state, s] = tuple(x[0] for x in moves), sum(x[1] for x in moves), sum(x[2] for x in moves), factor
        return arc


_class_of = {w: c for c, ws in CLASSES.items() for w in ws}


@dataclass
class Detector:
    lexicon: dict[str, float]
    weights: tuple[float, ...] = (-3.0, 1.2, 0.6, 2.0)  # bias, strongest clause, sum, density
    grammar: Grammar = field(default_factory=Grammar)

    def __post_init__(self) -> None:
        self.starts = frozenset(self.lexicon) | CLASSES["THREAT"]

    def clauses(self, tokens: list[str]) -> list[float]:
        """The weight of each clause that matches."""
        out, state, total = [], (0,) * len(Grammar.parts), 0.0
        for t in tokens:
            w = self.lexicon.get(t)
            s = "INSULT" if w is not None else _class_of.get(t, "OTHER")
            state, add, own, factor = self.grammar.step(state, s)
            if own or add:
                total += ((w or 0.0) * own + add) * factor
            if s == "END":
                if total:
                    out.append(total)
                total = 0.0
        return [*out, total] if total else out

    def measured(self, tokens: list[str], n: int) -> tuple[float, float, float]:
        """Strongest clause, sum and density of a text of ``n`` tokens, of which those that matter are given."""
        if self.starts.isdisjoint(tokens):
            return 0.0, 0.0, 0.0
        found = self.clauses(tokens)
        return (max(found), log1p(sum(found)), log1p(100 * sum(found) / n)) if found else (0.0, 0.0, 0.0)

    def features(self, text: str | None) -> tuple[float, float, float]:
        tokens = tokens_of(text)
        return self.measured(tokens, len(tokens))

    def score(self, text: str | None) -> float:
        y = self.weights[0] + sum(a * b for a, b in zip(self.weights[1:], self.features(text), strict=True))
        return 1 / (1 + exp(-max(-30.0, min(30.0, y))))


Row = tuple[str | None, int, int]  # text, label, fold


def counted(rows: Iterable[Row]) -> tuple[dict[str, np.ndarray], dict[str, set[str]], np.ndarray]:
    """Rows that hold each word, by label and fold; some words before it in toxic rows; the rows by label and fold."""
    found: dict[tuple[int, int], Counter] = defaultdict(Counter)
    before: dict[str, set[str]] = defaultdict(set)
    n = np.zeros((2, FOLDS), np.int64)
    for text, y, fold in rows:
        n[y, fold] += 1
        tokens = tokens_of(text)
        found[y, fold].update({*tokens})
        if y:
            for a, b in zip(["", *tokens], tokens, strict=False):
                if len(before[b]) < CONTEXTS:
                    before[b].add(a)
    counts: dict[str, np.ndarray] = {}
    for (y, fold), words in found.items():
        for w, k in words.items():
            if w not in counts:
                counts[w] = np.zeros((2, FOLDS), np.int64)
            counts[w][y, fold] += k
    return counts, before, n


def possible(counts: dict[str, np.ndarray], contexts: dict[str, int], n: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of the words that may be learned by any of GRID, and of those listed."""
    least = min(l for _, l in GRID) / 4
    a, b = n.sum(1)
    keep = lambda w, m: len(w) > 1 and m[1].sum() >= CONTEXTS and contexts.get(w, 0) >= CONTEXTS and m[1].sum() * a > least * m[0].sum() * b
    return {w: m for w, m in sorted(counts.items()) if w in SEED or keep(w, m)}


def skeleton(tokens: list[str], words: frozenset[str]) -> list[str]:
    """The clauses that hold one of ``words``, other tokens being blank and at most ``REACH`` of them in a row."""
    out, clause, hit, blank = [], [], False, 0
    for t in tokens:
        hit = hit or t in words
        if t in words or t in _class_of:
            clause.append(t)
            blank = 0
        elif blank < REACH:
            clause.append("")
            blank += 1
        if t in CLASSES["END"]:
            if hit:
                out += clause
            clause, hit, blank = [], False, 0
    return out + clause if hit else out


def lexicon(counts: dict[str, np.ndarray], n: np.ndarray, evidence: float, lift: float) -> dict[str, float]:
    """Weights of the listed words, less those commoner in clean rows, and of the learned ones."""
    words = list(counts)
    m = np.array([counts[w].sum(1) for w in words], float).reshape(len(words), 2)
    c, k = m[:, 0], m[:, 1]
    a, b = n.sum(1)
    base = b / (a + b)
    share = np.where(k > 0, k / np.maximum(k + c, 1), 0.5)
    with np.errstate(divide="ignore"):
        g = 2 * (k * np.log(share / base) + np.where(c > 0, c * np.log(np.where(c > 0, 1 - share, 1) / (1 - base)), 0.0))
    learned = (k >= CONTEXTS) & (k * a > lift * c * b) & (g >= evidence)
    weight = np.minimum(6.0, np.log((k + 0.5) / (b + 1)) - np.log((c + 0.5) / (a + 1)))
    out = dict.fromkeys(SEED, SEED_WEIGHT)
    for i, w in enumerate(words):
        if learned[i]:
            out[w] = float(weight[i])
        if w in SEED and c[i] * b > k[i] * a:
            del out[w]
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton with a ridge, which keeps separable rows finite."""
    b = np.zeros(4)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.02, 0.02, 0.02])
        b = b + np.linalg.solve(h, x.T @ (y - p) - np.array([0, 0.02, 0.02, 0.02]) * b)
    return b


def fitted(counts: dict[str, np.ndarray], n: np.ndarray, rows: list[tuple[list[str], int, int, int]]) -> Detector:
    """The detector of rows given as (skeleton, tokens, label, fold)."""
    if not n.sum(1).all():
        return Detector(dict.fromkeys(SEED, SEED_WEIGHT))
    y, fold = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])

    def matrix(d: Detector) -> np.ndarray:
        return np.array([(1.0, *d.measured(t, size)) for t, size, _, _ in rows])

    best = None
    for evidence, lift in GRID:
        hits = wrong = 0
        for f in range(FOLDS):
            rest = np.delete(n, f, 1)
            if not rest.sum(1).all():
                continue
            x = matrix(Detector(lexicon({w: np.delete(m, f, 1) for w, m in counts.items()}, rest, evidence, lift)))
            b = _logistic(x[fold != f], y[fold != f])
            said = 1 / (1 + np.exp(-np.clip(x[fold == f] @ b, -30, 30))) >= 0.3
            hits += int((said & (y[fold == f] == 1)).sum())
            wrong += int((said != (y[fold == f] == 1)).sum())
        quality = 2 * hits / (2 * hits + wrong) if hits else 0.0
        if best is None or quality > best[0] + 1e-9:
            best = quality, evidence, lift
    d = Detector(lexicon(counts, n, *best[1:]))
    x = matrix(d)
    b = _logistic(x, y)
    if (b[1:] @ x[:, 1:].max(0) > 0) and np.isfinite(b).all():
        d.weights = tuple(map(float, b))
    return d


def learn(rows: list[tuple[str | None, int]]) -> Detector:
    """Learns from (text, label) rows in this process."""
    folded = [(t, y, i % FOLDS) for i, (t, y) in enumerate(rows)]
    counts, before, n = counted(folded)
    words = possible(counts, {w: len(v) for w, v in before.items()}, n)
    starts = frozenset(words) | SEED | CLASSES["THREAT"]
    return fitted(words, n, [(skeleton(tokens := tokens_of(t), starts), len(tokens), y, f) for t, y, f in folded])


def train(docs: DataFrame, labels: DataFrame, by: int = 4, held: int = 2, max_rows: int = 8000) -> Detector:
    ship(docs.sparkSession)
    fold = F.pmod(F.expr(f"crc32(cast(doc_id as string)) div {by}"), F.lit(FOLDS)).cast("int")
    rows = sample(docs, labels, "toxic", by, held, max_rows).select("text", "y", fold.alias("fold"), F.col("doc_id").cast("string").alias("id"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for batch in batches:
            for part in by_bytes(batch):
                yield from zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, before, n = counted(read(batches))
        counts[""] = n
        words = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w].ravel().tolist() for w in words], pa.list_(pa.int64())), pa.array([sorted(before.get(w, ())) for w in words], pa.list_(pa.string()))], ["word", "counts", "before"])

    each = [F.sum(F.get("counts", F.lit(k))).alias(f"c{k}") for k in range(2 * FOLDS)]
    seen = rows.select("text", "y", "fold").mapInArrow(count, "word string, counts array<bigint>, before array<string>")
    seen = seen.groupBy("word").agg(*each, F.size(F.array_distinct(F.flatten(F.collect_list("before")))).alias("contexts"))
    toxic = sum(F.col(f"c{FOLDS + k}") for k in range(FOLDS))
    got = seen.filter((F.col("word") == "") | F.col("word").isin(*SEED) | (toxic >= CONTEXTS) & (F.col("contexts") >= CONTEXTS)).toArrow().to_pylist()
    table = {r["word"]: np.array([r[f"c{k}"] for k in range(2 * FOLDS)], np.int64).reshape(2, FOLDS) for r in got}
    n = table.pop("", np.zeros((2, FOLDS), np.int64))
    words = possible(table, {r["word"]: r["contexts"] for r in got}, n)
    starts = frozenset(words) | SEED | CLASSES["THREAT"]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                tokens = [tokens_of(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([skeleton(t, starts) for t in tokens], pa.list_(pa.string())), pa.array(map(len, tokens), pa.int64()), *(part.column(k) for k in (1, 2, 3))], ["tokens", "n", "y", "fold", "id"])

    reduced = rows.mapInArrow(reduce, "tokens array<string>, n bigint, y int, fold int, id string").toArrow().to_pylist()
    reduced.sort(key=lambda r: (r["id"], r["y"], r["n"], r["tokens"]))
    return fitted(words, n, [(r["tokens"], r["n"], r["y"], r["fold"]) for r in reduced])


def scored(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """(id, score) of every row."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((detector.lexicon, detector.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Detector(*held.value)
        for batch in batches:
            for part in by_bytes(batch, 1, 256):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(d.score, part.column(1).to_pylist()), pa.float64())], [id_col, out])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{out}` double")
