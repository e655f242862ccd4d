"""Removal of repeated passages with suffix arrays over shards.

A byte is removed if a ``WINDOW``-byte string that covers it starts anywhere
else in the corpus, in the same text or another. Equal windows hold the same
32-byte strings, so the smallest hash among those of a window says which shard
it belongs to; a text is cut into segments, runs of window starts with the same
smallest hash. Then, by tables in the shared folder:

1. segments whose hash occurs once in the corpus hold no repeated window;
2. equal segments of a hash become one string (equal by 128-bit hashes of their
   bytes), and all their windows are repeated;
3. the different strings of a hash are dealt to shards with their bytes, one
   place standing for all equal ones. A shard builds one suffix array over them
   by induced sorting, walks the permuted common prefixes over the bytes
   themselves, and marks the starts whose prefix reaches the window.

Hashes decide where a string goes and what is the same string, never which
windows of different strings are equal. A hash of more than ``HOT`` strings is
no single shard: its strings are cut by the distance of the start from the
hashed place into blocks of fewer starts, each dealt by the bytes that all its
windows share, and go through 2 and 3 again, down to single windows if need be.

Copies of a text are scanned once for each input partition, and removed whole.
Null texts are empty; texts shorter than the window lose nothing; repeated rows
each get a row; an empty table gives an empty table. Texts of any length are
read in pieces of ``BATCH`` bytes, so memory follows the longest single text
(its bytes, once or twice), not its segments. Other columns are dropped by
``removal`` and kept by ``cleaned``, whatever their names.
"""
from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, release, ship
from .batches import by_bytes
from .induced import common_prefixes, levels, mix, suffix_array

WINDOW, GRAM = 200, 32
#: Bytes scanned at once; longest run of starts in a segment; strings in a hash before it is cut; strings in a shard.
BATCH, RUN, HOT, SHARD = 1 << 16, 256, 256, 1500
BLOCKS = (64, 16, 4, 1)
#: Texts remembered in a scan task, segments in a batch.
SEEN, ROWS = 100_000, 1 << 15
_LOW = np.uint64((1 << 31) - 1)
_digest = xxhash.xxh3_128_digest


def text_key(text: Column) -> list[Column]:
    """What a text is known by: two hashes and its number of bytes."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"), F.octet_length(t).cast("long").alias("n")]


def _smallest(gram: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` hashes in a row."""
    m, k = gram, 1
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    size = len(gram) - width + 1
    return np.minimum(m[:size], m[width - k : width - k + size])


def segments(raw: bytes, ends: list[int]) -> tuple[np.ndarray, ...]:
    """(first start, last start, hash, loops) of the segments of pieces laid end to end, places counted in ``raw``.

    A segment loops if the hashed string changes its place within it: only then can its own windows be equal.
    """
    n = len(raw)
    if n < WINDOW:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(bool)
    gram = levels(np.frombuffer(raw, np.uint8), GRAM)[GRAM]
    # hash above, place below: of equal hashes the leftmost, so equal windows choose alike
    packed = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
    where = (_smallest(packed, WINDOW - GRAM + 1) & _LOW).astype(np.int64)
    inside = np.ones(n - WINDOW + 1, bool)
    for e in ends[:-1]:
        inside[max(0, e - WINDOW + 1) : e] = False
    p = np.flatnonzero(inside)
    if not len(p):
        return p, p, p.astype(np.uint64), p.astype(bool)
    place = where[p]
    m = gram[place]
    first = np.concatenate([[0], np.flatnonzero((m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1)) + 1])
    size = np.diff(np.append(first, len(p)))
    if size.max(initial=0) > RUN:
        cuts = -(-size // RUN)
        first = np.repeat(first, cuts) + RUN * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    last = np.append(first[1:], len(p)) - 1
    return p[first], p[last], m[first], place[first] != place[last]


class _Scan:
    """Collects texts in pieces of at most ``BATCH`` starts and gives rows of their segments."""

    def __init__(self) -> None:
        self.held: list[bytes] = []
        self.spots: list[tuple[int, int]] = []  # text, place of the piece in it
        self.size = 0
        self.out: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, tid: int, raw: bytes) -> None:
        for a in range(0, len(raw) - WINDOW + 1, BATCH):
            piece = raw[a : a + BATCH + WINDOW - 1]
            self.held.append(piece)
            self.spots.append((tid, a))
            self.size += len(piece)
            if self.size >= BATCH:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        raw = b"".join(self.held)
        ends = np.cumsum([len(x) for x in self.held])
        first, last, m, loops = segments(raw, ends.tolist())
        if len(first):
            which = np.searchsorted(ends, first, side="right")
            spots = np.array(self.spots, np.int64)[which]
            content = np.frombuffer(b"".join([_digest(raw[a:b]) for a, b in zip(first.tolist(), (last + WINDOW).tolist(), strict=True)]), np.int64).reshape(-1, 2)
            begin = first - (ends - [len(x) for x in self.held])[which] + spots[:, 1]
            self.out.append((spots[:, 0], m.view(np.int64), content[:, 0], content[:, 1], packed_place(begin, last - first, loops)))
            self.rows += len(first)
        self.held, self.spots, self.size = [], [], 0

    def take(self) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*self.out, strict=True)] if self.out else [np.zeros(0, np.int64)] * 5
        self.out, self.rows = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], SCANNED)


SCANNED = ["tid", "h", "s1", "s2", "at"]


def packed_place(first: np.ndarray, more: np.ndarray, loops: np.ndarray) -> np.ndarray:
    """First start, number of further starts (under 1024) and whether it loops, in one number."""
    return (first << 11) | (more << 1) | loops


def first_start(at: str = "at") -> Column:
    return F.shiftright(at, 11)


def last_start(at: str = "at") -> Column:
    return F.shiftright(at, 11) + F.shiftright(at, 1).bitwiseAND(F.lit(1023))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Segments of the texts as (tid, h, s1, s2, at), and for each row of ``docs`` one with ``at`` -1 and its key in h, s1 and s2.

    ``tid`` names a text within an input partition; a text that was seen there already has none, and no segments.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        seen: set[int] = set()
        work, count = _Scan(), 0
        for batch in batches:
            tids: list[int | None] = []
            keys = [batch.column(k) for k in range(3)]
            for part in by_bytes(batch, 3):
                fresh = []
                for i, (a, b, n) in enumerate(zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)):
                    tid, name = None, ((a & 0xFFFFFFFFFFFFFFFF) << 64 | b & 0xFFFFFFFFFFFFFFFF) * 0x100000001 + n
                    if n < WINDOW or name not in seen:
                        tid = base + count
                        count += 1
                        if n >= WINDOW:
                            seen.add(name)
                            fresh.append((i, tid))
                    tids.append(tid)
                if len(seen) > SEEN:
                    seen.clear()
                texts = part.column(3).take(pa.array([i for i, _ in fresh], pa.int64())).to_pylist()
                for (_, tid), t in zip(fresh, texts, strict=True):
                    work.add(tid, t.encode())
                    if work.rows >= ROWS:
                        yield work.take()
                work.flush()
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), *keys, pa.array(np.full(batch.num_rows, -1))], SCANNED)
            yield work.take()

    t = F.col(text_col).cast("string")
    return docs.select(*text_key(t), F.coalesce(t, F.lit("")).alias("text")).mapInArrow(run, ", ".join(f"{c} bigint" for c in SCANNED))


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    d = np.diff(hit.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1) - 1


def repeated(pieces: list[bytes]) -> list[np.ndarray]:
    """For each of different byte strings, which of its window starts are repeated among them (or within it)."""
    out = [np.zeros(max(0, len(x) - WINDOW + 1), bool) for x in pieces]
    # both halves of a repeated window are repeated: what fails this is not sorted
    text = b"\0".join(pieces)
    t = np.frombuffer(text, np.uint8)
    h64 = levels(t, 64).get(64)
    if h64 is None or len(t) < WINDOW:
        return out
    half = mix(h64[:-36], h64[36:])
    del h64
    order = np.argsort(half)
    same = half[order[1:]] == half[order[:-1]]
    twice = np.zeros(len(half), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    del half, order, same
    may = twice[: len(twice) - 100] & twice[100:]
    base = np.cumsum([0, *(len(x) + 1 for x in pieces)])
    hulls, owner, offset = [], [], []
    for k, x in enumerate(pieces):
        starts = np.flatnonzero(may[base[k] : base[k] + max(0, len(x) - WINDOW + 1)])
        if len(starts):
            hulls.append(x[starts[0] : starts[-1] + WINDOW])
            owner.append(k)
            offset.append(int(starts[0]))
    if not hulls:
        return out
    # letters: 0 ends the text, 1 parts the pieces, bytes follow
    t = np.ones(sum(map(len, hulls)) + len(hulls), np.uint16)
    t[-1] = 0
    begin = np.cumsum([0, *(len(x) + 1 for x in hulls)])
    for b, x in zip(begin, hulls, strict=False):
        t[b : b + len(x)] = np.frombuffer(x, np.uint8).astype(np.uint16) + 2
    sa = suffix_array(t, 258)
    phi, shared = common_prefixes(t, sa, WINDOW)
    hit = shared >= WINDOW
    hit[phi[hit]] = True
    for b, x, k, o in zip(begin, hulls, owner, offset, strict=False):
        m = len(x) - WINDOW + 1
        out[k][o : o + m] |= hit[b : b + m]
    return out


def _solve(group: pa.Table) -> pa.Table:
    """One shard: different strings; gives the repeated starts of those that stand for one place only."""
    tid, first, lone = (group[c].to_numpy() for c in ("tid", "first", "lone"))
    rows: list[tuple[np.ndarray, ...]] = []
    gc.disable()  # lists of names by the hundred thousand, none of them cyclic
    try:
        for k, hit in enumerate(repeated(group["data"].to_pylist())):
            if lone[k]:
                a, b = _runs(hit)
                if len(a):
                    rows.append((np.full(len(a), tid[k]), first[k] + a, first[k] + b))
    finally:
        gc.enable()
    cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 3
    return pa.table([pa.array(c, pa.int64()) for c in cols], names=["tid", "lo", "hi"])


PIECES = ["tid", "first", "lone", "h", "gram", "data", "s1", "s2"]
_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
_SCHEMA = "tid bigint, first bigint, lone boolean, h bigint, gram bigint, data binary, s1 bigint, s2 bigint"


def _content(data: bytes) -> tuple[int, int]:
    d = _digest(data)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _batch(out: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _cut(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Cuts strings into blocks of at most ``block`` starts at a fixed distance from the hashed place.

    Blocks that are equal within a string are given once, and marked at once:
    a row without data is a run of repeated starts.
    """
    for batch in batches:
        for part in by_bytes(batch, 5, 256):
            out: list[tuple] = []
            for tid, at, lone, h, gram, data in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
                t = np.frombuffer(data, np.uint8)
                m = len(t) - WINDOW + 1
                lv = levels(t, GRAM)[GRAM].view(np.int64)
                where = np.where(lv == gram, np.arange(len(lv)), len(lv) + WINDOW)
                o = np.minimum.accumulate(where[::-1])[::-1][:m] - np.arange(m)
                new = np.flatnonzero((o[1:] // block != o[:-1] // block) | (o[1:] != o[:-1] - 1)) + 1
                seen: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
                for a, b in zip([0, *new.tolist()], [*new.tolist(), m], strict=True):
                    # what the windows of a full block at this distance share, so that it depends on them alone
                    q, j = a + int(o[a]), int(o[a]) // block * block
                    core = data[q - j : q - j - block + 1 + WINDOW]
                    name = hashlib.blake2b(core, digest_size=8, salt=j.to_bytes(8, "little"), key=(h & (1 << 64) - 1).to_bytes(8, "little")).digest()
                    seen.setdefault((name, data[a : b - 1 + WINDOW]), []).append((a, b))
                hit = np.zeros(m, bool)
                for (name, piece), spots in seen.items():
                    out.append((tid, at + spots[0][0], lone, int.from_bytes(name, "little", signed=True), gram, piece, *_content(piece), None))
                    if len(spots) > 1:
                        for a, b in spots:
                            hit[a:b] = True
                if lone:
                    out += [(tid, at + int(a), True, None, None, None, None, None, at + int(b)) for a, b in zip(*_runs(hit), strict=True)]
            yield _batch(out, [*PIECES, "last"], [*_KINDS, pa.int64()])


def _sweep(spark) -> None:
    """Lets Spark drop the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _fold(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marks, strings in few kinds, strings in many) of pieces: equal ones of a hash become one and are marked where they stood for one place."""
    kinds = durable(df.groupBy("h", "s1", "s2").agg(F.count("*").alias("c"), F.first("data").alias("data"), F.first("gram").alias("gram"), F.min(F.struct("tid", "first", "lone")).alias("one")), "repeats-kinds")
    twice = df.filter("lone").join(kinds.filter("c > 1").select("h", "s1", "s2"), ["h", "s1", "s2"])
    marked = durable(twice.select("tid", F.col("first").alias("lo"), (F.col("first") + F.octet_length("data") - WINDOW).alias("hi")), "repeats-twice")
    many = durable(kinds.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "repeats-many")
    left = durable(kinds.join(many, "h").select("one.tid", "one.first", (F.col("one.lone") & (F.col("c") == 1)).alias("lone"), "h", "gram", "data", (F.col("kinds") > HOT).alias("hot")), "repeats-left")
    release(kinds)
    return marked, left.filter("not hot").drop("hot"), left.filter("hot").drop("hot")


def _shards(df: DataFrame) -> DataFrame:
    shards = max(1, df.count() // SHARD)
    dealt = df.select("tid", "first", "lone", "data", F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"))
    return durable(dealt.groupBy("shard").applyInArrow(_solve, "tid bigint, lo bigint, hi bigint"), "repeats-marks")


def _strings(docs: DataFrame, text_col: str, asked: DataFrame) -> DataFrame:
    """The bytes of the places in ``asked``: k1, k2, n, and asked, an array of (tid, at, lone, h, hot)."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(*text_key(F.col(text_col)), t.alias("text")).filter(F.col("n") >= WINDOW)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in by_bytes(batch, 2, 64):
                out: list[tuple] = []
                for k1, k2, text, want in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (k1, k2) in seen:
                        continue
                    seen.add((k1, k2))
                    raw = text.encode()
                    for w in want:
                        first = w["at"] >> 11
                        d = raw[first : first + (w["at"] >> 1 & 1023) + WINDOW]
                        out.append((w["tid"], first, w["lone"], w["h"], w["h"], d, 0, 0, w["hot"]))
                        if len(out) >= ROWS // 4:
                            yield _batch(out, [*PIECES, "hot"], [*_KINDS, pa.bool_()])
                            out = []
                if len(seen) > SEEN:
                    seen.clear()
                yield _batch(out, [*PIECES, "hot"], [*_KINDS, pa.bool_()])

    return texts.join(asked, ["k1", "k2", "n"]).select("k1", "k2", "text", "asked").mapInArrow(take, _SCHEMA + ", hot boolean")


def marks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(k1, k2, n, lo, hi): runs of repeated window starts of each text; runs may overlap."""
    spark = docs.sparkSession
    found = durable(scan(docs, text_col), "repeats-scan")
    texts = found.filter("at < 0").select("tid", F.col("h").alias("k1"), F.col("s1").alias("k2"), F.col("s2").alias("n")).filter(F.col("n") >= WINDOW)
    copies = durable(texts.groupBy("k1", "k2", "n").agg(F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "repeats-copies")
    rows = found.filter("at >= 0")
    # hashes that occur more than once, or perhaps within one segment
    live = durable(rows.groupBy("h").agg(F.sum(F.lit(1) + F.col("at").bitwiseAND(F.lit(1))).alias("c")).filter("c > 1").select("h"), "repeats-hashes")
    rows = durable(rows.join(live, "h").select(*SCANNED), "repeats-live")
    _sweep(spark)
    kinds = durable(rows.groupBy("h", "s1", "s2").agg(F.count("*").alias("c"), F.min(F.struct("tid", "at")).alias("one")), "repeats-strings")
    of_hash = durable(kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.max(F.when(F.col("c") == 1, F.col("one.at").bitwiseAND(F.lit(1))).otherwise(0)).alias("loops")).filter("kinds > 1 or loops = 1"), "repeats-uneven")
    twice = rows.join(kinds.filter("c > 1").select("h", "s1", "s2"), ["h", "s1", "s2"]).select("tid", first_start().alias("lo"), last_start().alias("hi"))
    solved = [durable(twice, "repeats-twice")]
    want = kinds.join(of_hash, "h").select("one.tid", "one.at", (F.col("c") == 1).alias("lone"), "h", (F.col("kinds") > HOT).alias("hot"))
    asked = durable(want.join(texts, "tid").groupBy("k1", "k2", "n").agg(F.collect_list(F.struct("tid", "at", "lone", "h", "hot")).alias("asked")), "repeats-asked")
    pieces = durable(_strings(docs, text_col, asked), "repeats-pieces")
    _sweep(spark)
    solved.append(_shards(pieces.filter("not hot")))
    hot = pieces.filter("hot").drop("hot")
    for block in BLOCKS:
        if hot.isEmpty():
            break
        cut = durable(hot.select(*PIECES[:6]).mapInArrow(lambda it, b=block: _cut(it, b), _SCHEMA + ", last bigint"), "repeats-cut")
        solved.append(cut.filter("data is null").select("tid", F.col("first").alias("lo"), F.col("last").alias("hi")))
        marked, few, hot = _fold(cut.filter("data is not null").drop("last"))
        solved += [marked, _shards(few)]
        _sweep(spark)
    out = solved[0]
    for x in solved[1:]:
        out = out.unionByName(x)
    # copies lose everything, so other runs of theirs are not needed
    of_text = out.join(texts, "tid").join(copies, ["k1", "k2", "n"], "left_anti").select("k1", "k2", "n", "lo", "hi")
    return of_text.unionByName(copies.withColumns({"lo": F.lit(0).cast("long"), "hi": F.col("n") - WINDOW}))


def _spans(runs: list[dict], n: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges from runs of starts."""
    out: list[list[int]] = []
    for a, b in sorted((r["lo"], r["hi"] + WINDOW) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n)) for a, b in out]


def _kept(text: str | None, runs: list[dict] | None) -> tuple[bytes, int, int, int]:
    raw = (text or "").encode()
    spans = _spans(runs or [], len(raw))
    if not spans:
        return raw, len(raw), 0, 0
    at, parts = 0, []
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    kept = b"".join(parts)
    return kept, len(raw), len(raw) - len(kept), len(spans)


def _marked(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(text, runs, row): the columns ``keep`` are packed in one, so that no name can clash."""
    runs = marks(docs, text_col).groupBy("k1", "k2", "n").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    runs = durable(runs, "repeats-runs")
    _sweep(docs.sparkSession)
    rows = docs.select(*text_key(F.col(f"`{text_col}`")), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"))
    return rows.join(runs, ["k1", "k2", "n"], "left").select("text", "runs", "row")


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 0, 256):
                got = [(len(kept), n, cut, spans, hashlib.sha256(kept).hexdigest()) for kept, n, cut, spans in map(_kept, part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(2).field(0), *(pa.array([g[k] for g in got], pa.int64()) for k in (1, 2, 3)), pa.array([g[4] for g in got], pa.string())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _marked(docs, text_col, [id_col]).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut from the text; a character cut in part goes whole, and ``n_chars`` follows."""
    names = docs.columns
    others = [c for c in names if c != text_col]
    counted = others.index("n_chars") if "n_chars" in others else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, 0, 256):
                texts = [t if not r else _kept(t, r)[0].decode(errors="ignore") for t, r in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                cols = [part.column(2).field(k) for k in range(len(others))]
                if counted >= 0:
                    cols[counted] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols[counted].type)
                cols.insert(names.index(text_col), pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    return _marked(docs, text_col, others).mapInArrow(run, docs.schema)
