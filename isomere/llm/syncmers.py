"""Document fingerprints from closed syncmers, by DataFrame operations alone.

A text is cut into tokens: words of at most ``TOKEN`` characters between white
space, and within longer runs by their content alone: characters beyond ASCII
stand alone, others end at each character of ``CUT`` (only a longer run without
any is cut by length). So a character put into a text changes the tokens near
it, unspaced texts included. Each ``S`` tokens in a row are hashed. A run of ``K`` tokens is
chosen if the smallest of its inner hashes stands first or last in it: a rule
that looks at nothing outside the run, so an edit disturbs only runs that touch
it, and two texts choose the same runs in what they share. The fingerprint is
the run hashes in text order, written as eight hex digits each; texts shorter
than a run are one run. Likeness is the share of common hashes among all
hashes of two fingerprints (Jaccard), with the places left for matching by
position.

Null texts count as empty; empty texts have an empty fingerprint, and two empty
fingerprints are alike (1.0). Rows with equal ids follow each other by text;
null ids come last; ids that are no numbers are ordered as strings. Very long
texts take memory as their tokens do; an empty table gives an empty table;
other columns are dropped.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN, K, S = 16, 8, 2
CUT = "aeiouAEIOU0-4/._=&?%-"
_ASCII, _INK = r"\x00-\x08\x0E-\x1F!-\x7F", r"[^\x20\x09-\x0D]"
PATTERN = "|".join([
    rf"(?<!{_INK}){_INK}{{1,{TOKEN}}}+(?!{_INK})",
    r"[^\x00-\x7F]",
    rf"[{_ASCII}&&[^{CUT}]]{{0,{TOKEN - 1}}}+[{CUT}]",
    rf"[{_ASCII}&&[^{CUT}]]{{1,{TOKEN}}}+",
])
#: Buckets of neighbouring ids for each so many rows, at most so many.
ROWS, BUCKETS = 1000, 4096


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def fingerprint_columns(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds ``out``, the array of run hashes (32 bits each) of ``text_col``."""
    a, b, c = f"_{out}_t", f"_{out}_h", f"_{out}_i"
    step = K - S
    df = df.withColumn(a, tokens(F.col(text_col)))
    df = df.withColumn(b, F.expr(f"transform({a}, w -> xxhash64(w))"))
    df = df.withColumn(c, F.expr(f"zip_with({b}, slice({b}, 2, greatest(size({b}) - 1, 0)), (x, y) -> x ^ shiftright(y, 1))"))
    # places i (0-based) whose run of K tokens is chosen: inner hashes i .. i + K - S
    runs = F.expr(f"""
        case when size({b}) = 0 then array()
             when size({b}) < {K} then array(xxhash64({b}))
             else transform(
                 filter(sequence(0, size({b}) - {K}),
                        i -> array_min(slice({c}, i + 1, {step + 1})) in ({c}[i], {c}[i + {step}])),
                 i -> xxhash64(slice({b}, i + 1, {K})))
        end""")
    return df.withColumn(out, F.transform(runs, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))).drop(a, b, c)


def written(runs: Column) -> Column:
    """Fingerprint string of an array of run hashes."""
    return F.array_join(F.transform(runs, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of run hashes."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def _number(docs: DataFrame, id_col: str) -> Column:
    """A long in the order of the ids; strings have that of their first seven bytes."""
    if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return F.col(id_col).cast("long")
    start = F.substring(F.hex(F.col(id_col).cast("string").cast("binary")), 1, 14)
    return F.conv(F.rpad(start, 14, "0"), 16, 10).cast("long")


def with_next(docs: DataFrame, id_col: str, order_col: str, wanted: dict[str, str]) -> DataFrame:
    """Adds columns of the row that follows by descending id, after the last those of the first.

    ``wanted`` names them: column to new name. Null ids come last; equal ids
    follow each other by ``order_col``. Rows are dealt to buckets by id ranges;
    the rows of the highest id of each bucket go to the bucket above as well,
    so each bucket can look one row ahead by itself. Only the bucket bounds, at
    most ``BUCKETS`` ids, reach the driver.
    """
    key = F.coalesce(_number(docs, id_col), F.lit(-(2**63)))
    ids = docs.select(key.alias("k"))
    parts = max(1, min(BUCKETS, ids.count() // ROWS))
    cuts = sorted({*(ids.agg(F.percentile_approx("k", [k / parts for k in range(1, parts)], 100_000).alias("p")).first().p or [])}) if parts > 1 else []
    bucket = (lambda k: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < k))) if cuts else (lambda k: F.lit(0))
    tops = {r.b: r.top for r in ids.select(bucket(F.col("k")).alias("b"), "k").groupBy("b").agg(F.max("k").alias("top")).collect()}
    have = sorted(tops)
    above = {tops[b]: have[(k + 1) % len(have)] for k, b in enumerate(have)}
    ghost = F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, above)), F.array(*map(F.lit, above.values()))), F.col("_k")) if above else F.lit(None).cast("int")
    place = lambda b, g: F.struct(b.cast("int").alias("b"), F.lit(g).alias("ghost"))
    rows = docs.withColumn("_k", key).withColumn("_p", F.explode(F.array_compact(F.array(place(bucket(F.col("_k")), 0), F.when(ghost.isNotNull(), place(ghost, 1))))))
    ahead = Window.partitionBy("_p.b").orderBy("_p.ghost", F.col("_k").desc(), F.col(id_col).desc(), order_col)
    return rows.withColumns({new: F.lead(c).over(ahead) for c, new in wanted.items()}).filter("_p.ghost = 0").drop("_k", "_p")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document.

    The edited text is the first half with the start of the next document in
    place of the last half.
    """
    rows = fingerprint_columns(docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "text", "_own")
    rows = with_next(rows, id_col, "text", {"text": "_then", "_own": "_next"})
    half = "char_length(text) div 2"
    rows = rows.select(id_col, F.char_length("text").cast("long").alias("n_chars"), "_own", "_next", F.expr(f"concat(left(text, cast(char_length(text) - {half} as int)), left(_then, cast({half} as int)))").alias("edited"))
    rows = fingerprint_columns(rows, "edited", "_edit")
    return rows.select(
        id_col, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written(F.col("_own")).alias("fingerprint"), written(F.col("_edit")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edit")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )
