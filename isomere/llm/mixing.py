"""Mixing sources to target weights, by DataFrame operations alone.

Each source gets a target of words: its share of the whole by weight, at most
``epochs`` times its size, what is above being shared out anew by weight until
none is above. Sainte-Lague apportionment then deals the mix out in blocks of
``BLOCK`` words: first to the sources, each block to the highest quotient
target / (2 blocks + 1); then, within a source, to its shards by their sizes.
Only seats near the cut are listed, about three for each party, since a quota
lies within half a seat of target / divisor.

A shard lays its documents in a row, in the order of a seeded hash, and cuts
the row into blocks. With a quota of q and n blocks every block is taken
q div n times, and q mod n blocks once more: those where
floor((j q' + o) / n) steps, spread evenly over the hashed order from a seeded
start o. The words taken of a document follow from its place in closed form.

Null texts have no words; the null source is a source like others, after all
others; documents without words are taken with 0 words; equal rows are placed
next to each other; an empty table gives an empty table. Very long texts are
counted whole and never split over shards; ``texts`` holds the words of a text
that is taken in part in one array. ``texts`` keeps all columns, whatever their
names: they are packed into one while the mix is planned.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import durable, small

BLOCK, SHARD_WORDS, FINE = 16, 32_768, 16_384
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(id, source, size, place) of each row, and the columns ``keep`` packed in ``row``."""
    place = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"))
    packed = [] if keep is None else [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")]
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size"), place.alias("place"), *packed)


def _fine() -> Column:
    return F.conv(F.substring("place", 1, 8), 16, 10).cast("long") % FINE


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """(source, source_size) with sid, target and shards added; one row per source."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("_ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    df = sources.withColumn("sid", F.row_number().over(by_name)).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    df = df.withColumns({"_cap": F.col("source_size") * epochs, "_all": F.sum("source_size").over(everything), "_ws": F.sum("_w").over(everything)})
    df = df.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    level = (F.col("_all") * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(fill), F.lit(0))) / (F.col("_ws") - F.coalesce(F.sum("_w").over(fill), F.lit(0)))
    df = df.withColumn("_full", F.col("_ratio") <= level)
    full = lambda c: F.sum(F.when(F.col("_full"), F.col(c)).otherwise(0)).over(everything)
    rest = F.col("_w") * ((F.col("_all") * F.lit(float(share)) - full("_cap")) / F.nullif(F.col("_ws") - full("_w"), F.lit(0)))
    bits = F.length(F.bin(F.expr(f"(source_size - 1) div {SHARD_WORDS}")))
    return df.select(
        "source", "source_size", "sid",
        F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(rest).alias("target"),
        F.floor(F.col("_all") * F.lit(float(share)) / BLOCK + 0.5).alias("blocks"),
        F.when(F.col("source_size") <= SHARD_WORDS, F.lit(1)).otherwise(F.least(F.lit(FINE), F.pow(F.lit(2.0), bits).cast("long"))).alias("shards"),
    )


def apportion(parties: DataFrame, weight: str, seats: str, within: list[str], key: str, out: str) -> DataFrame:
    """Sainte-Lague: adds ``out``, the seats of each party.

    ``seats`` (the same for all parties of a group ``within``) go one by one to
    the party with the highest weight / (2 k - 1), k being its next seat; equal
    quotients go to the lower ``key``.
    """
    group = Window.partitionBy(*within)
    df = parties.withColumns({"_sum": F.sum(F.col(weight).cast("double")).over(group), "_n": F.sum((F.col(weight) > 0).cast("long")).over(group)})
    even = F.col(weight) * F.col(seats) / F.nullif(F.col("_sum"), F.lit(0.0))
    slack = F.col("_n") / (2.0 * F.greatest(F.col(seats), F.lit(1)))
    live = (F.col(weight) > 0) & (F.col(seats) > 0)
    df = df.withColumns({
        "_low": F.when(live, F.greatest(F.lit(0), F.floor(even * (1 - slack) - 0.5))).otherwise(0).cast("long"),
        "_high": F.when(live, F.ceil(even * (1 + slack) + 0.5) + 1).otherwise(0).cast("long"),
    })
    df = df.withColumn("_left", F.col(seats) - F.sum("_low").over(group))
    listed = df.filter(F.col("_high") > 0).select(*within, key, weight, "_left", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    first = Window.partitionBy(*within).orderBy((F.col(weight) / (2 * F.col("_k") - 1)).desc(), key, "_k")
    won = listed.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= F.col("_left")).groupBy(*within, key).agg(F.count("*").alias("_more"))
    return df.join(won, [*within, key], "left").withColumn(out, F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_sum", "_n", "_low", "_high", "_left", "_more")


def plan(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """The rows of ``sized`` with source_size, target, taken and what ``texts`` needs to cut the text."""
    fine = durable(rows.groupBy("source", _fine().alias("fine")).agg(F.sum("size").alias("words")), "mix-sizes")
    source = durable(targets(fine.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs), "mix-sources")
    given = durable(apportion(source.withColumn("_one", F.lit(1)), "target", "blocks", ["_one"], "sid", "quota"), "mix-quotas")
    shards = (
        fine.join(small(given), fine["source"].eqNullSafe(given["source"]))
        .groupBy("sid", (F.col("fine") % F.col("shards")).alias("shard"))
        .agg(F.sum("words").alias("_words"), F.first("quota").alias("quota"), F.first(given["source"]).alias("_name"))
    )
    parts = durable(
        apportion(shards, "_words", "quota", ["sid"], "shard", "_q")
        .withColumn("nb", F.expr(f"(_words + {BLOCK - 1}) div {BLOCK}"))
        .withColumn("_q", F.least("_q", epochs * F.col("nb")))
        .select(
            "sid", "shard",
            F.when(F.col("nb") > 0, F.expr("_q div nb")).otherwise(0).alias("base"), F.when(F.col("nb") > 0, F.col("_q") % F.col("nb")).otherwise(0).alias("r"), F.greatest("nb", F.lit(1)).alias("nb"),
            (F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(SEED), F.coalesce("_name", F.lit("")), F.col("shard").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % F.greatest("nb", F.lit(1))).alias("o"),
        ),
        "mix-shards",
    )
    named = source.select(F.col("source").alias("_name"), "sid", "source_size", "target", "shards")
    placed = rows.join(small(named), F.col("source").eqNullSafe(F.col("_name"))).withColumn("shard", _fine() % F.col("shards"))
    before = Window.partitionBy("sid", "shard").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    out = placed.join(parts, ["sid", "shard"])
    extra = lambda x: f"({BLOCK} * (((({x}) div {BLOCK}) * r + o) div nb) + (({x}) % {BLOCK}) * (((({x}) div {BLOCK} + 1) * r + o) div nb - ((({x}) div {BLOCK}) * r + o) div nb))"
    return out.withColumn("extra", F.expr(f"{extra('at + size')} - {extra('at')}")).withColumn("taken", F.expr("base * size + extra"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken. The texts are read once, for their sizes."""
    rows = durable(sized(docs, id_col, text_col, source_col), "mix-rows")
    return plan(rows, **options).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = 2, **options) -> DataFrame:
    """The mix itself: for each document and pass a row with the words taken, in the columns of ``docs``.

    A pass that takes the whole document keeps its text as it is; one that takes
    some of its blocks keeps their words with the white space after them.
    """
    text = F.col(f"row.`{text_col}`")
    full = plan(sized(docs, id_col, text_col, source_col, docs.columns), epochs=epochs, **options)
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    full = full.withColumn("words", F.when((F.col("extra") > 0) & (F.col("extra") < F.col("size")), words))
    cut = F.array_join(F.expr(f"filter(words, (w, i) -> (((at + i) div {BLOCK} + 1) * r + o) div nb > (((at + i) div {BLOCK}) * r + o) div nb)"), "")
    some = F.when(F.col("extra") == F.col("size"), text).when(F.col("extra") > 0, cut)
    passes = F.array(*(F.when(F.col("base") >= p, text).when(F.col("base") == p - 1, some) for p in range(1, epochs + 1)))
    out = full.filter("taken > 0").select("row", F.explode(passes).alias("pass")).filter(F.col("pass").isNotNull())
    new = {text_col: F.col("pass")} | ({"n_chars": F.length("pass").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
