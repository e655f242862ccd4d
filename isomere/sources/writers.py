"""Ordered text outputs: single files, or folders of ordered parts.

Tables stay distributed until here; ``lines`` streams the sorted rows through
the driver one partition at a time, ``write_parts`` writes them from the
executors.
"""
from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def six(x: float | None) -> str:
    """Six decimals, exact halves to even."""
    return "%.6f" % x


def write_lines(path: str, lines: Iterable[str], header: str | None = None) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        if header is not None:
            f.write(header + "\n")
        for line in lines:
            f.write(line + "\n")


def lines(df: DataFrame, order: list, *cols: str, sep: str = "\t", scores: tuple[str, ...] = ()) -> Iterable[str]:
    """The columns of sorted rows, joined; columns in ``scores`` get six decimals."""
    for r in df.orderBy(*order).toLocalIterator():
        yield sep.join(six(r[c]) if c in scores else str(r[c]) for c in cols)


def text(df: DataFrame, *cols: str, sep: str = "\t", scores: tuple[str, ...] = ()) -> DataFrame:
    """(value): the same lines, made on the executors."""
    names = list(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(["%.6f" % x for x in c.to_pylist()] if n in scores else map(str, c.to_pylist()) for n, c in zip(names, batch.columns, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(map(sep.join, rows), pa.string())], ["value"])

    return df.select(*cols).mapInArrow(run, "value string")


def write_parts(folder: str, df: DataFrame, order: list, *cols: str, sep: str = "\t", scores: tuple[str, ...] = ()) -> None:
    """The lines as text files of a folder, each sorted, whose names are in the order of their lines. The folder must not exist."""
    text(df.repartitionByRange(*order).sortWithinPartitions(*order), *cols, sep=sep, scores=scores).write.text(folder)


def bed6(df: DataFrame, name: str, order: list, score: str | None = None) -> Iterable[str]:
    for r in df.orderBy(*order).toLocalIterator():
        yield "\t".join(map(str, (r["contig"], r["start"], r["end"], r[name], r[score] if score else 0, r["strand"])))


def bed12_line(chrom: Column, start: Column, end: Column, name: Column, score: Column, strand: Column, sizes: Column, starts: Column, count: Column, *extra: Column) -> Column:
    """A BED12 line with the whole span thick and colour 0."""
    return F.concat_ws("\t", chrom, start.cast("string"), end.cast("string"), name, score.cast("string"), strand, start.cast("string"), end.cast("string"), F.lit("0"), count.cast("string"), sizes, starts, *extra)


def write_transcripts(path: str, df: DataFrame) -> None:
    """BED12 rows of parsed transcripts (see ``sources.bed.parse_bed12``), in the order chrom, start, end, name."""
    text = lambda f: F.concat(F.array_join(F.transform("exons", f), ","), F.lit(","))
    line = F.concat_ws(
        "\t", "chrom", F.col("tx_start").cast("string"), F.col("tx_end").cast("string"), "name", F.col("score").cast("string"), "strand", F.col("thick_start").cast("string"), F.col("thick_end").cast("string"), "item_rgb",
        F.size("exons").cast("string"), text(lambda x: (x["end"] - x["start"]).cast("string")), text(lambda x: (x["start"] - F.col("tx_start")).cast("string")), F.col("extra"),
    )
    write_lines(path, (r.line for r in df.select("chrom", "tx_start", "tx_end", "name", line.alias("line")).orderBy("chrom", "tx_start", "tx_end", "name").toLocalIterator()))


def number_text(x: float) -> str:
    """A count without a needless fraction: 2, 1.5."""
    return str(int(x)) if x == int(x) else repr(x)


def write_read_isoforms(path: str, df: DataFrame) -> None:
    """(read, isoform) pairs as two tab-parted columns, sorted."""
    write_lines(path, lines(df, ["read", "isoform"], "read", "isoform"))


def write_counts(path: str, df: DataFrame) -> None:
    """(isoform_id, count) as CSV; whole counts without a fraction."""
    write_lines(path, (f"{r.isoform_id},{number_text(r['count'])}" for r in df.orderBy("isoform_id").toLocalIterator()), "isoform_id,count")
