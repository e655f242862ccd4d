"""Sample manifests: small tables read on the driver."""
from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .bed import infer_format


class ManifestError(ValueError):
    """A manifest that cannot be used."""


@dataclass(frozen=True)
class Sample:
    sample: str
    reads: str
    group: str | None = None


def parse_manifest(path: str) -> list[Sample]:
    """Samples in file order; columns ``sample``, ``reads`` and perhaps ``group`` by name, in any case and order.

    Lines are trimmed before they are split, so a blank last column is missing;
    relative paths start at the manifest's folder.
    """
    base = os.path.dirname(path) or "."
    columns: dict[str, int] = {}
    out: list[Sample] = []
    with open(path) as f:
        for no, line in enumerate(f, 1):
            line = line.strip()
            if not line or line[0] == "#":
                continue
            cells = line.split("\t") if "\t" in line else line.split()
            cells = [c.strip() for c in cells]
            where = f"{path}:{no}"
            if not columns:
                names = [c.lower() for c in cells]
                if twice := [c for c in names if names.count(c) > 1]:
                    raise ManifestError(f"{where}: duplicate column {twice[0]!r}")
                columns = {c: k for k, c in enumerate(names)}
                for need in ("sample", "reads"):
                    if need not in columns:
                        raise ManifestError(f"{where}: missing column {need!r}")
                continue
            width = 1 + max(columns[c] for c in ("sample", "reads", "group") if c in columns)
            if len(cells) < width:
                raise ManifestError(f"{where}: too few columns, {len(cells)} of {width}")
            name, reads = cells[columns["sample"]], cells[columns["reads"]]
            if not name:
                raise ManifestError(f"{where}: empty sample name")
            if "::" in name:
                raise ManifestError(f"{where}: sample {name!r} holds '::', which parts pooled ids")
            if any(s.sample == name for s in out):
                raise ManifestError(f"{where}: duplicate sample {name!r}")
            if not reads:
                raise ManifestError(f"{where}: empty reads path for sample {name!r}")
            out.append(Sample(name, reads if os.path.isabs(reads) else os.path.join(base, reads), (cells[columns["group"]] or None) if "group" in columns else None))
    if not columns:
        raise ManifestError(f"{path}: empty manifest")
    return out


def manifest_format(records: list[Sample]) -> str:
    """The one format that all samples' names agree on; unknown names have no say."""
    known = {f for s in records if (f := infer_format(s.reads, ""))}
    if "fastq" in known:
        raise ManifestError("manifest reads cannot be FASTQ here; map them first")
    if len(known) > 1:
        raise ManifestError(f"manifest mixes formats: {', '.join(sorted(known))}")
    return known.pop() if known else "bed6"


def groups(records: list[Sample]) -> list[str]:
    """Groups in the order they first appear."""
    return list(dict.fromkeys(s.group for s in records if s.group))


def as_table(spark: SparkSession, records: list[Sample]) -> DataFrame:
    return spark.createDataFrame([(k, s.sample, s.group) for k, s in enumerate(records)], "sample_idx long, sample string, grp string")


def file_name(sample: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", sample)


def check_file_names(records: list[Sample]) -> None:
    by: dict[str, list[str]] = {}
    for s in records:
        by.setdefault(file_name(s.sample), []).append(s.sample)
    if bad := {k: v for k, v in by.items() if len(v) > 1}:
        raise ManifestError("sample names must remain unique after filename sanitization: " + "; ".join(f"{k} <- {', '.join(sorted(v))}" for k, v in sorted(bad.items())))
