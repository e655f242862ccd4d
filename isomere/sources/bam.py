"""Mapped reads of BAM files as BED6 rows, decoded on the executors."""
from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

UNMAPPED, REVERSE, SECONDARY, SUPPLEMENTARY = 0x4, 0x10, 0x100, 0x800
#: CIGAR operations by number are MIDNSHP=X; those that move along the reference, and the skip.
ON_REFERENCE, SKIP = (0, 2, 3, 7, 8), 3
ROWS, PIECE = 50_000, 1 << 16


def inflate(data: bytes) -> Iterator[bytes]:
    """The blocks of a BGZF file, which are gzip members one after another, each with its size in the extra field.

    A block is sliced without copying the rest, so the time is proportional to
    the file; a member without a size, of a plain gzip file, is fed piece by piece.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        if (size := _block_size(view, at)) is not None:
            if at + size > len(view):
                raise ValueError("truncated BGZF block")
            yield zlib.decompress(view[at : at + size], 31)
            at += size
            continue
        d = zlib.decompressobj(31)
        while not d.eof:
            if at >= len(view):
                raise ValueError("truncated gzip member")
            piece = view[at : at + PIECE]
            if block := d.decompress(piece):
                yield block
            at += len(piece) - len(d.unused_data)


def _block_size(view: memoryview, at: int) -> int | None:
    """The size of the member that begins here, from the BC entry of its extra field."""
    if len(view) - at < 18 or bytes(view[at : at + 3]) != b"\x1f\x8b\x08" or not view[at + 3] & 4:
        return None
    field, end = at + 12, at + 12 + int.from_bytes(view[at + 10 : at + 12], "little")
    while field + 4 <= min(end, len(view)):
        size = int.from_bytes(view[field + 2 : field + 4], "little")
        if bytes(view[field : field + 2]) == b"BC" and size == 2:
            return int.from_bytes(view[field + 4 : field + 6], "little") + 1
        field += 4 + size
    return None


class _Stream:
    """Reads exact numbers of bytes from blocks."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held, self.at = blocks, b"", 0  # what is held is at most a record and a block

    def take(self, n: int, end_ok: bool = False) -> bytes | None:
        while len(self.held) - self.at < n:
            block = next(self.blocks, None)
            if block is None:
                if end_ok and self.at == len(self.held):
                    return None
                raise ValueError("truncated BAM")
            self.held, self.at = self.held[self.at :] + block, 0
        out = self.held[self.at : self.at + n]
        self.at += n
        return out


def records(data: bytes) -> Iterator[tuple]:
    """(chrom, start, end, name, score, strand) of primary, mapped, unspliced records."""
    s = _Stream(inflate(data))
    if s.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    s.take(struct.unpack("<i", s.take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        names.append(s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode())
        s.take(4)
    while (head := s.take(4, end_ok=True)) is not None:
        body = s.take(struct.unpack("<i", head)[0])
        ref, pos, name_len, mapq, _, n_cigar, flag = struct.unpack_from("<iiBBHHH", body)
        if flag & (UNMAPPED | SECONDARY | SUPPLEMENTARY) or ref < 0 or pos < 0:
            continue
        ops = [(c & 15, c >> 4) for c in struct.unpack_from(f"<{n_cigar}I", body, 32 + name_len)]
        if any(op == SKIP for op, _ in ops):
            continue
        size = sum(n for op, n in ops if op in ON_REFERENCE)
        if size == 0:
            continue
        name = body[32 : 31 + name_len].decode()
        yield names[ref], pos, pos + size, name if name not in ("", "*") else ".", 0 if mapq == 255 else mapq, "-" if flag & REVERSE else "+"


NAMES = ["chrom", "start", "end", "name", "score", "strand"]
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]


def decode(files: DataFrame) -> DataFrame:
    """chrom, start, end, name, score, strand of BAM files in the column ``content``, in pieces of bounded size."""
    ship(files.sparkSession)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                for r in records(data.as_py()):
                    rows.append(r)
                    if len(rows) == ROWS:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    return files.select("content").mapInArrow(run, "chrom string, start long, end long, name string, score long, strand string")


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """The reads of BAM files, one task for each file."""
    return decode(spark.read.format("binaryFile").load(path))


def packed(reads: DataFrame) -> DataFrame:
    """(content): reads as BAM files, one for each contig, bucket and Arrow group; of every ninth read a spliced and an unmapped record are added.

    The inverse of ``decode`` but for strands other than minus, which BAM writes as plus.
    """
    ship(reads.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        rows = []
        for r in group.select(["start", "end", "id", "strand"]).to_pylist():
            row = dict(name=r["id"], flag=16 if r["strand"] == "-" else 0, ref=0, pos=r["start"], mapq=len(r["id"]) % 60, cigar=[(0, 100), (1, 5), (0, r["end"] - r["start"] - 100)])
            rows.append(row)
            if len(r["id"]) % 9 == 0:
                rows += [row | {"cigar": [(0, 50), (3, 10), (0, 50)]}, row | {"flag": 4}]
        return pa.table({"content": pa.array([bam_bytes([(group["contig"][0].as_py(), 1 << 28)], rows)], pa.binary())})

    bucket = F.pmod(F.xxhash64("id"), F.lit(32))
    return reads.filter("end - start > 100").select("contig", "start", "end", "id", "strand", bucket.alias("bucket")).groupBy("contig", "bucket").applyInArrow(run, "content binary")


def sorted_bed(df: DataFrame) -> DataFrame:
    return df.orderBy("chrom", "start", "end", F.col("strand"), "name")


def bam_bytes(references: list[tuple[str, int]], rows: list[dict]) -> bytes:
    """A BAM file of rows with name, flag, ref, pos, mapq and cigar [(op, n)]."""
    out = io.BytesIO()
    out.write(b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(references)))
    for name, size in references:
        out.write(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size))
    for r in rows:
        name = r["name"].encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", r["ref"], r["pos"], len(name), r["mapq"], 0, len(r["cigar"]), r["flag"], 0, -1, -1, 0)
        body += name + b"".join(struct.pack("<I", n << 4 | op) for op, n in r["cigar"])
        out.write(struct.pack("<i", len(body)) + body)
    data, blocks = out.getvalue(), []
    for k in range(0, len(data), 60_000):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        part = data[k : k + 60_000]
        body = c.compress(part) + c.flush()
        blocks.append(b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(blocks)


def write_bam(path: str, references: list[tuple[str, int]], rows: list[dict]) -> None:
    with open(path, "wb") as f:
        f.write(bam_bytes(references, rows))
