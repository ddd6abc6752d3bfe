"""Which input files could not be read. ``read_lines(..., skip_unreadable=True)`` goes on behind a broken file, keeping the
lines before the fault; this table tells what it went on from."""

from __future__ import annotations

import bz2
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .lines import existing, file_name, lenient_text

SUFFIX = r"\.(gz|bz2|zst|deflate|snappy|lz4)$"
CHECKED = ("gz", "bz2", "zst", "deflate")
CHUNK = 1 << 20
BYTE_ORDER_MARK = 3
STATUS = "file string, size bigint, status string"


def _decompressor(kind: str):
    if kind == "bz2":
        return bz2.BZ2Decompressor()
    if kind == "zst":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return zlib.decompressobj(31 if kind == "gz" else 15)


def whole(kind: str, content: bytes) -> bool:
    """Whether the compressed content can be read to its end; it may hold several members. Nothing at all is whole."""
    at, stream = 0, None
    try:
        while at < len(content):
            stream = stream or _decompressor(kind)
            chunk = content[at : at + CHUNK]
            stream.decompress(chunk)
            at += len(chunk)
            if stream.eof:
                at -= len(stream.unused_data)
                stream = None
    except Exception:  # each library has its own error for content it cannot read
        return False
    return stream is None


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        status = ["ok" if whole(k, c) else "incomplete" for k, c in zip(batch["kind"], batch["content"])]
        yield batch[["file", "size"]].assign(status=status)


def _strictly_read(spark: SparkSession, path: str) -> str:
    try:
        spark.read.text(path).write.format("noop").mode("overwrite").save()
        return "ok"
    except Exception:  # whatever stops the read is what is asked for
        return "incomplete"


def file_status(spark: SparkSession, paths: Sequence[str], content_bytes: int = 256 << 20) -> DataFrame:
    """One row per file under the paths, and per path that matches nothing: ``file``, ``size``, ``status``.

    ``missing``: nothing there. ``ok``: read to its end. ``incomplete``: reading stops before the end. ``unchecked``: packed in
    a way that cannot be tested. Plain files are compared by the bytes of their lines, in Spark's reader; packed ones are
    unpacked chunk by chunk in the task that reads them. Packed files of more than ``content_bytes`` are not held in one
    row: each of them is a strict read of its own. Files of no bytes have no row.
    """
    there = existing(spark, paths)
    absent = [(p, None, "missing") for p in paths if p not in there]
    gone = spark.createDataFrame(absent, STATUS)
    if not there:
        return gone
    files = spark.read.format("binaryFile").load(there)
    name = file_name(F.col("path"))
    kind = F.regexp_extract("path", SUFFIX, 1)
    listed = files.select(name.alias("file"), F.col("length").alias("size"), kind.alias("kind"))

    read = lenient_text(spark, there, lineSep="\n").groupBy(file_name(F.col("_metadata.file_path")).alias("file")).agg(
        F.sum(F.octet_length("value") + 1).alias("_read")
    )
    complete = F.coalesce(F.col("_read"), F.lit(0)) + BYTE_ORDER_MARK >= F.col("size")
    plain = listed.where("kind = ''").join(read, "file", "left").select(
        "file", "size", F.when(F.col("_read").isNotNull() & complete, "ok").otherwise("incomplete").alias("status")
    )
    packed = files.where(kind.isin(*CHECKED) & (F.col("length") <= content_bytes))
    tested = packed.select(name.alias("file"), F.col("length").alias("size"), kind.alias("kind"), "content").mapInPandas(_checked, STATUS)
    large = files.where(kind.isin(*CHECKED) & (F.col("length") > content_bytes)).select("path", name.alias("file"), "length").collect()
    alone = spark.createDataFrame([(r.file, r.length, _strictly_read(spark, r.path)) for r in large], STATUS)
    rest = listed.where((F.col("kind") != "") & ~F.col("kind").isin(*CHECKED)).select("file", "size", F.lit("unchecked").alias("status"))
    return gone.union(plain).union(tested).union(alone).union(rest)


def source_failures(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """The files and paths that are missing or end before their end."""
    return file_status(spark, paths, **options).where(F.col("status").isin("missing", "incomplete"))
