"""Line-oriented sources. A reader gives raw records: ``source``, ``seq``, ``received_at``, ``raw``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.normalize import is_json, with_json_text
from ..schema import SOURCE_TYPE

WHITESPACE = " \t\r\n\f\x0b"
SYSLOG_FACILITY = 1
DEFAULT_HOST = "localhost"


def source_column(kind: str, name: Column | str, channel: str | None = None, facility: int | None = None) -> Column:
    name = name if isinstance(name, Column) else F.lit(name)
    return F.struct(
        F.lit(kind).alias("kind"), name.alias("name"), F.lit(channel).alias("channel"), F.lit(facility).alias("facility")
    ).cast(SOURCE_TYPE)


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that match something; the check is left to the file system Spark uses."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()

    def found(path):
        target = hadoop.Path(path)
        hits = target.getFileSystem(conf).globStatus(target)
        return hits is not None and len(hits) > 0

    return [p for p in paths if found(p)]


def lenient_text(spark: SparkSession, paths: Sequence[str], **options: str) -> DataFrame:
    """Text lines; behind the fault of a broken file the read goes on with the next file."""
    return spark.read.options(ignoreCorruptFiles="true", ignoreMissingFiles="true", **options).text(list(paths))


def file_name(path: Column) -> Column:
    return F.regexp_replace(path, "^file:(//)?", "")


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], ignore_missing: bool = False, skip_unreadable: bool = False
) -> DataFrame:
    """Text lines with ``seq`` (line order within a file) and the file they came from.

    A missing path raises, unless ``ignore_missing`` drops it. A file that cannot be read to its end fails the job, unless
    ``skip_unreadable`` keeps the lines before the fault and goes on; ``failures.file_status`` lists such files.
    """
    paths = sorted([paths] if isinstance(paths, str) else paths)
    if ignore_missing:
        paths = existing(spark, paths)
    if not paths:
        return spark.createDataFrame([], "seq bigint, value string, file string")
    text = lenient_text(spark, paths) if skip_unreadable else spark.read.text(paths)
    return text.select(
        F.monotonically_increasing_id().alias("seq"),
        F.btrim("value", F.lit(WHITESPACE)).alias("value"),
        file_name(F.col("_metadata.file_path")).alias("file"),
    )


def _records(lines: DataFrame, source: Column, raw: Column, received_at: Column | None) -> DataFrame:
    return lines.select(
        source.alias("source"),
        "seq",
        (F.current_timestamp() if received_at is None else received_at).alias("received_at"),
        raw.alias("raw"),
    )


def number_repeats(raw: DataFrame) -> DataFrame:
    """Adds ``occurrence``: which one of the equal records of its source a record is. With it, ``normalize`` derives event
    ids from content alone, so that they do not depend on how files were split.

    Equal records are first numbered within stretches of ``seq``, then the stretches are put behind each other, so that a
    record which makes up much of a source is spread.
    """
    same = ["_content", "_stretch"]
    keyed = raw.withColumns({
        "_content": F.xxhash64("source.kind", "source.name", "raw"), "_stretch": F.shiftright("seq", 16),
    })
    near = Window.partitionBy(*same).orderBy("seq")
    ahead = Window.partitionBy("_content").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy(*same).count().select(*same, F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before"))
    numbered = keyed.withColumn("_at", F.row_number().over(near)).join(before, same)
    return numbered.select(*raw.columns, (F.col("_before") + F.col("_at")).alias("occurrence"))


def _content(lines: DataFrame) -> DataFrame:
    return lines.where((F.col("value") != "") & ~F.startswith("value", F.lit("//")))


def json_lines(lines: DataFrame) -> DataFrame:
    """The lines that hold one JSON value, without repeated keys."""
    return with_json_text(_content(lines), "value", "value").where("value is not null")


def json_records(lines: DataFrame, received_at: Column | None = None) -> DataFrame:
    """JSON lines to raw records. Empty lines, ``//`` comments and invalid JSON are left out."""
    return _records(json_lines(lines), source_column("json", F.col("file")), F.col("value"), received_at)


def bad_json_lines(lines: DataFrame) -> DataFrame:
    """The lines ``json_records`` leaves out because they are not valid JSON."""
    return _content(lines).where(~is_json(F.col("value"))).select("file", "seq", "value")


def syslog_records(
    lines: DataFrame, default_host: str = DEFAULT_HOST, received_at: Column | None = None
) -> DataFrame:
    """JSON lines pass through; any other text becomes a ``syslog`` record of the default host."""
    wrapped = F.to_json(
        F.struct(F.lit("syslog").alias("event_type"), F.col("value").alias("raw"), F.lit(default_host).alias("host"))
    )
    source = source_column("syslog", default_host, facility=SYSLOG_FACILITY)
    read = with_json_text(lines.where(F.col("value") != ""), "value", "_json")
    return _records(read, source, F.coalesce(F.col("_json"), wrapped), received_at)


def read_json_events(spark, paths, *, received_at: Column | None = None, **reading: bool) -> DataFrame:
    return json_records(read_lines(spark, paths, **reading), received_at)


def read_syslog_events(
    spark, paths, *, default_host: str = DEFAULT_HOST, received_at: Column | None = None, **reading: bool
) -> DataFrame:
    return syslog_records(read_lines(spark, paths, **reading), default_host, received_at)
