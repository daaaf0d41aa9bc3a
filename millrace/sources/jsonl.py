"""JSON-lines and other file sources and sinks.

Untyped lines are read as text and parsed to VARIANT, which keeps the evidence
that schema inference would rewrite; typed tables use Spark's readers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.normalize import sanitise
from millrace.sources.workers import written


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line): ``line`` rises from line to line of a file; it has gaps, as parts of files are read side by side."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return rows.withColumn("line", F.monotonically_increasing_id())


def scan_strict(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines as VARIANT; a malformed one is an error."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("v"))


def scan_tolerant(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(parsed lines, malformed lines), blank ones in neither."""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    return rows.where(F.col("v").isNotNull()).select("v"), rows.where(F.col("v").isNull()).select("value")


def read_typed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_lines(df: DataFrame, path: str, append: bool = False, safe: bool = False) -> None:
    """One JSON object for each row, nulls written; ``safe`` masks bytes and tokens first."""
    (sanitise(df) if safe else df).write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def read_array_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files that hold one JSON array each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def scan_folders(spark: SparkSession, base: str, without: str | None = None, schema: str | None = None) -> DataFrame:
    """Array files in the folders of a base, with folder and file stem as columns, one folder left out."""
    rows = read_array_file(spark, f"{base.rstrip('/')}/*/*.json", schema)
    path = F.col("_metadata.file_path")
    rows = rows.select("*", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract(path, r"([^/]+)\.json$", 1).alias("stem"))
    return rows.where(F.col("folder") != without) if without else rows


def read_by_extension(spark: SparkSession, path: str) -> DataFrame:
    """A local file by its extension; empty CSV cells stay empty texts."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext == "csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).fillna("")
    if ext in ("json", "jsonl"):
        return spark.read.option("multiLine", ext == "json").json(path)
    return spark.read.format({"txt": "text"}.get(ext, ext)).load(path)


def read_subsets(spark: SparkSession, base: str, subsets: list[str], splits: list[str], format: str = "parquet") -> DataFrame:
    """A local directory source of subsets and splits, as one table."""
    from millrace.operators.reshape import union_all

    return union_all(*[spark.read.format(format).load(f"{base.rstrip('/')}/{s}/{p}") for s in subsets for p in splits])


def write_cache(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """An encoded table kept for later runs."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_cache(spark: SparkSession, path: str, longest: int, length: str = "length") -> DataFrame:
    """A kept table without rows that are too long; a list of lengths counts by its largest. Plain lengths are filtered in the scan."""
    rows = spark.read.parquet(path)
    size = F.array_max(length) if dict(rows.dtypes)[length].startswith("array") else F.col(length)
    return rows.where(size <= longest)


def union_dicts(frames: list[DataFrame]) -> DataFrame | None:
    """Rows of any keys as one table."""
    from millrace.operators.reshape import union_all

    return union_all(*frames)


def write_two(df: DataFrame, condition: Column, passed: str, rejected: str, drop: tuple[str, ...] = ()) -> None:
    """Rows that meet a condition (without some fields) to one place and the others to another; the input is evaluated once."""
    df = written(df, "split")
    ok = F.coalesce(condition, F.lit(False))
    write_lines(df.where(ok).drop(*drop), passed)
    write_lines(df.where(~ok), rejected)


def validation_report(rejected: DataFrame, counts: DataFrame, path: str) -> None:
    """Statistics and rejected rows beside each other."""
    write_lines(counts, f"{path}/statistics")
    write_lines(rejected, f"{path}/rejected")
