"""Text files in and out: CSV, TSV, JSON lines, and writers that never leave half a table behind."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The DataFrame itself, or a ``ValueError`` that names the columns it lacks."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """Rows of CSV files with a header, quoted by ``"`` with doubled quotes inside; fields may span lines.

    Columns are taken by name: a file that lacks one is refused. Empty fields are null.
    """
    named = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    want = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    require_columns(named, want.fieldNames())
    return named.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want.fields])


def read_keyed(spark: SparkSession, path: str, schema: StructType | str, key: str, order: str, sep: str = "\t") -> DataFrame:
    """One row per key of a separated file: where a key repeats, the row with the greatest ``order`` wins."""
    rows = read_csv(spark, path, schema, sep)
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__nth", F.row_number().over(last)).where("__nth = 1").drop("__nth")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of a JSON-lines file; blank lines are skipped, a line that is no record fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes the whole new table beside the target, sets the old one aside, puts the new one in its place, drops the old one.

    No reader ever sees half a table; between the two renames there is none at the path for a moment. If the second rename
    fails the old table is put back.
    """
    spark = df.sparkSession
    staged, aside = (f"{path.rstrip('/')}.{uuid.uuid4().hex}" for _ in range(2))
    df.write.parquet(staged)
    fs, target = _fs(spark, path)
    source, old = _fs(spark, staged)[1], _fs(spark, aside)[1]
    held = fs.exists(target)
    if held and not fs.rename(target, old):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(source, target):
        if held:
            fs.rename(old, target)
        raise OSError(f"{staged} could not be renamed to {path}")
    if held:
        fs.delete(old, True)


def backup_once(spark: SparkSession, path: str, backup: str) -> bool:
    """Copies a table unless a backup is there already; whether it copied."""
    if exists(spark, backup):
        return False
    spark.read.parquet(path).write.mode("errorifexists").parquet(backup)
    return True


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key the table lacks, so that an interrupted load can be run again; how many.

    Rows with a null key are not written. Repeated keys in ``df`` are written once.
    """
    spark = df.sparkSession
    fresh = df.where(F.col(key).isNotNull()).dropDuplicates([key])
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti").select(*df.columns)
        before = spark.read.parquet(path).count()
    else:
        before = 0
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def batches(df: DataFrame, size: int = 10_000) -> Iterator[list]:
    """Rows in lists of at most ``size``; one partition at a time is on the driver."""
    held: list = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists; names of artifacts change, readers try the new name first."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(", ".join(paths))
