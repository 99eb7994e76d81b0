"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Only on one machine, as in tests, a folder of our own stands in for it."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/sparkloom-checkpoints"


def joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a whole-number key that may be hot on the left and occurs once on the right.

    The right side is often a sum by that same key. Under its own name the key would let
    the join run in the sum's partitions, which Spark can't split; through an expression
    both sides are shuffles of their own, and those of a hot key are split at run time.
    """
    right = right.withColumn("__key", F.col(key).bitwiseXOR(F.lit(0))).drop(key)
    return left.join(right, left[key] == right["__key"]).drop("__key")


def hot_keys(df: DataFrame, key: str, most: int = 1000, rows: int = 1000) -> DataFrame:
    """The keys of the most rows, `most` at most, each of over `rows`: of a size to broadcast. `df` should be a table, as it is read once more."""
    return df.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > rows).orderBy(F.desc("__n"), key).limit(most).select(key)


def salted(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, by: list[str], how: str = "inner", ways: int = 64) -> DataFrame:
    """Join on a key that may be hot on the left and occurs once on the right: left rows of the keys in `hot` are dealt over `ways` copies of the right row by the hash of the columns `by`."""
    mark = F.broadcast(hot.select(key).withColumn("__hot", F.lit(True)))
    left = left.join(mark, key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(ways)).cast("int")).otherwise(0)).drop("__hot")
    right = right.join(mark, key, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    return left.join(right, [key, "__salt"], how).drop("__salt")


#: Writer's options under which it checks sizes row by row.
BIG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/sparkloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, big: bool = False) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read again: lineage ends here, and lost executors lose nothing. big: rows of megabytes, whose size the writer checks row by row."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    df.write.options(**(BIG_ROWS if big else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def placed(table: DataFrame, name: str) -> DataFrame:
    """The rows of a Parquet table with their places in it, from 0: files by the numbers that Spark gives its parts, rows as they stand in a file. Rows that come from no table are written to one first.

    Reading alone doesn't keep that order, as Spark deals files to partitions by size. The driver holds a number for each file.
    """
    try:
        rows = table.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return placed(written(table, "placed"), name)
    ends = rows.groupBy("__file").agg(F.max("__row") + 1).collect()
    part = lambda path: int(m[1]) if (m := re.match(r"part-(\d+)", path.rsplit("/", 1)[-1])) else -1
    files, before = [], 0
    for path, n in sorted(ends, key=lambda r: (part(r[0]), r[0])):
        files.append((path, before))
        before += n
    files = table.sparkSession.createDataFrame(files, "__file string, __before long")
    return rows.join(F.broadcast(files), "__file").withColumn(name, F.col("__before") + F.col("__row")).drop("__file", "__row", "__before")


@contextlib.contextmanager
def swept(spark: SparkSession):
    """What plans that end in here leave of shuffles is deleted with their end. Spark does so since 4.1; earlier ones wait for the driver's garbage, as all do outside."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def dealt(parts: Iterable[DataFrame], name: str, key: str) -> DataFrame:
    """The rows of all parts, written one part after another to one table in the shared folder, in spark.sql.shuffle.partitions buckets by the hash of a column: grouping such tables by it moves no row again. Rows may have megabytes. The table has a name in the catalog only until it is whole."""
    table, path = f"sparkloom_{uuid.uuid4().hex}", None
    for part in parts:
        spark = part.sparkSession
        n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), path or _new_path(spark, name)
        with swept(spark):
            part.repartition(n, key).write.mode("append").format("parquet").bucketBy(n, key).options(path=path, **BIG_ROWS).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"drop table {table}")
    out._written = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dropped(table: DataFrame) -> None:
    """Deletes a table of `written` or `dealt` that nothing reads any more."""
    _delete(table.sparkSession, table._written)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written; results that are still to be read need them."""
    _delete(spark, f"{folder(spark)}/sparkloom-{spark.sparkContext.applicationId}")
