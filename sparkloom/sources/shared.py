"""Tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir; in a local session without that setting (tests) one under /tmp, on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file:/tmp/sparkloom-shared-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sparkloom/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, *by: str) -> DataFrame:
    """df written as a table and read again: its lineage is cut, a lost executor costs tasks only. by: partition columns."""
    path = shared_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def parts(df: DataFrame, rows: int) -> int:
    """How many partitions of about `rows` rows df has need of, one for each core at least. Small compressed files are read by few tasks, however much their rows become."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys into partitions of about `rows` rows; groups and windows that begin with the keys need no other shuffle, and a task doesn't grow with the table."""
    return df.repartition(parts(df, rows), *keys)


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of stored tables of one schema, in one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t.stored_at for t in tables))


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def prune(df: DataFrame, column: str, before: str) -> int:
    """Deletes the partitions of a stored table (by one column, dates as yyyy-mm-dd) that are older than `before`; rows without a date stay. How many went.

    Whole folders go, nothing is read or written again; run again, it finds none. Only the folders' names pass the driver.
    """
    spark = df.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = [f.getPath() for f in fs.listStatus(root) if f.isDirectory() and (day := f.getPath().getName().removeprefix(f"{column}="))[:1].isdigit() and day < before]
    return sum(bool(fs.delete(path, True)) for path in gone)
