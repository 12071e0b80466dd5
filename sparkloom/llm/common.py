"""What the corpus operators share: tables, the shared work folder, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts may be long, so batches are kept short.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def short_batches(spark: SparkSession) -> None:
    """Keep JVM-side Arrow batches small, in rows and in bytes; only lowers the settings."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None or not 0 < int(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def work_dir(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder of the cluster (spark.checkpoint.dir).

    Where the setting is absent in a local session (tests), one is set; on a cluster its absence is an error, as no machine's own folder
    is seen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file:/tmp/sparkloom-shared-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sparkloom/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """df written as a table of the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df.stored_at)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def map_rows(df: DataFrame, schema: str, function, *columns: str) -> DataFrame:
    """function(rows of the given columns) -> rows, over Arrow batches; rows are tuples."""
    short_batches(df.sparkSession)
    out = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = function()
        for batch in batches:
            rows = each(*(c.to_pylist() for c in batch.columns))
            yield to_batch(rows, out)

    return df.select(*columns).mapInArrow(run, schema)


_held: dict = {}


def held(name: str, make):
    """A large object of a Python worker, made when it is first asked for. A worker serves one operator after another: it holds one such object at a time."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def release() -> None:
    _held.clear()


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def plain_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
