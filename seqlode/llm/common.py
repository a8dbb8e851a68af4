"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Paths of the tables that ``materialize`` has written and nothing has deleted yet.
_written: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value):
    """A session setting for as long as a table is written; it is as it was afterwards."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or the one the context was given; on a local master without
    either, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='seqlode-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and a lost executor
    costs nothing that was computed before. The shuffle files of the write go as soon as the table stands; the table
    is deleted when the process ends, or before that by ``release``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqlode/{tag}-{uuid.uuid4().hex}"
    with setting(spark, _CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._seqlode_path = path
    return out


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already; the files are temporary
        return


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned; nothing may read them any more."""
    for t in tables:
        _delete(getattr(t, "_seqlode_path", ""))


@contextmanager
def scratch():
    """Tables that ``materialize`` writes inside are deleted at the end, but for those passed to what is yielded."""
    before, kept = set(_written), set()
    yield lambda t: kept.add(t._seqlode_path) or t
    for path in set(_written) - before - kept:
        _delete(path)


@atexit.register
def _clean() -> None:
    for path in list(_written):
        _delete(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _ordered(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind)
    return _ordered(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def keep_rows(docs: DataFrame, decisions: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` (name: column of ``docs``) are in ``decisions``, whose columns have those
    names; of rows that agree in all keys one stays, the first by a hash of all columns, then by the columns, however
    the rows are partitioned. Nulls agree with nulls."""
    renamed = decisions.select(*(F.col(k).alias(f"_seqlode_{k}_kept") for k in keys)).distinct()
    rows = docs.withColumns({f"_seqlode_{k}_key": c for k, c in keys.items()})
    same = [F.col(f"_seqlode_{k}_key").eqNullSafe(F.col(f"_seqlode_{k}_kept")) for k in keys]
    rows = rows.join(renamed, reduce(Column.__and__, same), "left_semi")
    # maps cannot be hashed or ordered
    whole = [c if _ordered(f.dataType) else F.to_json(F.struct(c)) for f in docs.schema for c in [F.col(f"`{f.name}`")]]
    first = F.row_number().over(Window.partitionBy(*(f"_seqlode_{k}_key" for k in keys)).orderBy(F.xxhash64(*whole), *whole))
    return rows.withColumn("_seqlode_first", first).where("_seqlode_first = 1").select(*docs.columns)


#: Rows of a batch of texts that a Python worker gets at a time, and of one of blocks of numbers.
TEXT_ROWS, BLOCK_ROWS = 1_000, 200
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Let Python workers get texts in batches of TEXT_ROWS at most, from now on in this session.

    Spark's default of 10,000 rows holds tens of megabytes of texts several times over in each worker and JVM. Spark
    reads the setting when a plan runs, which for a returned DataFrame is after the operator's call."""
    if int(spark.conf.get(_BATCH_ROWS)) > TEXT_ROWS or int(spark.conf.get(_BATCH_ROWS)) <= 0:
        spark.conf.set(_BATCH_ROWS, TEXT_ROWS)


def block_batches(spark: SparkSession):
    """Batches of BLOCK_ROWS while a table is made of rows that hold many numbers each."""
    return setting(spark, _BATCH_ROWS, BLOCK_ROWS)
