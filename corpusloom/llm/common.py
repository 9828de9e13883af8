"""Shared helpers of this subpackage: written tables that cut lineage, deterministic folds and samples, batch output."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship

_made: dict[str, tuple[SparkSession, str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application in the folder that driver and executors share."""
    key = spark.sparkContext.applicationId
    if key not in _made:
        _made[key] = (spark, f"{shared_folder(spark)}/loom-{key}-{uuid.uuid4().hex[:8]}")
    return _made[key][1]


def release() -> None:
    """Deletes the tables that written() made in this process."""
    for key, (spark, path) in list(_made.items()):
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  at exit the session may be gone
            pass
        _made.pop(key, None)


atexit.register(release)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and a lost executor costs no recomputation."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._loom_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._loom_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that nothing refers to any more, which it does after a collection.

    The last plan that was run is still referred to, so a plan without a shuffle takes its place first.
    """
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def crc_fold(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) from the columns' values, for samples that any run repeats."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def pick(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, near the given one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Ships the package; sets shorter Arrow batches than Spark's default of 10000 rows, which long texts need.

    Another setting than the default is left alone.
    """
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def table_dir(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def emit(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows as one Arrow batch, if there are any."""
    if rows:
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
