"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset in local mode (tests) a temporary folder is made and set; on a cluster that would be a folder of one machine.
    """
    sc = spark.sparkContext
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if (found := sc._jsc.sc().getCheckpointDir()).isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, outlives executors. What discard() has not deleted goes when the driver ends."""
    spark = df.sparkSession
    run = f"{shared_dir(spark)}/plumbline/{spark.sparkContext.applicationId}"
    if run not in _RUNS:
        _RUNS.add(run)
        atexit.register(_delete, spark, run)
    path = f"{run}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


_RUNS: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # still running
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables made by written() that nothing will read again."""
    for table in tables:
        if table is not None:
            _delete(table.sparkSession, table.written_path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32(doc_id as text) mod 3 is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, y): at most `limit` labelled rows outside the held-out fold, chosen by a hash of doc_id.

    Rows with a null id or label are left out; several labels of a document count as their maximum.
    The hash spreads the sample over all rows, so it does not depend on file order.
    """
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = y.orderBy(F.xxhash64(F.col("_id"), F.lit(17)), "_id").limit(limit)
    found = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    return found.join(F.broadcast(chosen), "_id").groupBy("_id", "y").agg(F.min("text").alias("text")).select("_id", "text", "y")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a written table with a column that numbers its rows, and that column's name, which docs doesn't have."""
    name = "row"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return written(docs.withColumn(name, F.monotonically_increasing_id())), name


def sample_to_driver(sample: DataFrame, *lists: str) -> tuple[list[np.ndarray], ...]:
    """The list columns and y of a bounded sample(_id, lists..., y) in order of _id, as numpy arrays without Python objects.

    A document with both labels says nothing and is left out.
    """
    table = sample.toArrow().sort_by("_id").combine_chunks()
    ids = table["_id"].to_pylist()
    alone = [i for i, x in enumerate(ids) if (i == 0 or ids[i - 1] != x) and (i + 1 == len(ids) or ids[i + 1] != x)]
    out = []
    for name in lists:
        column = pa.concat_arrays(table[name].chunks) if table[name].num_chunks else pa.array([], table[name].type)
        values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        out.append([values[offsets[i] : offsets[i + 1]] for i in alone])
    y = table["y"].to_numpy()
    return *out, y[np.array(alone, np.int64)]
