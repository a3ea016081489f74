"""Operator 2: near-duplicate embeddings by random-hyperplane sign hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, read, written
from plumbline.llm.components import components

COSINE = 0.9
#: A table has so many planes that a bucket of unrelated vectors holds about BUCKET of them, and there are so
#: many tables that a pair at the threshold itself meets in one of them with probability RECALL.
BUCKET = 512
RECALL = 0.97
#: Rows of a block; a bucket of more rows is compared block against block, in as many groups.
BLOCK = 1024
SEED = 20_011


def shape_of_tables(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(planes of a table, tables) for n distinct vectors."""
    planes = min(30, max(4, math.ceil(math.log2(max(n, 1) / BUCKET))))
    same = (1 - math.acos(cosine) / math.pi) ** planes
    return planes, math.ceil(math.log(1 - recall) / math.log(1 - same))


def rows_as_matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, start, length) of a list column without null lists, as doubles."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return values, offsets[:-1], np.diff(offsets)


def planes_of(width: int, planes: int, tables: int) -> np.ndarray:
    """The normals of all tables' planes for vectors of a width, one column each; the same everywhere, and those of fewer tables come first."""
    return np.random.default_rng([SEED, width]).standard_normal((tables * planes, width)).T


def buckets(x: np.ndarray, normals: np.ndarray, planes: int) -> np.ndarray:
    """The bucket of each row of x in each table of the normals."""
    side = (x @ normals > 0).reshape(len(x), -1, planes)
    return side @ (1 << np.arange(planes, dtype=np.int64))


def signed(vectors: DataFrame, planes: int, tables: int) -> DataFrame:
    """(node, d, sigs) of vectors(node, v): the vector's length and its bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals: dict[int, np.ndarray] = {}
        for batch in batches:
            values, start, length = rows_as_matrix(batch.column(1))
            sigs = np.zeros((batch.num_rows, tables), np.int64)
            for d in np.unique(length).tolist():
                if d not in normals:
                    normals[d] = planes_of(d, planes, tables)
                at = np.flatnonzero(length == d)
                sigs[at] = buckets(values[start[at][:, None] + np.arange(d)], normals[d], planes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sigs.size + 1, tables, dtype=np.int32)), pa.array(sigs.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length.astype(np.int32)), lists], names=["node", "d", "sigs"])

    return vectors.select("node", "v").mapInArrow(run, "node long, d int, sigs array<long>")


def compare_blocks(key: tuple, table: pa.Table, planes: int, cosine: float = COSINE) -> pa.Table:
    """Of one or two blocks of a bucket: node, links (members of the nodes linked with it that no earlier table
    has met with it) and to (a node of its component within the group). Earlier tables' buckets are computed here, so that they need not travel."""
    number, block = key[0].as_py(), table["block"].to_numpy()
    column = table["v"].combine_chunks()
    values, start, length = rows_as_matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
    x = values[start[:, None] + np.arange(length[0])]
    norm = np.sqrt((x * x).sum(1))
    node, members = table["node"].to_numpy(), table["members"].to_numpy()
    twin = key[3].as_py() != key[4].as_py()
    left, right = (np.flatnonzero(block == key[k].as_py()) for k in (3, 4))
    cos = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right])
    close = cos >= cosine
    if not twin:
        np.fill_diagonal(close, False)
    i, j = np.nonzero(close)
    label = np.arange(len(x))
    while True:  # the smallest row that is linked, until nothing changes
        now = label.copy()
        np.minimum.at(now, left[i], label[right[j]])
        np.minimum.at(now, right[j], label[left[i]])
        now = now[now]
        if (now == label).all():
            break
        label = now
    met = np.zeros(len(x), bool)
    met[left[i]] = met[right[j]] = True
    new = np.ones(len(i), bool)
    if number and met.any():
        sigs = np.zeros((len(x), number), np.int64)
        sigs[met] = buckets(x[met], planes_of(x.shape[1], planes, number), planes)
        new = (sigs[left[i]] != sigs[right[j]]).all(1)
    links = np.zeros(len(x), np.int64)
    np.add.at(links, left[i[new]], members[right[j[new]]])
    if twin:
        np.add.at(links, right[j[new]], members[left[i[new]]])
    return pa.table({"node": node[met], "links": links[met], "to": node[label[met]]})


def vector_groups(table: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of table(vec_id, embedding).

    Vectors link at a cosine of COSINE or more, in double precision; a null, empty or zero vector, or one with
    a null or non-finite component, links with nothing, nor do vectors of different lengths. component_id is
    the smallest vec_id reachable, kept says that the row's vec_id is that (a null id is its own component's only if
    no row has one, and is never kept). Equal vectors are one node with a number of members. In each table of
    buckets a pair counts only if no earlier table has met it, so that counts add up without gathering pairs;
    a group gives a row per linked node, not per pair. Large buckets are compared block by block.
    """
    good = F.col("embedding").isNotNull() & F.exists("embedding", lambda e: e != 0) & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    rows = table.select("vec_id", F.when(F.coalesce(good, F.lit(False)), F.col("embedding")).alias("v"))
    nodes = written(rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("members")).select(F.monotonically_increasing_id().alias("node"), "members", "v"))
    planes, tables = shape_of_tables(nodes.count())
    sigs = written(signed(nodes, planes, tables))
    met = sigs.select("node", "d", F.posexplode("sigs").alias("table", "bucket"))
    blocks = met.groupBy("table", "d", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("table", "d", "bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    met = met.join(blocks, ["table", "d", "bucket"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # a bucket of b blocks makes b (b + 1) / 2 groups, each of two blocks at most
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("node", "table", "d", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block")
    keys = ["table", "d", "bucket", "low", "high"]
    found = written(met.join(nodes, "node").groupBy(*keys).applyInArrow(lambda key, group: compare_blocks(key, group, planes), "node long, links long, to long"))
    discard(sigs)
    direct = found.groupBy("node").agg(F.sum("links").alias("links"))
    part = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    of = nodes.join(direct, "node", "left").join(part, "node", "left").select("v", "members", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    every = written(rows.join(of, "v", "left").select("vec_id", "members", "links", "component"))
    least = every.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = every.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return out.select("vec_id", F.coalesce(F.col("members") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and component; see vector_groups."""
    return vector_groups(read(spark, sf_dir, "embeddings"))
