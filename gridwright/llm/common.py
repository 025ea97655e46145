"""Shared pieces: table access, written intermediates, held-out folds and components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridwright.operators.graph import shared_dir

#: White space of the contracts, for Spark's and DuckDB's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
NON_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> str:
    """The path in the shared folder at which ``df`` is written as Parquet."""
    path = f"{shared_dir(df.sparkSession)}/gridwright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later one reads."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def broadcast_up_to(side: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``side`` (a written table of narrow rows), counted: broadcast up to ``max_rows`` rows, left to a shuffled join beyond."""
    return F.broadcast(side) if side.count() <= max_rows else side


def bounded_broadcast(df: DataFrame, max_rows: int = 1_000_000, name: str = "side") -> DataFrame:
    """``df`` (narrow rows) written, then as in ``broadcast_up_to``."""
    return broadcast_up_to(written(df, name), max_rows)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows``, so that few texts are Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def widened(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with the columns of ``ddl`` after its own."""
    return StructType(df.schema.fields + StructType.fromDDL(ddl).fields)


def whole(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` as one struct ``doc`` beside ``keys``, so that no name of a caller meets one of ours; ``doc.*`` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[column.alias(name) for name, column in keys.items()])


def made_way(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``docs`` whose columns called like one of ``names`` (in any case) have underscores before them, as many as make them unlike any other."""
    taken = {c.lower() for c in docs.columns} | set(names)
    renamed = {}
    for c in docs.columns:
        if c.lower() in names:
            fresh = f"_{c}"
            while fresh.lower() in taken:
                fresh = f"_{fresh}"
            taken.add(fresh.lower())
            renamed[c] = fresh
    return docs.withColumnsRenamed(renamed)


def numbered(rows: DataFrame, key: str, row: str, number: str) -> DataFrame:
    """``rows`` (a written table, ``row`` from monotonically_increasing_id) with ``number``: 0, 1, ... among rows of equal ``key``.

    Rows alone with their key get 0 and don't move. The others are numbered task by task of ``row``,
    behind the counts of the tasks before, so rows of one key spread over as many windows as tasks
    held them. Rows of equal ``key`` are taken for interchangeable.
    """
    repeated = written(rows.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k"), "numbered-keys")
    if repeated.isEmpty():
        return rows.withColumn(number, F.lit(0).cast("long"))
    task = F.shiftrightunsigned(row, 33)
    per_task = rows.join(broadcast_up_to(repeated), F.col(key) == F.col("k"), "left_semi").groupBy(F.col(key).alias("k"), task.alias("t")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    several = written(per_task.select("k", "t", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "numbered-ahead")
    joined = rows.join(broadcast_up_to(several), (F.col(key) == F.col("k")) & (task == F.col("t")), "left")
    turn = F.row_number().over(Window.partitionBy("k", "t").orderBy(row))
    among = joined.where("k is not null").withColumn(number, F.col("ahead") + turn - 1)
    return joined.where("k is null").withColumn(number, F.lit(0).cast("long")).unionByName(among).drop("k", "t", "ahead")


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text modulo ``folds``; null where the id is null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def sample_below(key: Column, fraction: Column | float) -> Column:
    """A condition that a deterministic ``fraction`` of keys meets."""
    return F.pmod(F.xxhash64(key, F.lit(20240229)), F.lit(1 << 30)) < F.lit(float(1 << 30)) * fraction


def components(edges: DataFrame, name: str = "components", max_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges(u, v)`` as (node, label), label the least node; distributed.

    Minimum labels move over edges, and each round then follows label-of-label pointers, so a chain
    of length n takes about log n rounds. Each round is a written table that takes the place of the one
    before, so only the last is left. No links reach the driver.
    """
    spark = edges.sparkSession
    split = edges.where("u <> v").selectExpr("explode(array(struct(u, v), struct(v as u, u as v))) e").select("e.*").distinct()
    links = stored(split, f"{name}-edges")
    both = spark.read.schema(split.schema).parquet(links)
    first = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label"))
    path = stored(first, f"{name}-0")
    labels = spark.read.schema(first.schema).parquet(path)
    for step in range(1, max_rounds):
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "near").alias("at"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        made = moved.join(jump, "at", "left").select("node", "old", F.least("at", F.coalesce("further", "at")).alias("label"))
        before, path = path, stored(made, f"{name}-{step}")
        discard(spark, before)
        fresh = spark.read.schema(made.schema).parquet(path)
        labels = fresh.select("node", "label")
        if fresh.where("old <> label").isEmpty():
            discard(spark, links)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
