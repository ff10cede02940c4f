"""Scratch tables in the shared folder, fixed-size bitmaps and connected components.

Scratch tables live in a database whose location is the folder in ``spark.checkpoint.dir``. An operator drops those it
has finished with; those that its lazy result still reads belong to the owner that was set by ``owned`` and go with
``release(owner)``, or else stay as long as the folder does.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAP_BITS = 26
_databases: dict[str, str] = {}
_owners: list[str] = [""]
_tables: dict[str, list[str]] = defaultdict(list)


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where none is set (local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at


def _database(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _databases:
        name = f"dealscope_{uuid.uuid4().hex[:12]}"
        spark.sql(f"create database {name} location '{scratch(spark)}/{name}'")
        _databases[app] = name
    return _databases[app]


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    name = f"{_database(spark)}.t{uuid.uuid4().hex}"
    df.write.saveAsTable(name)
    _tables[_owners[-1]].append(name)
    out = spark.table(name)
    out.scratch_name = name
    return out


def drop(*stored_tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for t in stored_tables:
        t.sparkSession.sql(f"drop table if exists {t.scratch_name}")
        for names in _tables.values():
            if t.scratch_name in names:
                names.remove(t.scratch_name)


@contextlib.contextmanager
def owned(owner: str):
    """Tables stored inside belong to ``owner``."""
    _owners.append(owner)
    try:
        yield
    finally:
        _owners.pop()


def release(spark: SparkSession, owner: str) -> None:
    """Delete the owner's scratch tables: its results have been written, or are no longer wanted."""
    for name in _tables.pop(owner, []):
        spark.sql(f"drop table if exists {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bitmap(hashes: DataFrame, column: str = "h", bits: int = MAP_BITS) -> np.ndarray:
    """One bit per hash, 2 ** bits bits whatever the input: lets through every hash of the table, and some others."""
    slot = F.shiftrightunsigned(F.col(column), 6).bitwiseAND(F.lit((1 << (bits - 6)) - 1)).cast("int")
    words = hashes.select(slot.alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return out


def in_bitmap(known: np.ndarray, h: np.ndarray, bits: int = MAP_BITS) -> np.ndarray:
    word = known[((h >> np.uint64(6)) & np.uint64((1 << (bits - 6)) - 1)).astype(np.int64)]
    return (word >> (h & np.uint64(63))) & np.uint64(1) > 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that links reach.

    Each round hooks every node and its current root onto the smallest root
    next to it, then jumps pointers, so long chains shrink geometrically; labels only
    fall, so it ends. Only nodes with links are listed. Labels are stored in the shared folder each round.
    """
    edges = stored(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct())
    both = edges.union(edges.select(F.col("b"), F.col("a")))
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        # smallest label of the neighbours, offered to the node and to its present root
        near = both.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").select("a", "c")
        offer = near.groupBy("a").agg(F.min("c").alias("c")).join(label.select(F.col("node").alias("a"), F.col("component").alias("own")), "a").where("c < own")
        moves = offer.select(F.explode(F.array("a", "own")).alias("node"), "c").groupBy("node").agg(F.min("c").alias("c"))
        hooked = label.join(moves, "node", "left").select("node", F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = stored(hooked.join(jump, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        changed = new.join(label.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        drop(label)
        label = new
        if not changed:
            drop(edges)
            return label
