"""Orphan references: edge ends whose key has no live parent, kept up to date incrementally.

The state keeps three keyed tables.  ``pending`` has the references that wait for a parent, with what they lack.  ``versions`` is
the log of parents' loads and deletions, and ``settled`` the log of references that had a parent once; a step appends to
these and rewrites neither.  A step takes what arrived since the last: new references probe the parents, arriving
parents resolve the pending references of their keys, and deletions reopen the settled ones of theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut
from .skew import lookup

REFS = "rel_table string, field_name string, parent_table string, rel_id long, key string, loaded_at timestamp_ntz, status string"
VERSIONS = "parent_table string, key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
#: What a reference can be; all but ``ok`` are orphans.
OK, MISSING, DELETED, LATE = "ok", "missing", "deleted", "late"


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_k", F.concat_ws("\x01", "parent_table", "key"))


def _of_keys(df: DataFrame, keys: DataFrame, row: list[str], how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose key is among ``keys`` (_k, a written table), or is not; hot keys are salted by ``row``."""
    marked = _keyed(df).withColumn("_row", F.concat_ws("\x01", *row))
    return lookup(marked, keys, "_k", "_row", how).select(*df.columns)


@dataclass(frozen=True)
class OrphanState:
    """``versions``: loads and deletions of parents; ``pending``: references without a live parent, with their status;
    ``settled``: references that had one at the end of some step (some may be pending again)."""

    versions: DataFrame
    pending: DataFrame
    settled: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> OrphanState:
        pending = spark.createDataFrame([], REFS)
        return OrphanState(spark.createDataFrame([], VERSIONS), pending, pending.drop("status"))

    def advance(self, refs: DataFrame, loads: DataFrame, deletions: DataFrame) -> OrphanState:
        """The state after new ``refs`` (of REFS, without status), parent ``loads`` and ``deletions`` (parent_table, key, loaded_at, deleted_at).

        A reference is ``ok`` if some live load of its exact key is not after it, ``late`` if live loads are all
        after it (or it has no time), ``deleted`` if all loads are deleted, ``missing`` if there is none.
        Null keys refer to nothing and are dropped; loads without a key or time are kept but never live; repeated rows
        of a reference count once.
        """
        loads = loads.where("key is not null").select("parent_table", "key", "loaded_at", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
        gone = deletions.where("key is not null").select("parent_table", "key", "loaded_at", "deleted_at")
        arrived = cut(loads.union(gone).groupBy("parent_table", "key", "loaded_at").agg(F.max("deleted_at").alias("deleted_at")), "loads")
        versions = self.versions.union(arrived)
        touched = cut(_keyed(arrived).groupBy("_k").agg(F.max(F.col("deleted_at").isNotNull()).alias("gone")), "touched")
        keys, row = touched.select("_k"), ["rel_table", "field_name", "rel_id"]
        again = _of_keys(self.pending, keys, row).drop("status").union(_of_keys(self.settled, cut(touched.where("gone").select("_k"), "gone"), row))
        probe = cut(again.union(refs.where("key is not null").select(*again.columns)).distinct(), "probe")
        asked = cut(_keyed(probe).select("_k").distinct(), "asked")
        known = _of_keys(versions, asked, ["loaded_at"]).groupBy("parent_table", "key", "loaded_at").agg(F.max("deleted_at").alias("deleted_at"))
        index = known.groupBy("parent_table", "key").agg(F.min(F.when(F.col("deleted_at").isNull(), F.col("loaded_at"))).alias("live_from"))
        index = cut(_keyed(index).select("_k", "live_from", F.lit(True).alias("known")), "index")
        status = (
            F.when(F.col("known").isNull(), MISSING)
            .when(F.col("live_from").isNull(), DELETED)
            .when(F.col("live_from") <= F.col("loaded_at"), OK)
            .otherwise(LATE)
        )
        found = lookup(_keyed(probe).withColumn("_row", F.concat_ws("\x01", *row)), index, "_k", "_row")
        checked = cut(found.select(*probe.columns, status.alias("status")), "checked")
        waiting = _of_keys(self.pending, keys, row, "left_anti").union(checked.where(F.col("status") != OK))
        return OrphanState(versions, cut(waiting, "pending"), self.settled.union(checked.where(F.col("status") == OK).drop("status")))

    @property
    def refs(self) -> DataFrame:
        """Every reference with its status."""
        row = ["rel_table", "field_name", "parent_table", "rel_id", "key", "loaded_at"]
        same = [F.col(f"s.{c}").eqNullSafe(F.col(f"p.{c}")) for c in row]
        fine = self.settled.distinct().alias("s").join(self.pending.alias("p"), same, "left_anti")
        return fine.withColumn("status", F.lit(OK)).union(self.pending.select(*row, "status"))

    def orphans(self) -> DataFrame:
        return self.pending.withColumn("period", F.date_format("loaded_at", "yyyy-MM"))

    def snapshot(self) -> DataFrame:
        """Orphans per edge table, field, period of loading and status."""
        return self.orphans().groupBy("rel_table", "field_name", "period", "status").agg(F.count("*").alias("orphans"))


def replay(state: OrphanState, refs: DataFrame, nodes: DataFrame, steps: int = 2) -> list[OrphanState]:
    """The states after each of ``steps`` batches of equal spans of time, to which whole tables are fed.

    ``nodes``: parent_table, key, loaded_at, deleted_at.  A node's load arrives at ``loaded_at`` and its deletion at
    ``deleted_at``; rows without a time come with the first batch, deletions after the last load with the last.
    """
    times = refs.select("loaded_at").union(nodes.select("loaded_at"))
    low, high = times.agg(F.min("loaded_at"), F.max("loaded_at")).first()
    if low is None:
        return [state.advance(refs, nodes, nodes.where("deleted_at is not null"))]
    bounds = [low + (high - low) * i / steps for i in range(1, steps)]

    def part(col: str):
        return sum((F.coalesce(F.col(col) > F.lit(b).cast("timestamp_ntz"), F.lit(False)).cast("int") for b in bounds), F.lit(0))

    states = []
    for i in range(steps):
        state = state.advance(refs.where(part("loaded_at") == i), nodes.where(part("loaded_at") == i), nodes.where((part("deleted_at") == i) & F.col("deleted_at").isNotNull()))
        states.append(state)
    return states


def edge_ends(text_text: DataFrame, text_image: DataFrame) -> DataFrame:
    """The four reference fields of the two edge tables in the form of REFS."""
    parts = [(text_text, "rel_text_text", "src_chunk_id", "nodes_text"), (text_text, "rel_text_text", "dst_chunk_id", "nodes_text"), (text_image, "rel_text_image", "chunk_id", "nodes_text"), (text_image, "rel_text_image", "img_id", "nodes_image")]
    out = None
    for df, rel, field, parent in parts:
        one = df.select(F.lit(rel).alias("rel_table"), F.lit(field).alias("field_name"), F.lit(parent).alias("parent_table"), "rel_id", F.col(field).alias("key"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"))
        out = one if out is None else out.union(one)
    return out


def node_loads(nodes_text: DataFrame, nodes_image: DataFrame) -> DataFrame:
    pick = lambda df, name, key: df.select(F.lit(name).alias("parent_table"), F.col(key).alias("key"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), F.col("deleted_at").cast("timestamp_ntz").alias("deleted_at"))
    return pick(nodes_text, "nodes_text", "chunk_id").union(pick(nodes_image, "nodes_image", "img_id"))
