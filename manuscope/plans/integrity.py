"""Queries on references between tables (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import OrphanState, edge_ends, node_loads, replay
from ..runtime import read
from .registry import query


def _states(spark: SparkSession, sf_dir: str, steps: int = 2) -> list[OrphanState]:
    t = lambda name: read(spark, sf_dir, name)
    return replay(OrphanState.empty(spark), edge_ends(t("rel_text_text"), t("rel_text_image")), node_loads(t("nodes_text"), t("nodes_image")), steps)


_ENDS = """
WITH ends AS (
  SELECT 'rel_text_text' AS rel_table, 'src_chunk_id' AS field_name, 'nodes_text' AS parent_table, rel_id, src_chunk_id AS key, loaded_at FROM rel_text_text
  UNION ALL SELECT 'rel_text_text', 'dst_chunk_id', 'nodes_text', rel_id, dst_chunk_id, loaded_at FROM rel_text_text
  UNION ALL SELECT 'rel_text_image', 'chunk_id', 'nodes_text', rel_id, chunk_id, loaded_at FROM rel_text_image
  UNION ALL SELECT 'rel_text_image', 'img_id', 'nodes_image', rel_id, img_id, loaded_at FROM rel_text_image),
versions AS (
  SELECT 'nodes_text' AS parent_table, chunk_id AS key, loaded_at, max(deleted_at) AS deleted_at FROM nodes_text GROUP BY 2, 3
  UNION ALL SELECT 'nodes_image', img_id, loaded_at, max(deleted_at) FROM nodes_image GROUP BY 2, 3),
nodes AS (SELECT parent_table, key, min(loaded_at) FILTER (deleted_at IS NULL) AS live_from FROM versions GROUP BY ALL),
found AS (
  SELECT e.*, strftime(e.loaded_at, '%Y-%m') AS period,
    CASE WHEN n.key IS NULL THEN 'missing' WHEN n.live_from IS NULL THEN 'deleted' WHEN n.live_from <= e.loaded_at THEN 'ok' ELSE 'late' END AS status
  FROM ends e LEFT JOIN nodes n ON n.parent_table = e.parent_table AND n.key = e.key WHERE e.key IS NOT NULL)
"""


@query(_ENDS + "SELECT DISTINCT rel_table, period, rel_id, field_name FROM found WHERE status <> 'ok'")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)[-1].orphans().select("rel_table", "period", "rel_id", "field_name").distinct()


@query(_ENDS + "SELECT rel_table, field_name, period, status, count(*) AS orphans FROM found WHERE status <> 'ok' GROUP BY ALL")
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per edge table, field, month of loading and status."""
    return _states(spark, sf_dir)[-1].snapshot()


#: Batches after which the counts are taken.
SNAPSHOTS = 4

_SNAPSHOTS = f"""
, span AS (SELECT min(x) AS lo, max(x) AS hi FROM (SELECT loaded_at AS x FROM rel_text_text UNION ALL SELECT loaded_at FROM rel_text_image UNION ALL SELECT loaded_at FROM nodes_text UNION ALL SELECT loaded_at FROM nodes_image)),
steps AS (SELECT CAST(i AS INT) AS step, CASE WHEN i < {SNAPSHOTS} THEN lo + to_microseconds(CAST(round((epoch_us(hi) - epoch_us(lo)) * i / {SNAPSHOTS}) AS BIGINT)) END AS b FROM span, range(1, {SNAPSHOTS} + 1) r(i)),
n AS (SELECT 'nodes_text' AS parent_table, chunk_id AS key, loaded_at, deleted_at FROM nodes_text UNION ALL SELECT 'nodes_image', img_id, loaded_at, deleted_at FROM nodes_image),
events AS (SELECT step, parent_table, key, loaded_at, NULL AS deleted_at FROM n, steps WHERE b IS NULL OR loaded_at IS NULL OR loaded_at <= b UNION ALL SELECT step, parent_table, key, loaded_at, deleted_at FROM n, steps WHERE deleted_at IS NOT NULL AND (b IS NULL OR deleted_at <= b)),
live AS (SELECT step, parent_table, key, min(loaded_at) FILTER (deleted_at IS NULL) AS live_from FROM (SELECT step, parent_table, key, loaded_at, max(deleted_at) AS deleted_at FROM events GROUP BY ALL) GROUP BY ALL),
seen AS (SELECT step, e.* FROM ends e, steps WHERE e.key IS NOT NULL AND (b IS NULL OR e.loaded_at IS NULL OR e.loaded_at <= b)),
then_ AS (SELECT e.*, strftime(e.loaded_at, '%Y-%m') AS period, CASE WHEN l.key IS NULL THEN 'missing' WHEN l.live_from IS NULL THEN 'deleted' WHEN l.live_from <= e.loaded_at THEN 'ok' ELSE 'late' END AS status
  FROM seen e LEFT JOIN live l ON l.step = e.step AND l.parent_table = e.parent_table AND l.key = e.key)
SELECT step, rel_table, field_name, period, status, count(*) AS orphans FROM then_ WHERE status <> 'ok' GROUP BY ALL"""


@query(_ENDS + _SNAPSHOTS)
def p5_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report after each batch of the history."""
    out = None
    for i, state in enumerate(_states(spark, sf_dir, SNAPSHOTS), 1):
        one = state.snapshot().select(F.lit(i).alias("step"), "*")
        out = one if out is None else out.union(one)
    return out
