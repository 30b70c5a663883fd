"""Queries of the general problems 4, 6 and 7 over the catalogue tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.operators import hierarchy, orphans, snapshots
from lexigraph.session import table


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = orphans.reference_rows(table(spark, sf_dir, "evolution_edge"), "evolution_edge", ["from_digimon_id", "to_digimon_id"])
    return refs.unionByName(orphans.reference_rows(table(spark, sf_dir, "digimon_alias"), "digimon_alias", ["digimon_id"]))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to creatures that do not exist at the time of the reference."""
    state = orphans.replay(_references(spark, sf_dir), orphans.parent_changes(table(spark, sf_dir, "digimon")), reopen=False)
    return state.where("reason is not null").select("ref_table", "ref_column", "row_id", orphans.period(F.col("recorded_at")).alias("period"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts per table, column and period after the last batch."""
    refs = _references(spark, sf_dir)
    return orphans.period_counts(refs, orphans.replay(refs, orphans.parent_changes(table(spark, sf_dir, "digimon"))))


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "evolution_edge").where("is_primary_line = 1")
    return hierarchy.with_paths(hierarchy.forest(links, "from_digimon_id", "to_digimon_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of every id in the primary links."""
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), "/")
    return _hierarchy(spark, sf_dir).select(F.col("node").alias("digimon_id"), F.col("root").alias("root_id"), "depth", path.alias("path"), "n_descendants")


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every id in the primary links, with their distance."""
    return hierarchy.descendants(_hierarchy(spark, sf_dir)).select(F.col("ancestor").alias("digimon_id"), F.col("node").alias("descendant_id"), "distance")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creatures added, removed or changed between consecutive snapshots."""
    rows = snapshots.current_rows(table(spark, sf_dir, "digimon_snapshot"), "snapshot_date", "digimon_id", "content_hash", "delivered_at")
    c = snapshots.changes(rows)
    return c.select(F.date_format("day", "yyyy-MM-dd").alias("snapshot_date"), F.col("key").alias("digimon_id"), "change")


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts, "p6_found": p6_found, "p6_descendants": p6_descendants, "p7_found": p7_found}

_REFS = """
WITH refs AS (
  SELECT DISTINCT 'evolution_edge' AS ref_table, 'from_digimon_id' AS ref_column, id AS row_id, from_digimon_id AS parent, recorded_at FROM evolution_edge
  UNION SELECT DISTINCT 'evolution_edge', 'to_digimon_id', id, to_digimon_id, recorded_at FROM evolution_edge
  UNION SELECT DISTINCT 'digimon_alias', 'digimon_id', id, digimon_id, recorded_at FROM digimon_alias),
state AS (
  SELECT r.*, d.created_at, d.deleted_at, coalesce(strftime(r.recorded_at, '%Y-%m'), 'none') AS period,
    CASE WHEN d.id IS NULL THEN 'missing'
         WHEN d.deleted_at IS NOT NULL AND (r.recorded_at IS NULL OR d.deleted_at <= r.recorded_at) THEN 'deleted'
         WHEN d.created_at > r.recorded_at THEN 'late' END AS reason
  FROM refs r LEFT JOIN digimon d ON d.id = r.parent WHERE r.parent IS NOT NULL)
"""

SQL = {
    "p4_found": _REFS + "SELECT ref_table, ref_column, row_id, period FROM state WHERE reason IS NOT NULL",
    "p4_counts": _REFS
    + """SELECT ref_table, ref_column, period, count(*) AS n_refs, count(reason) AS n_orphans,
    count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'deleted') AS n_deleted,
    count(*) FILTER (reason = 'late') AS n_late, count(*) FILTER (reason = 'late') AS n_resolved,
    count(*) FILTER (deleted_at IS NOT NULL AND reason IS DISTINCT FROM 'deleted') AS n_reopened
    FROM state GROUP BY ref_table, ref_column, period""",
    "p6_found": """
WITH RECURSIVE l AS (
  SELECT to_digimon_id AS c, min(from_digimon_id) AS p FROM evolution_edge
  WHERE is_primary_line = 1 AND from_digimon_id IS NOT NULL AND to_digimon_id IS NOT NULL GROUP BY to_digimon_id),
nodes AS (SELECT c AS n FROM l UNION SELECT p FROM l),
t AS (
  SELECT n AS root, n, 0 AS depth, CAST(n AS VARCHAR) AS path FROM nodes WHERE n NOT IN (SELECT c FROM l)
  UNION ALL SELECT t.root, l.c, t.depth + 1, t.path || '/' || l.c FROM t JOIN l ON l.p = t.n),
d AS (
  SELECT a, count(*) AS k FROM (SELECT n, unnest(string_split(path, '/'))::BIGINT AS a FROM t) WHERE a <> n GROUP BY a),
rest AS (SELECT c, p FROM l WHERE c NOT IN (SELECT n FROM t)),
walk AS (
  SELECT c AS start, p AS cur, 1 AS steps, [c] AS seen FROM rest
  UNION ALL SELECT w.start, r.p, w.steps + 1, list_append(w.seen, w.cur) FROM walk w JOIN rest r ON r.c = w.cur WHERE NOT list_contains(w.seen, w.cur)),
ends AS (
  SELECT start, cur, list_slice(seen, list_position(seen, cur), len(seen)) AS ring, row_number() OVER (PARTITION BY start ORDER BY steps DESC) AS k FROM walk)
SELECT t.n AS digimon_id, t.root AS root_id, t.depth, t.path, coalesce(d.k, 0) AS n_descendants FROM t LEFT JOIN d ON d.a = t.n
UNION ALL
SELECT start, list_min(ring), CASE WHEN cur = start THEN -1 ELSE -2 END, '', 0 FROM ends WHERE k = 1
""",
    "p6_descendants": """
WITH RECURSIVE l AS (
  SELECT to_digimon_id AS c, min(from_digimon_id) AS p FROM evolution_edge
  WHERE is_primary_line = 1 AND from_digimon_id IS NOT NULL AND to_digimon_id IS NOT NULL GROUP BY to_digimon_id),
t AS (
  SELECT DISTINCT p AS n, [p] AS path FROM l WHERE p NOT IN (SELECT c FROM l)
  UNION ALL SELECT l.c, list_append(t.path, l.c) FROM t JOIN l ON l.p = t.n)
SELECT a AS digimon_id, n AS descendant_id, len(path) - list_position(path, a) AS distance FROM (SELECT n, path, unnest(path) AS a FROM t) WHERE a <> n
""",
    "p7_found": """
WITH r AS (
  SELECT CAST(substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) AS DATE) AS day, digimon_id, lower(trim(content_hash)) AS h,
    row_number() OVER (PARTITION BY substr(d, 1, 8), digimon_id ORDER BY delivered_at DESC NULLS LAST, lower(trim(content_hash)) DESC NULLS LAST) AS k
  FROM (SELECT *, regexp_replace(trim(snapshot_date), '[-/.]', '', 'g') AS d FROM digimon_snapshot)),
c AS (SELECT day, digimon_id, h FROM r WHERE k = 1),
s AS (SELECT day, lead(day) OVER (ORDER BY day) AS nxt, lag(day) OVER (ORDER BY day) AS prv FROM (SELECT DISTINCT day FROM c)),
n AS (SELECT c.* FROM c JOIN s USING (day) WHERE prv IS NOT NULL),
o AS (SELECT nxt AS day, digimon_id, h FROM c JOIN s USING (day) WHERE nxt IS NOT NULL)
SELECT strftime(coalesce(n.day, o.day), '%Y-%m-%d') AS snapshot_date, coalesce(n.digimon_id, o.digimon_id) AS digimon_id,
  CASE WHEN o.digimon_id IS NULL THEN 'added' WHEN n.digimon_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n FULL JOIN o ON n.day = o.day AND n.digimon_id = o.digimon_id
WHERE o.digimon_id IS NULL OR n.digimon_id IS NULL OR n.h <> o.h
""",
}
