"""Problem 1: full hierarchies of the summary nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.operators import hierarchy
from sylvan.queries.registry import query
from sylvan.session import table


LINKS_SQL = """WITH RECURSIVE e AS (SELECT DISTINCT id AS s, unnest(children_indices) AS d FROM summary_nodes WHERE id IS NOT NULL),
l AS (SELECT s, d FROM e WHERE d IS NOT NULL AND NOT regexp_full_match(d, '[0-9]{1,6}') AND d IN (SELECT id FROM summary_nodes WHERE id IS NOT NULL)),
r(s, d) AS (SELECT s, d FROM l UNION SELECT r.s, l.d FROM r JOIN l ON l.s = r.d)"""


@query("p1_found", f"{LINKS_SQL} SELECT DISTINCT s AS node_id FROM r WHERE s = d")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.cyclic_ids(table(spark, d, "summary_nodes")).select(F.col("id").alias("node_id"))


#: Vertices, links with their order, and the links that touch no node on a cycle.
ACYCLIC_SQL = """WITH RECURSIVE vx AS (SELECT id, min(node_no) AS v FROM summary_nodes WHERE id IS NOT NULL GROUP BY id),
e AS (SELECT id AS s, unnest(children_indices) AS d, generate_subscripts(children_indices, 1) - 1 AS ord FROM summary_nodes WHERE id IS NOT NULL),
l AS (SELECT s, d, min(ord) AS ord FROM e WHERE d IS NOT NULL AND NOT regexp_full_match(d, '[0-9]{1,6}') AND d IN (SELECT id FROM vx) GROUP BY s, d),
r(s, d) AS (SELECT s, d FROM l UNION SELECT r.s, l.d FROM r JOIN l ON l.s = r.d),
c AS (SELECT DISTINCT s AS id FROM r WHERE s = d),
a AS (SELECT s, d, ord, x.v AS sv, y.v AS dv FROM l JOIN vx x ON x.id = s JOIN vx y ON y.id = d WHERE s NOT IN (SELECT id FROM c) AND d NOT IN (SELECT id FROM c))"""


@query(
    "p1_hierarchy",
    f"""{ACYCLIC_SQL}, f AS (SELECT d, arg_min(s, sv) AS s, arg_min(ord, sv) * 1000000000000 + min(dv) AS sib, count(*) AS parents FROM a GROUP BY d),
  t(id, root, depth, line) AS (SELECT id, id, 0, []::BIGINT[] FROM vx WHERE id NOT IN (SELECT id FROM c) AND id NOT IN (SELECT d FROM f)
    UNION ALL SELECT f.d, t.root, t.depth + 1, list_append(t.line, f.sib) FROM t JOIN f ON f.s = t.id),
  w(s, d) AS (SELECT s, d FROM f UNION ALL SELECT w.s, f.d FROM w JOIN f ON f.s = w.d),
  n AS (SELECT t.*, row_number() OVER (PARTITION BY root ORDER BY line) - 1 AS i, (SELECT count(*) FROM w WHERE w.s = t.id) AS below FROM t)
  SELECT vx.id, n.root, n.depth::BIGINT AS depth, (2 * i - depth)::BIGINT AS entry, (2 * i - depth + 2 * below + 1)::BIGINT AS leave, below::BIGINT AS in_tree,
    (SELECT count(*) FROM r WHERE r.s = vx.id)::BIGINT AS descendants, coalesce(f.parents, 0)::BIGINT AS parents,
    CASE WHEN n.id IS NULL THEN 'cycle' WHEN f.d IS NOT NULL THEN 'node' WHEN vx.id IN (SELECT d FROM l WHERE s IN (SELECT id FROM c)) THEN 'below cycle'
      WHEN vx.id NOT IN (SELECT s FROM l) THEN 'orphan' ELSE 'root' END AS status
  FROM vx LEFT JOIN n ON n.id = vx.id LEFT JOIN f ON f.d = vx.id""",
)
def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "summary_nodes"))


@query(
    "p1_paths",
    f"""{ACYCLIC_SQL}, t(id, root, depth, path) AS (SELECT id, id, 0, [id] FROM vx WHERE id NOT IN (SELECT id FROM c) AND id NOT IN (SELECT d FROM a)
    UNION ALL SELECT a.d, t.root, t.depth + 1, list_append(t.path, a.d) FROM t JOIN a ON a.s = t.id) SELECT id, root, depth, path FROM t""",
)
def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.paths(table(spark, d, "summary_nodes"))


@query(
    "p1_descendants",
    f"""{LINKS_SQL}, c AS (SELECT DISTINCT s AS id FROM r WHERE s = d), a AS (SELECT s, d FROM l WHERE s NOT IN (SELECT id FROM c) AND d NOT IN (SELECT id FROM c)),
  w(s, d, k) AS (SELECT s, d, 1 FROM a UNION SELECT w.s, a.d, w.k + 1 FROM w JOIN a ON a.s = w.d)
  SELECT s AS ancestor, d AS descendant, min(k)::INTEGER AS distance FROM w GROUP BY 1, 2""",
)
def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "summary_nodes"))


@query(
    "p1_reachable",
    f"""{LINKS_SQL}, w(s, d, k) USING KEY (s, d) AS (SELECT s, d, 1 FROM l UNION SELECT w.s, l.d, min(w.k + 1) FROM w JOIN l ON l.s = w.d LEFT JOIN recurring.w o ON o.s = w.s AND o.d = l.d WHERE o.s IS NULL GROUP BY w.s, l.d)
  SELECT r.s AS ancestor, r.d AS descendant, w.k::INTEGER AS distance FROM r JOIN w USING (s, d)""",
)
def p1_reachable(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.reachable(table(spark, d, "summary_nodes"))
