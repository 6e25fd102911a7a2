"""Queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.hierarchy import ancestor_paths, current_links, descendants_of, hierarchies
from graphloom.operators.snapshots import snapshot_changes
from graphloom.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Objects added, removed or changed between consecutive snapshots of a project and source type."""
    rows = table(spark, folder, "metadata_object_hashes")
    return snapshot_changes(rows, ["object_qn"], ["project_name", "source_type"]).select("project_name", "source_type", "object_qn", "snapshot_no", "change_kind")


def p3_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the JSON before and after."""
    rows = table(spark, folder, "metadata_object_hashes")
    return snapshot_changes(rows, ["object_qn"], ["project_name", "source_type"], values=True).select("project_name", "source_type", "object_qn", "snapshot_no", "change_kind", "old_value", "new_value")


def p3_change_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Changes by project, source type, snapshot and kind."""
    found = p3_found(spark, folder)
    return found.groupBy("project_name", "source_type", "snapshot_no", "change_kind").agg(F.count(F.lit(1)).alias("objects"))


def _forest(spark: SparkSession, folder: str) -> DataFrame:
    links = [current_links(table(spark, folder, t), t) for t in ("subsystem_edge", "child_rel")]
    return hierarchies(links[0].unionByName(links[1]))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Root and depth of every node of both link tables; depth -1 on or below a cycle."""
    return _forest(spark, folder).select("edge_table", "node_qn", "root_qn", "depth")


def p6_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """The descendants of every node as an interval and their number, null on or below a cycle.

    v is below u exactly if both have the same edge_table and root_qn, and entry(u) < entry(v) < exit(u).
    """
    return _forest(spark, folder).select("edge_table", "node_qn", "root_qn", "depth", "entry", "exit", "descendants")


def _one(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return hierarchies(current_links(table(spark, folder, name), name))


def p6_subsystem_members(spark: SparkSession, folder: str) -> DataFrame:
    """All descendants of every subsystem, with their distance."""
    return descendants_of(_one(spark, folder, "subsystem_edge"))


def p6_subsystem_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The path from the root to every subsystem, null on or below a cycle."""
    return ancestor_paths(_one(spark, folder, "subsystem_edge"))


def p6_control_members(spark: SparkSession, folder: str) -> DataFrame:
    """All descendants of every form control, with their distance."""
    return descendants_of(_one(spark, folder, "child_rel"))


def p6_control_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The path from the root to every form control, null on or below a cycle."""
    return ancestor_paths(_one(spark, folder, "child_rel"))


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_changes, p3_change_counts, p6_found, p6_descendants, p6_subsystem_members, p6_subsystem_paths, p6_control_members, p6_control_paths)}


def _links_sql(name: str) -> str:
    trim = r"nfc_normalize(regexp_replace({0}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'))"
    return f"""SELECT '{name}' AS t, c, nullif(p, '') AS p FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY loaded_at DESC) AS k
        FROM (SELECT {trim.format("child_qn")} AS c, {trim.format("parent_qn")} AS p, loaded_at FROM {name}) WHERE c <> '') WHERE k = 1"""


_P6 = f"""WITH RECURSIVE e AS ({_links_sql("subsystem_edge")} UNION ALL {_links_sql("child_rel")}),
    nodes AS (SELECT t, c AS node FROM e UNION SELECT t, p FROM e WHERE p IS NOT NULL),
    w AS (SELECT t, node AS root, node, 0 AS depth FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.t = n.t AND e.c = n.node AND e.p IS NOT NULL)
        UNION ALL SELECT w.t, w.root, e.c, w.depth + 1 FROM w JOIN e ON e.t = w.t AND e.p = w.node),
    caught AS (SELECT n.t, n.node FROM nodes n ANTI JOIN w ON w.t = n.t AND w.node = n.node),
    up AS (SELECT u.t, u.node, e.p AS above FROM caught u JOIN e ON e.t = u.t AND e.c = u.node UNION SELECT up.t, up.node, e.p FROM up JOIN e ON e.t = up.t AND e.c = up.above),
    ring AS (SELECT t, node FROM up WHERE node = above)
    SELECT t AS edge_table, node AS node_qn, root AS root_qn, CAST(depth AS INTEGER) AS depth FROM w
    UNION ALL SELECT u.t, u.node, min(r.node), -1 FROM up u JOIN ring r ON r.t = u.t AND r.node = u.above GROUP BY u.t, u.node"""


_TRIM = r"nfc_normalize(regexp_replace({0}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'))"
_IGNORED = r'\."?(meta_uuid|description_embedding|description_embedding_model|description_embedding_updated_at)"?(\.|\[|$)'
# Values as the sorted list of their nodes: path, kind and, of leaves, the value; numbers compare as such.
_P3 = rf"""WITH r AS (SELECT row_number() OVER () AS i, {_TRIM.format("project_name")} AS p, {_TRIM.format("source_type")} AS t, {_TRIM.format("object_qn")} AS q, snapshot_no AS s, lower(trim(object_hash)) AS h, object_snapshot_json AS j, delivered_at AS d FROM metadata_object_hashes WHERE snapshot_no IS NOT NULL),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p, t, q, s ORDER BY d DESC NULLS LAST, i) AS k FROM r) WHERE k = 1),
    c AS (SELECT i, string_agg(n, chr(1) ORDER BY n) AS v FROM (SELECT u.i, x.fullkey || '=' || CASE WHEN x.type IN ('OBJECT', 'ARRAY', 'NULL') THEN x.type WHEN x.type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(CAST(x.atom AS DOUBLE) AS VARCHAR) ELSE x.type || ':' || CAST(x.atom AS VARCHAR) END AS n
        FROM u, json_tree(CASE WHEN json_valid(u.j) THEN u.j END) x WHERE json_valid(u.j) AND NOT regexp_matches(x.fullkey, '{_IGNORED}')) GROUP BY i),
    w AS (SELECT u.*, c.v FROM u LEFT JOIN c USING (i)), cal AS (SELECT p, t, s, lag(s) OVER (PARTITION BY p, t ORDER BY s) AS before, lead(s) OVER (PARTITION BY p, t ORDER BY s) AS after FROM (SELECT DISTINCT p, t, s FROM u)),
    ch AS (SELECT n.p, n.t, n.q, n.s, CASE WHEN o.q IS NULL THEN 'added' ELSE 'changed' END AS kind, o.j AS oj, n.j AS nj FROM w n JOIN cal ON cal.p = n.p AND cal.t = n.t AND cal.s = n.s LEFT JOIN w o ON o.p = n.p AND o.t = n.t AND o.q = n.q AND o.s = cal.before
            WHERE cal.before IS NOT NULL AND (o.q IS NULL OR CASE WHEN o.v IS NOT NULL AND n.v IS NOT NULL THEN o.v <> n.v ELSE o.h IS DISTINCT FROM n.h END)
        UNION ALL SELECT o.p, o.t, o.q, cal.after, 'removed', o.j, NULL FROM w o JOIN cal ON cal.p = o.p AND cal.t = o.t AND cal.s = o.s LEFT JOIN w n ON n.p = o.p AND n.t = o.t AND n.q = o.q AND n.s = cal.after WHERE cal.after IS NOT NULL AND n.q IS NULL)"""
_NAMES = "p AS project_name, t AS source_type, q AS object_qn, s AS snapshot_no, kind AS change_kind"


def _paths_sql(name: str) -> str:
    return f"""WITH RECURSIVE e AS ({_links_sql(name)}), nodes AS (SELECT c AS node FROM e UNION SELECT p FROM e WHERE p IS NOT NULL),
    w AS (SELECT node, [node] AS line FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.c = n.node AND e.p IS NOT NULL) UNION ALL SELECT e.c, list_append(w.line, e.c) FROM w JOIN e ON e.p = w.node)"""


def _path_rows(name: str) -> str:
    return f"""{_paths_sql(name)} SELECT '{name}' AS edge_table, node AS node_qn, array_to_string(line, ' > ') AS path, CAST(len(line) - 1 AS INTEGER) AS depth FROM w
    UNION ALL SELECT '{name}', node, NULL, -1 FROM nodes ANTI JOIN w USING (node)"""


def _member_rows(name: str) -> str:
    return f"{_paths_sql(name)} SELECT '{name}' AS edge_table, line[i] AS ancestor_qn, node AS node_qn, CAST(len(line) - i AS INTEGER) AS distance FROM (SELECT node, line, unnest(range(1, len(line))) AS i FROM w)"


# Tours by name: before a node's entry stand two steps for each node ahead of it, less those still open.
_P6_TOURS = f"""WITH RECURSIVE e AS ({_links_sql("subsystem_edge")} UNION ALL {_links_sql("child_rel")}), nodes AS (SELECT t, c AS node FROM e UNION SELECT t, p FROM e WHERE p IS NOT NULL),
    w AS (SELECT t, node AS root, node, [node] AS line FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.t = n.t AND e.c = n.node AND e.p IS NOT NULL) UNION ALL SELECT w.t, w.root, e.c, list_append(w.line, e.c) FROM w JOIN e ON e.t = w.t AND e.p = w.node),
    d AS (SELECT t, above, count(*) AS n FROM (SELECT t, unnest(line[1:len(line) - 1]) AS above FROM w) GROUP BY ALL),
    r AS (SELECT t, node, root, len(line) - 1 AS depth, 2 * (row_number() OVER (PARTITION BY t, root ORDER BY line) - 1) - len(line) + 1 AS entry FROM w),
    caught AS (SELECT n.t, n.node FROM nodes n ANTI JOIN w ON w.t = n.t AND w.node = n.node), up AS (SELECT u.t, u.node, e.p AS above FROM caught u JOIN e ON e.t = u.t AND e.c = u.node UNION SELECT up.t, up.node, e.p FROM up JOIN e ON e.t = up.t AND e.c = up.above),
    ring AS (SELECT t, node FROM up WHERE node = above)
    SELECT r.t AS edge_table, node AS node_qn, root AS root_qn, CAST(depth AS INTEGER) AS depth, CAST(entry AS BIGINT) AS entry, CAST(entry + 2 * coalesce(n, 0) + 1 AS BIGINT) AS "exit", CAST(coalesce(n, 0) AS BIGINT) AS descendants FROM r LEFT JOIN d ON d.t = r.t AND d.above = r.node
    UNION ALL SELECT u.t, u.node, min(g.node), -1, NULL, NULL, NULL FROM up u JOIN ring g ON g.t = u.t AND g.node = u.above GROUP BY u.t, u.node"""


def oracle_sql() -> dict[str, str]:
    return {
        "p6_descendants": _P6_TOURS,
        "p3_found": f"{_P3} SELECT {_NAMES} FROM ch", "p3_changes": f"{_P3} SELECT {_NAMES}, oj AS old_value, nj AS new_value FROM ch",
        "p3_change_counts": f"{_P3} SELECT p AS project_name, t AS source_type, s AS snapshot_no, kind AS change_kind, count(*) AS objects FROM ch GROUP BY ALL",
        "p6_found": _P6, "p6_subsystem_paths": _path_rows("subsystem_edge"), "p6_control_paths": _path_rows("child_rel"), "p6_subsystem_members": _member_rows("subsystem_edge"), "p6_control_members": _member_rows("child_rel"),
    }
