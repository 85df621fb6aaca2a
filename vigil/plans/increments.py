"""Two versions of an architecture of suppliers, a catalog of parts, and the threats of the second from those of the first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import increments as I
from .registry import query, table

_SNAP = """SELECT s_suppkey AS id, CAST((s_nationkey + {shift}) % 25 AS VARCHAR) AS category, s_acctbal > {limit} AS internet_facing, s_suppkey % 3 = 0 AS sensitive, CASE WHEN s_suppkey % 4 = 0 THEN 'untrusted' END AS trust_level FROM supplier WHERE {kept}"""
_FLOW = """SELECT a.s_suppkey AS source, b.s_suppkey AS target, CAST(a.s_nationkey AS VARCHAR) AS category, {protocol} AS protocol FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 3 WHERE {kept}"""
_SHIFT = "CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE 0 END"
OLD = (_SNAP.format(shift="0", limit="5000", kept="s_suppkey % 7 <> 0"), _FLOW.format(protocol="'tls'", kept="a.s_suppkey % 5 <> 0"))
NEW = (_SNAP.format(shift=_SHIFT, limit="CASE WHEN s_suppkey % 10 = 0 THEN 1000 ELSE 5000 END", kept="s_suppkey % 11 <> 0"), _FLOW.format(protocol="CASE WHEN a.s_suppkey % 17 = 0 THEN 'plain' ELSE 'tls' END", kept="a.s_suppkey % 6 <> 0"))
CATALOG = "SELECT CAST(p_size % 25 AS VARCHAR) AS category, split_part(p_type, ' ', 1) AS stride, p_brand AS threat, min(CASE WHEN p_size > 40 THEN 'critical' WHEN p_size > 25 THEN 'high' WHEN p_size > 10 THEN 'medium' ELSE 'low' END) AS severity FROM part GROUP BY 1, 2, 3"


def _snapshots(spark, sf_dir):
    views = {n: table(spark, sf_dir, n) for n in ("supplier", "part")}
    read = lambda sql: spark.sql(sql.replace("FROM supplier", "FROM {supplier}").replace("JOIN supplier", "JOIN {supplier}").replace("FROM part", "FROM {part}").replace("VARCHAR", "STRING"), **{n: v for n, v in views.items() if f" {n}" in sql})
    return (read(OLD[0]), read(OLD[1])), (read(NEW[0]), read(NEW[1])), read(CATALOG)


_BASE = "CASE severity WHEN 'critical' THEN 9.5 WHEN 'high' THEN 7.5 WHEN 'medium' THEN 5.0 WHEN 'low' THEN 2.5 ELSE 5.0 END::DOUBLE"


def _derived(n: str) -> str:
    return f"""SELECT upper(left(stride, 4)) || '_' || left(md5(lower(stride) || '|' || lower(target) || '|' || lower(threat)), 8) AS threat_id, * FROM (
  SELECT stride, threat, severity, least(10.0, {_BASE} + internet_facing::INT * 1.0 + sensitive::INT * 0.5 + (coalesce(trust_level, '') = 'untrusted')::INT * 0.5)::DOUBLE AS risk_score, id::VARCHAR AS target, [id::VARCHAR] AS components FROM c{n} JOIN k USING (category)
  UNION ALL SELECT stride, threat, severity, {_BASE}, source::VARCHAR || '->' || target::VARCHAR, [source::VARCHAR, target::VARCHAR] FROM f{n} JOIN k USING (category))"""


_TABLES = f"c0 AS ({OLD[0]}), f0 AS ({OLD[1]}), c1 AS ({NEW[0]}), f1 AS ({NEW[1]}), k AS ({CATALOG}), d0 AS ({_derived('0')}), d1 AS ({_derived('1')})"
_CHANGED = """cc AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'modified' END AS status, o.trust_level IS DISTINCT FROM n.trust_level AS safe FROM c0 o FULL JOIN c1 n ON o.id = n.id WHERE o IS DISTINCT FROM n),
ff AS (SELECT coalesce(o.source, n.source) AS source, coalesce(o.target, n.target) AS target, CASE WHEN o.source IS NULL THEN 'added' WHEN n.source IS NULL THEN 'removed' ELSE 'modified' END AS status, o.protocol IS DISTINCT FROM n.protocol AS safe FROM f0 o FULL JOIN f1 n ON o.source = n.source AND o.target = n.target WHERE o IS DISTINCT FROM n)"""


@query(f"""
WITH {_TABLES}, gone AS (SELECT id::VARCHAR AS id FROM c0 WHERE id NOT IN (SELECT id FROM c1))
SELECT coalesce(o.threat_id, n.threat_id) AS threat_id, CASE WHEN n.threat_id IS NULL THEN o.severity ELSE n.severity END AS severity, CASE WHEN n.threat_id IS NULL THEN o.risk_score ELSE n.risk_score END AS risk_score,
  CASE WHEN o.threat_id IS NULL THEN 'new' WHEN n.threat_id IS NOT NULL THEN CASE WHEN o.severity IS DISTINCT FROM n.severity OR o.risk_score IS DISTINCT FROM n.risk_score THEN 'modified' ELSE 'existing' END
    WHEN len(list_filter(o.components, lambda x: x IN (SELECT id FROM gone))) > 0 THEN 'resolved' ELSE 'existing' END AS status,
  CASE WHEN o.threat_id IS NOT NULL AND n.threat_id IS NOT NULL AND (o.severity IS DISTINCT FROM n.severity OR o.risk_score IS DISTINCT FROM n.risk_score) THEN o.risk_score END AS previous_risk
FROM d0 o FULL JOIN d1 n ON o.threat_id = n.threat_id
""".replace("len(list_filter(o.components, lambda x: x IN (SELECT id FROM gone))) > 0", "list_has_any(o.components, (SELECT list(id) FROM gone))"))
def incremental_threats(spark, sf_dir):
    """The lifecycle of all threats after a change, deriving only what the change touches; SQL derives everything anew."""
    old, new, catalog = _snapshots(spark, sf_dir)
    return I.update(old, new, catalog, I.derive(*old, catalog)).select("threat_id", "severity", "risk_score", "status", F.col("previous.risk_score").alias("previous_risk"))


@query(f"""
WITH {_TABLES}, {_CHANGED}, w AS (
  SELECT CASE status WHEN 'added' THEN 0.15 WHEN 'removed' THEN 0.10 ELSE 0.08 + safe::INT * 0.2 END AS w, status <> 'modified' OR safe AS r FROM cc
  UNION ALL SELECT CASE status WHEN 'added' THEN 0.12 WHEN 'removed' THEN 0.08 ELSE 0.06 + safe::INT * 0.2 END, status = 'modified' AND safe FROM ff)
SELECT count(*) AS changes, least(1.0, round(coalesce(sum(w), 0), 6))::DOUBLE AS impact, coalesce(bool_or(r), false) AS security_relevant FROM w
""")
def architecture_impact(spark, sf_dir):
    """Number and weight of the changes between two versions, and whether any matters for security."""
    old, new, _ = _snapshots(spark, sf_dir)
    c, f = I.changes(old[0], new[0], ["id"]), I.changes(old[1], new[1], ["source", "target"])
    return I.impact(c, f, f.limit(0))


@query(f"""
WITH {_TABLES}, {_CHANGED}, gone AS (SELECT list(id::VARCHAR) AS l FROM cc WHERE status = 'removed'), hit AS (SELECT list(id::VARCHAR) AS l FROM (SELECT id FROM cc UNION SELECT source FROM ff UNION SELECT target FROM ff))
SELECT threat_id, CASE WHEN list_has_any(components, gone.l) THEN 'orphaned' WHEN list_has_any(components, hit.l) THEN 'affected' ELSE 'unaffected' END AS state FROM d0, gone, hit
""")
def threats_touched_by_change(spark, sf_dir):
    """Threats of the first version whose components were removed, changed, or left alone."""
    old, new, catalog = _snapshots(spark, sf_dir)
    ids = I.affected(I.changes(old[0], new[0], ["id"]), I.changes(old[1], new[1], ["source", "target"]))
    return I.touched_threats(I.derive(*old, catalog), ids).select("threat_id", "state")
