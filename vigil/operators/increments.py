"""A threat model kept up to date: what changed between two snapshots decides what is derived again.

Snapshots are tables of components (id and any fields) and flows (source, target and any fields); a catalog has one row
per category and threat. Only components that changed or stand at a changed flow, and the flows that touch them, meet the
catalog; all other threats are carried over. Everything is an equi-join on ids. Ids are non-null and unique; of rows that
repeat an id or a flow's ends one stays, the last in the order of all its fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields whose change matters for security, and the weight of each kind of change.
SECURITY_FIELDS = (
    "authentication", "authorization", "encryption", "data_classification", "security_controls", "trust_level", "exposed_to_internet", "handles_pii", "handles_credentials", "protocol", "tls_required", "data_sensitivity",
)
WEIGHTS = {
    "added_component": 0.15, "removed_component": 0.10, "modified_component": 0.08, "added_flow": 0.12, "removed_flow": 0.08, "modified_flow": 0.06, "added_boundary": 0.10, "removed_boundary": 0.10, "modified_boundary": 0.05,
    "security_field_change": 0.20,
}
BASE_SCORES = {"critical": 9.5, "high": 7.5, "medium": 5.0, "low": 2.5}


def changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, changed): added, removed or modified rows with the names of the fields that differ, in order.

    Rows that did not change are absent. A field that one snapshot lacks counts as null there.
    """
    rest = sorted({*old.columns, *new.columns} - {*keys})

    def packed(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(F.lit(1).alias("_"), *[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in rest])
        return df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))).groupBy(*keys).agg(F.max(row).alias(name))

    both = packed(old, "_o").join(packed(new, "_n"), keys, "full_outer")
    differ = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(~F.col("_o")[c].eqNullSafe(F.col("_n")[c]), F.lit(c)) for c in rest]))
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.size(differ) > 0, "modified")
    none = F.array().cast("array<string>")
    return both.select(*keys, status.alias("status"), F.when(status == "modified", differ).otherwise(none).alias("changed")).where("status IS NOT NULL")


def affected(components: DataFrame, flows: DataFrame) -> DataFrame:
    """(id, removed) from the changes of components and flows: changed components and the ends of changed flows."""
    ends = flows.select(F.explode(F.array("source", "target")).alias("id"), F.lit(False).alias("removed"))
    return components.select("id", (F.col("status") == "removed").alias("removed")).unionByName(ends).groupBy("id").agg(F.bool_or("removed").alias("removed"))


def impact(components: DataFrame, flows: DataFrame, boundaries: DataFrame) -> DataFrame:
    """One row (changes, impact, security_relevant) from the three tables of changes; impact is 1 at most.

    Security fields weigh extra for components and flows; any added or removed component or boundary is relevant.
    """
    safe = F.array(*map(F.lit, SECURITY_FIELDS))

    def part(df: DataFrame, kind: str) -> DataFrame:
        weight = reduce(lambda c, s: c.when(F.col("status") == s, F.lit(WEIGHTS[f"{s}_{kind}"])), ("added", "removed", "modified"), F.when(F.lit(False), 0.0))
        touched = F.size(F.array_intersect("changed", safe))
        extra = F.lit(0.0) if kind == "boundary" else touched * F.lit(WEIGHTS["security_field_change"])
        relevant = touched > 0 if kind == "flow" else (touched > 0) | F.col("status").isin("added", "removed")
        return df.select((weight + extra).alias("w"), relevant.alias("r"))

    every = part(components, "component").unionByName(part(flows, "flow")).unionByName(part(boundaries, "boundary"))
    score = F.least(F.lit(1.0), F.round(F.coalesce(F.sum("w"), F.lit(0.0)), 6))
    return every.agg(F.count("*").alias("changes"), score.alias("impact"), F.coalesce(F.bool_or("r"), F.lit(False)).alias("security_relevant"))


def threat_id(category: Column, target: Column, vector: Column) -> Column:
    """Stable through versions: four letters of the category and eight digits of a hash of what identifies the threat."""
    text = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.concat(F.upper(F.left(F.coalesce(category, F.lit("unknown")), F.lit(4))), F.lit("_"), F.left(F.md5(F.concat_ws("|", text(F.coalesce(category, F.lit("unknown"))), text(target), text(vector))), F.lit(8)))


def derive(components: DataFrame, flows: DataFrame, catalog: DataFrame) -> DataFrame:
    """(threat_id, stride, threat, severity, risk_score, components): the catalog's threats of components and flows.

    components: id, category, internet_facing, sensitive, trust_level. flows: source, target, category. catalog: category,
    stride, threat, severity. Risk is the severity's base score with 1 for internet_facing, 0.5 for sensitive data and 0.5
    for an untrusted place, 10 at most; of an unknown severity 5. The catalog is not broadcast by hand: its size decides.
    """
    base = reduce(lambda c, s: c.when(F.col("severity") == s, F.lit(BASE_SCORES[s])), BASE_SCORES, F.when(F.lit(False), 0.0)).otherwise(5.0)
    yes = lambda c, v: F.when(c, F.lit(v)).otherwise(0.0)
    c = components.join(catalog, "category")
    risk = F.least(F.lit(10.0), base + yes(F.col("internet_facing"), 1.0) + yes(F.col("sensitive"), 0.5) + yes(F.col("trust_level") == "untrusted", 0.5))
    own = c.select("stride", "threat", "severity", risk.alias("risk_score"), F.col("id").cast("string").alias("target"), F.array(F.col("id").cast("string")).alias("components"))
    ends = [F.col(e).cast("string") for e in ("source", "target")]
    between = flows.join(catalog, "category").select("stride", "threat", "severity", base.alias("risk_score"), F.concat_ws("->", *ends).alias("target"), F.array(*ends).alias("components"))
    return own.unionByName(between).select(threat_id(F.col("stride"), F.col("target"), F.col("threat")).alias("threat_id"), "stride", "threat", "severity", "risk_score", "components")


def touched(components: DataFrame, flows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components among ``ids`` and the flows with an end among them, each flow once."""
    some = ids.select("id")
    at = lambda end: flows.join(some.select(F.col("id").alias(end)), end, "left_semi")
    rest = at("target").join(some.select(F.col("id").alias("source")), "source", "left_anti")
    return components.join(some, "id", "left_semi"), at("source").unionByName(rest)


def _states(threats: DataFrame, ids: DataFrame) -> DataFrame:
    """(threat_id, components, removed) of the threats with a component among ``ids``.

    An id has eight digits of a hash, so different threats share one now and then: a threat is told by its components too.
    """
    each = threats.select("threat_id", "components", F.explode("components").alias("_c"))
    return each.join(ids.select(F.col("id").cast("string").alias("_c"), "removed"), "_c").groupBy("threat_id", "components").agg(F.bool_or("removed").alias("removed"))


def classify(existing: DataFrame, derived: DataFrame, ids: DataFrame, content: tuple[str, ...] = ("severity", "risk_score")) -> DataFrame:
    """existing's columns and status, previous: the lifecycle of every threat of either table.

    In both: modified if a ``content`` field differs (the new row, the old one in ``previous``), else existing. Only old:
    resolved if one of its components was removed, else existing. Only derived: new. Threats that ``ids`` leave alone stand in
    both. Rows that repeat a threat count once; of different threats with one id each old one meets each new one.
    """
    cols = [c for c in existing.columns if c != "threat_id"]
    same = ["threat_id", *[c for c in ("stride", "threat", "components") if c in cols]]
    once = lambda df, *first: df.groupBy(*same).agg(F.max(F.struct(*first, *[c for c in cols if c not in same])).alias("_r")).select(*same, "_r.*").select("threat_id", *cols)
    packed = lambda df, name, *more: df.select("threat_id", F.struct(*cols).alias(name), *more)
    old = once(existing).join(_states(existing, ids).withColumnRenamed("removed", "_lost"), ["threat_id", "components"], "left")
    now = once(old.where("_lost is null").select("threat_id", *cols, F.lit(0).alias("_p")).unionByName(derived.select("threat_id", *cols, F.lit(1).alias("_p"))), "_p")
    both = packed(old, "_o", "_lost").join(packed(now, "_n"), "threat_id", "full_outer")
    differs = reduce(lambda a, b: a | b, [~F.col("_o")[c].eqNullSafe(F.col("_n")[c]) for c in content])
    status = (
        F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNotNull(), F.when(differs, "modified").otherwise("existing")).when(F.col("_lost"), "resolved").otherwise("existing")
    )
    shown = F.when(status.isin("new", "modified"), F.col("_n")).otherwise(F.col("_o"))
    out = both.select("threat_id", shown.alias("_s"), status.alias("status"), F.when(status == "modified", F.col("_o")).alias("previous"))
    return out.select("threat_id", "_s.*", "status", "previous")


def update(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame], catalog: DataFrame, existing: DataFrame) -> DataFrame:
    """The lifecycle of all threats after a change of snapshot; ``old`` and ``new`` are (components, flows)."""
    ids = affected(changes(old[0], new[0], ["id"]), changes(old[1], new[1], ["source", "target"]))
    return classify(existing, derive(*touched(*new, ids), catalog), ids)


def current(lifecycle: DataFrame) -> DataFrame:
    """What the next version starts from: all threats that are not resolved, without their status."""
    return lifecycle.where("status <> 'resolved'").drop("status", "previous")


def touched_threats(threats: DataFrame, ids: DataFrame) -> DataFrame:
    """threats with ``state``: orphaned if a component was removed, affected if one is among ``ids``, else unaffected."""
    state = F.when(F.col("removed"), "orphaned").when(~F.col("removed"), "affected").otherwise("unaffected")
    return threats.join(_states(threats, ids), ["threat_id", "components"], "left").select(*threats.columns, state.alias("state"))
