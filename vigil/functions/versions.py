"""Version numbers: parsing, comparison and range constraints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH, PARTS = 10, 6


def sort_key(v: Column) -> Column:
    """A text that orders as the version does: numeric parts padded with zeros, missing ones zero, a pre-release before its release.

    Only the first six parts count.
    """
    bare = F.regexp_replace(F.lower(F.trim(v)), "^[v=]+", "")
    core = F.regexp_extract(bare, r"^(\d+(?:\.\d+)*)", 1)
    pre = F.regexp_extract(bare, r"^\d+(?:\.\d+)*[-.]?([a-z].*)$", 1)
    nums = F.slice(F.concat(F.split(core, r"\."), F.array_repeat(F.lit("0"), PARTS)), 1, PARTS)
    padded = F.array_join(F.transform(nums, lambda x: F.lpad(x, WIDTH, "0")), ".")
    return F.when(core == "", None).otherwise(F.concat(padded, F.when(pre == "", F.lit("~")).otherwise(F.concat(F.lit("-"), pre))))


def satisfies(version: Column, constraint: Column) -> Column:
    """A conjunction such as '>=1.0.0,<2.0.0' (also '=', '!=', '>', '<=' and a bare version); null if the version is none."""
    key = sort_key(version)

    def holds(part: Column) -> Column:
        op = F.regexp_extract(part, r"^(>=|<=|==|!=|=|>|<)?", 1)
        want = sort_key(F.regexp_replace(part, r"^(>=|<=|==|!=|=|>|<)\s*", ""))
        return F.when(op == ">=", key >= want).when(op == "<=", key <= want).when(op == ">", key > want).when(op == "<", key < want).when(op == "!=", key != want).otherwise(key == want)

    return F.forall(F.transform(F.split(constraint, ","), lambda p: F.trim(p)), holds)


def satisfies_any(version: Column, constraints: Column) -> Column:
    """Any of an array of conjunctions."""
    return F.exists(constraints, lambda c: satisfies(version, c))
