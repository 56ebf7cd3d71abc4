"""Three-valued logic, outcomes, risks, versions and state machines.

Unknown is null, so SQL's AND, OR and NOT are Kleene's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOMES = ["NOT_APPLICABLE", "PASS", "REVIEW", "FAIL"]
RISKS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
#: Allowed changes of state with the role that makes them; fixed values.
SOURCE_MOVES = [(None, "UPLOADED", "AUTHOR"), ("UPLOADED", "REVIEWED", "REVIEWER"), ("REVIEWED", "APPROVED", "APPROVER"), ("APPROVED", "RETIRED", "APPROVER")]
CARD_MOVES = [(None, "DRAFT", "AUTHOR"), ("DRAFT", "IN_REVIEW", "AUTHOR"), ("IN_REVIEW", "APPROVED", "APPROVER"), ("IN_REVIEW", "CHANGES_REQUESTED", "REVIEWER"), ("APPROVED", "RETIRED", "APPROVER")]
SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-((?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*)(?:\.(?:0|[1-9]\d*|\d*[A-Za-z-][0-9A-Za-z-]*))*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?$"


def kleene_not(a: Column) -> Column:
    return ~a


def kleene_and(*cs: Column) -> Column:
    return reduce(lambda a, b: a & b, cs)


def kleene_or(*cs: Column) -> Column:
    return reduce(lambda a, b: a | b, cs)


def derive_outcome(applies: Column, exception: Column, satisfied: Column) -> Column:
    """The decision ladder; unknown anywhere on the way is REVIEW."""
    return (
        F.when(applies.isNull(), "REVIEW").when(~applies, "NOT_APPLICABLE")
        .when(exception.isNull(), "REVIEW").when(exception, "NOT_APPLICABLE")
        .when(satisfied.isNull(), "REVIEW").when(satisfied, "PASS").otherwise("FAIL")
    )


def rank(c: Column, names: list[str]) -> Column:
    """Place of a name in a list, from 0; null for others."""
    return reduce(lambda w, i: w.when(c == names[i], i), range(1, len(names)), F.when(c == names[0], 0))


def effective_risk(*cs: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RISKS)), F.greatest(*[rank(c, RISKS) for c in cs]) + 1)


def approvals_needed(risk: Column) -> Column:
    return F.when(risk.isin("HIGH", "CRITICAL"), 2).otherwise(1)


def valid_transition(moves: list[tuple], before: Column, after: Column, role: Column, independent: Column, reason: Column) -> Column:
    """A listed move by its role; reviewers and approvers must be independent, retiring needs a reason."""
    ok = F.lit(False)
    for a, b, who in moves:
        ok = ok | ((before.isNull() if a is None else before.eqNullSafe(F.lit(a))) & (after == b) & (role == who))
    return ok & (role.isin("AUTHOR") | independent) & ((after != "RETIRED") | (F.coalesce(F.trim(reason), F.lit("")) != ""))


def semver_sort_key(c: Column) -> Column:
    """A struct that orders as SemVer 2.0.0: numbers by value, a release behind its
    pre-releases, numeric identifiers before others; build metadata does not count.
    Null for other texts.  Numbers are compared by length, then as texts."""
    number = lambda x: F.struct(F.length(x).alias("l"), x.alias("t"))
    core = [number(F.regexp_extract(c, SEMVER, i)) for i in (1, 2, 3)]
    pre = F.regexp_extract(c, SEMVER, 4)
    parts = F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike(r"^\d+$"), F.struct(F.lit(0).alias("k"), F.length(x).alias("l"), x.alias("t"))).otherwise(F.struct(F.lit(1).alias("k"), F.lit(0).alias("l"), x.alias("t"))))
    return F.when(c.rlike(SEMVER), F.struct(*[x.alias(n) for x, n in zip(core, ("major", "minor", "patch"))], (pre == "").alias("release"), F.when(pre == "", F.array().cast("array<struct<k:int,l:int,t:string>>")).otherwise(parts).alias("pre")))


def compare_semver(a: Column, b: Column) -> Column:
    x, y = semver_sort_key(a), semver_sort_key(b)
    return F.when(x < y, -1).when(x == y, 0).when(x > y, 1)
