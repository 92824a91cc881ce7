"""Policies over findings and row visibility."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 200
ACTIONS_SCHEMA = "array<struct<type:string,target:string>>"


def active_policies(policies: DataFrame, policy_type: str) -> DataFrame:
    return policies.filter(F.col("is_active") & (F.col("policy_type") == policy_type))


def evaluate_policies(findings: DataFrame, policies: DataFrame | Iterable[dict]) -> DataFrame:
    """Findings that meet a policy, one row per match.

    A policy has `id`, `name`, `conditions` and `actions`, both JSON; the conditions `pii_type`, `severity` and
    `min_risk_score` all have to hold and an absent one holds for any finding. Policies are compiled into one expression
    per chunk, so the findings are read in place: there is no join and nothing is shuffled.
    """
    rows = [r.asDict() for r in policies.select("id", "name", "conditions", "actions").toLocalIterator()] \
        if isinstance(policies, DataFrame) else list(policies)
    usable = [(p, _condition(p.get("conditions"))) for p in rows]
    usable = [(p, c) for p, c in usable if c is not None]
    if not usable:
        return _matches(findings, [])
    return reduce(DataFrame.unionByName, [_matches(findings, usable[i:i + CHUNK]) for i in range(0, len(usable), CHUNK)])


def _condition(text):
    """The condition of a policy, None if it cannot be read; such a policy matches nothing and leaves the others alone."""
    try:
        wanted = json.loads(text or "")
        least = float(wanted["min_risk_score"]) if "min_risk_score" in wanted else None
    except (ValueError, TypeError):
        return None
    if not isinstance(wanted, dict):
        return None
    parts = [F.lit(True)]
    if "pii_type" in wanted:
        parts.append(F.col("pii_type") == str(wanted["pii_type"]))
    if "severity" in wanted:
        parts.append(F.col("severity") == str(wanted["severity"]))
    if least is not None:
        parts.append(F.col("risk_score") >= least)
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def _matches(findings, compiled):
    hits = [F.when(c, F.struct(F.lit(str(p["id"])).alias("policy_id"), F.lit(p["name"]).alias("policy_name"),
                               F.lit(p.get("actions") or "[]").alias("actions"))) for p, c in compiled]
    empty = F.array().cast("array<struct<policy_id:string,policy_name:string,actions:string>>")
    return findings.select("finding_id", F.inline(F.array_compact(F.array(*hits)) if hits else empty))


def policy_actions(matches: DataFrame) -> DataFrame:
    """Audit rows of the actions of matched policies; carrying them out is left to remediation."""
    return matches.select(
        "finding_id", "policy_id", "policy_name", F.lit("POLICY_MATCHED").alias("action"),
        F.inline(F.from_json("actions", ACTIONS_SCHEMA)).alias("action_type", "action_target"))


def apply_user_policy(df: DataFrame, allowed_sources: list[str] = (), allowed_tiers: list[str] = (),
                      suppressed_connectors: list[str] = ()) -> DataFrame:
    """Rows a user may see; an empty list does not restrict."""
    if allowed_sources:
        df = df.filter(F.col("source_name").isin(list(allowed_sources)))
    if allowed_tiers:
        df = df.filter(F.col("tier").isin(list(allowed_tiers)))
    if suppressed_connectors:
        df = df.filter(~F.col("connector").isin(list(suppressed_connectors)))
    return df
