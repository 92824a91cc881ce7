"""All registered queries: importing a plan module registers its queries."""

from datavigil.plans import actions, dashboards, detection, governance, scores  # noqa: F401
from datavigil.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
