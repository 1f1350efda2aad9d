"""Imports every plan module so the registry is complete."""

from plumbline.plans import associations, audits, claimtables, clusterings, profiles, reductions, splits, verdicts  # noqa: F401
from plumbline.plans.registry import PLANS, SQL

__all__ = ["PLANS", "SQL"]
