"""Checks as lazy DataFrame plans."""

from pellucid.plans.base import CheckPlan, SharedScan, fuse

__all__ = ["CheckPlan", "SharedScan", "fuse"]
