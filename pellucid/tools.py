"""Functions for agents and other callers: list checks, read results, run a suite. Plain data in, plain data out."""

from __future__ import annotations

import json
from pathlib import Path

from pellucid.errors import CheckError
from pellucid.graph import PropertyGraph
from pellucid.history import Runs
from pellucid.report import html
from pellucid.runner import Options, check_results, run_suites
from pellucid.sources.suites import load_suites


def list_checks(checks: str | Path) -> dict:
    """Every suite under a folder with its checks (id, kind, severity, tags, generated); nothing is run."""
    show = lambda c: {"id": c.id, "kind": c.pattern, "severity": c.severity, "tags": list(c.tags), "generated": c.generated}
    return {"suites": [{"suite": s.id, "checks": list(map(show, s.checks))} for s in load_suites(checks)]}


def get_results(runs: str | Path, run_id: str = "latest") -> dict:
    """A stored run; errors name no path. A run id with separators or dots that lead elsewhere is refused."""
    if not run_id or run_id in (".", "..") or any(x in run_id for x in ("/", "\\", "..")):
        raise CheckError("mcp.invalid_run_id", "a run id has no path in it")
    path = Path(runs) / run_id / "results.json"
    if Path(runs).resolve() not in path.resolve().parents:
        raise CheckError("mcp.invalid_run_id", "the run id leads outside the folder of runs")
    if not path.is_file():
        raise CheckError("mcp.results_not_found", "no results are stored under that run id")
    try:
        found = json.loads(path.read_text())
        check_results(found)
    except (OSError, ValueError, KeyError, TypeError, CheckError):
        raise CheckError("mcp.results_unreadable", "the stored results cannot be read") from None
    return found


def run_suite(graph: PropertyGraph, checks: str | Path, runs: str | Path, suite: str, options: Options | None = None) -> dict:
    """Runs one suite, stores the run and returns its results."""
    chosen = load_suites(checks, suite=suite)
    if not chosen:
        raise CheckError("run.suite_unknown", f"no suite {suite}")
    results = run_suites(graph, chosen, options)
    try:
        Runs(runs).write(results, html(results))
    except OSError:
        raise CheckError("mcp.artifact_write_failed", "the run ended, but its results could not be stored") from None
    return results
