"""Runs suites against a graph: selection, isolation of failures, deadline, fail-fast, results."""

from __future__ import annotations

import datetime as dt
import threading
import time
import uuid
from collections import Counter
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pellucid import baseline as bl
from pellucid import scoring
from pellucid.errors import CheckError, SchemaReferenceMissing
from pellucid.events import EventLog, timed
from pellucid.functions.sampling import check_seed, half_even, wilson
from pellucid.graph import PropertyGraph
from pellucid.operators import CHECKS
from pellucid.operators import competency as comp
from pellucid.plans import SharedScan
from pellucid.plans.degrees import SharedDegrees
from pellucid.plans.drift import SharedDrift, drift_metric
from pellucid.plans.pii import DEFAULT_SAMPLE, PiiPlan
from pellucid.sources.suites import Competency, Conformance, Drift, LoadedCheck, Suite, load_suite
from pellucid.sqlguard import require_read_only

VERSION, SCHEMA_VERSION = "0.1.0", "1.2"
#: Scalars that a summary may have beside population and violations.
_EXTRA = ("conforming_count", "coverage", "sample_size", "mean_degree", "degree_stddev")


@dataclass
class Options:
    wall_seconds: float = 295.0
    evidence_cap: int = 100
    row_ceiling: int = comp.ROW_CEILING
    exhaustive_limit: int = 100_000
    sample_size: int = 10_000
    seed: int | str = 0
    concurrency: int = 1
    fail_fast: bool = False
    tags: tuple[str, ...] = ()
    baselines: object = None
    clock: object = time.monotonic
    #: Gets every event of the run as it comes.
    events: object = None


@dataclass
class _Run:
    graph: PropertyGraph
    options: Options
    deadline: float
    partial: list[str] = field(default_factory=list)
    stop: threading.Event = field(default_factory=threading.Event)
    shared: dict = field(default_factory=dict)
    log: EventLog | None = None


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def run_suites(graph: PropertyGraph, suites: Iterable[Suite], options: Options | None = None, broken: Iterable[str] = ()) -> dict:
    """Runs every selected check and returns the results (schema 1.2).

    A check that raises is errored and the rest goes on; a graph that cannot be probed fails the run. Checks
    whose capability is absent are skipped and make the run partial; so do those that the deadline leaves, and
    suites that could not be loaded (broken: why). Predicate checks over one table share a scan.
    """
    options = options or Options()
    suites, began, run_id = list(suites), _now(), f"run_{uuid.uuid4().hex[:12]}"
    ids = [s.id for s in suites]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        return _results(graph, suites, [], options, began, run_id, "failed", error={"code": "engine.duplicate_suite", "message": f"suites stand twice: {', '.join(twice)}"})
    probed = time.monotonic()
    try:
        graph.counts()
    except Exception as e:
        return _results(None, suites, [], options, began, run_id, "failed", error={"code": getattr(e, "code", "engine.target_missing"), "message": str(e).splitlines()[0]})
    state = _Run(graph, options, options.clock() + options.wall_seconds, list(broken))
    tasks = [(s, c) for s in suites for c in s.checks if not options.tags or set(options.tags) & set(c.tags)]
    state.log = EventLog(run_id, options.events)
    state.log.emit("run_started", selected=len(tasks))
    state.log.emit("probe_finished", ms=round(1000 * (time.monotonic() - probed)))
    if not options.fail_fast:  # a run that may stop early computes nothing ahead
        state.shared = _shared_scans(state, tasks)
    if options.concurrency > 1 and not options.fail_fast:
        with ThreadPoolExecutor(options.concurrency) as pool:
            found = list(pool.map(lambda t: _logged(state, *t), enumerate(tasks, 1)))
    else:
        found = []
        for t in enumerate(tasks, 1):
            found.append(_logged(state, *t))
            if options.fail_fast and (found[-1]["verdict"] == "fail" or found[-1]["verdict"] == "errored" and found[-1]["severity"] == "error"):
                state.stop.set()
                for i, (s, c) in enumerate(tasks[len(found) :], len(found) + 1):
                    found.append(_skipped(s, c, "not_run"))
                    state.log.processed(i, state.log.start(i), found[-1])
                break
    queries, verdicts = state.log.queries(), Counter(c["verdict"] for c in found)
    state.log.emit("run_finished", queries=len(queries), query_ms=sum(e["ms"] for e in queries), verdicts=dict(verdicts))
    return _results(graph, suites, found, options, began, run_id, "partial" if state.partial else "complete", reason="; ".join(dict.fromkeys(state.partial)) or None)


def run_yaml(graph: PropertyGraph, text: str, options: Options | None = None) -> dict:
    """Runs a suite that is given as YAML; one that does not load is a failed run, not an exception."""
    try:
        suite = load_suite(text)
    except CheckError as e:
        return _results(None, [], [], options or Options(), _now(), f"run_{uuid.uuid4().hex[:12]}", "failed", error={"code": e.code, "message": e.message})
    return run_suites(graph, [suite], options)


def compile_check(graph: PropertyGraph, suite: Suite, check: LoadedCheck, options: Options | None = None):
    """What a check runs, without running it: a CheckPlan, or the DataFrame of a competency query."""
    options = options or Options()
    if isinstance(check.spec, Conformance):
        return CHECKS[check.spec.check].plan(graph, **_arguments(graph, suite, check, options))
    if isinstance(check.spec, Drift):
        return drift_metric(graph, check.spec.metric, check.spec.target)
    return _query(graph, check.spec, comp.bind(graph, check.spec.query, check.spec.params))


def _shared_scans(state: _Run, tasks: list) -> dict:
    """What a check shares with others, by suite and check id: a scan of one base, a table of degrees, the drift measures of all."""
    bases: dict[tuple, dict] = {}
    asks: dict[tuple, dict] = {}
    drifts: dict[tuple, tuple] = {}
    for suite, check in tasks:
        if check.generated:
            continue
        if isinstance(check.spec, Drift):
            drifts[suite.id, check.id] = (check.spec.metric, check.spec.target)
        if not isinstance(check.spec, Conformance) or CHECKS[check.spec.check].pack == "pii" or not all(state.graph.capabilities.get(c) for c in CHECKS[check.spec.check].requires):
            continue
        try:
            plan = CHECKS[check.spec.check].plan(state.graph, **_arguments(state.graph, suite, check, state.options))
        except Exception:  # the check will say so itself
            continue
        if plan.degrees is not None:
            asks.setdefault(plan.degrees.key, {})[suite.id, check.id] = plan.degrees
        elif plan.base_key is not None:
            bases.setdefault(plan.base_key, {})[suite.id, check.id] = plan
    shared = {key: scan for plans in bases.values() if len(plans) > 1 for scan in [SharedScan(plans)] for key in plans}
    shared |= {key: table for own in asks.values() if len(own) > 1 for table in [SharedDegrees(state.graph, own)] for key in own}
    measured = SharedDrift(state.graph, drifts)
    return shared | dict.fromkeys(drifts, measured)


def _arguments(graph: PropertyGraph, suite: Suite, check: LoadedCheck, options: Options) -> dict:
    """What a check's plan is built from: what the suite gives, and for one that samples the merged policy and its own seed."""
    given = dict(check.spec.with_)
    if not CHECKS[check.spec.check].sampled:
        return given
    asked = given.pop("sample_size", None)
    size = min(options.sample_size, asked if asked is not None else DEFAULT_SAMPLE)
    sampled = {"sample_size": size, "seed": check_seed(options.seed, graph.fingerprint(), suite.sha, check.id)}
    if CHECKS[check.spec.check].runs == "hub_outlier":
        sampled["exhaustive_limit"] = min(options.exhaustive_limit, asked) if asked is not None else options.exhaustive_limit
    return given | sampled


def _base(suite: Suite, check: LoadedCheck) -> dict:
    return {
        "id": check.id, "suite_id": suite.id, "pattern": check.pattern, "name": check.name, "provenance": check.spec.provenance, "severity": check.severity, "verdict": None, "skip_reason": None, "started_at": None,
        "duration_ms": None, "compiled_query": None, "params": {}, "measured": {}, "expected": {}, "estimate": False, "evidence": None, "error": None,
    }


def _skipped(suite: Suite, check: LoadedCheck, why: str) -> dict:
    return _base(suite, check) | {"verdict": "skipped", "skip_reason": why}


def _one(state: _Run, suite: Suite, check: LoadedCheck) -> dict:
    options, clock = state.options, state.options.clock
    if check.generated:
        return _skipped(suite, check, "generated")
    if isinstance(check.spec, Conformance) and (needs := [c for c in CHECKS[check.spec.check].requires if not state.graph.capabilities.get(c)]):
        state.partial.append(f"unsupported: {', '.join(needs)}")
        return _skipped(suite, check, "unsupported")
    if state.stop.is_set() or clock() >= state.deadline:
        if not state.stop.is_set():
            state.partial.append("deadline")
        return _skipped(suite, check, "not_run")
    out, began = _base(suite, check) | {"started_at": _now()}, time.monotonic()
    sc, tag = state.graph.spark.sparkContext, f"check-{uuid.uuid4().hex}"
    if options.concurrency > 1:
        sc.setLocalProperty("spark.scheduler.pool", "checks")  # holds for this worker thread alone
    timer = threading.Timer(max(0.0, state.deadline - clock()), lambda: sc.cancelJobsWithTag(tag))
    timer.daemon = True
    sc.addJobTag(tag)
    timer.start()
    try:
        out |= evaluate(state.graph, suite, check, options, state.shared)
    except CheckError as e:
        out |= {"verdict": "errored", "error": {"code": e.code, "message": e.message}}
    except Exception as e:
        late = clock() >= state.deadline
        out |= {"verdict": "errored", "error": {"code": "engine.timeout" if late else "engine.internal_error", "message": (str(e) or type(e).__name__).splitlines()[0][:500]}}
        if late:
            state.partial.append("deadline")
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
    out["duration_ms"] = round(1000 * (time.monotonic() - began))
    return out


def _logged(state: _Run, number: int, task: tuple) -> dict:
    token = state.log.start(number)
    out = _one(state, *task)
    state.log.processed(number, token, out)
    return out


def _verdict(passed: bool, severity: str) -> str:
    return "pass" if passed else "fail" if severity == "error" else "warn"


def evaluate(graph: PropertyGraph, suite: Suite, check: LoadedCheck, options: Options, shared: dict | None = None) -> dict:
    """Measures one check; evidence is collected only if it fails. shared: scans that other checks take part in."""
    if isinstance(check.spec, Conformance):
        passed, rest = _conformance(graph, suite, check, options, (shared or {}).get((suite.id, check.id)))
    else:
        passed, rest = _competency(graph, suite, check, options) if isinstance(check.spec, Competency) else _drift(graph, suite, check, options, (shared or {}).get((suite.id, check.id)))
    return rest | {"verdict": _verdict(passed, check.severity)}


def _conformance(graph, suite, check, options, scan=None):
    spec, entry = check.spec, CHECKS[check.spec.check]
    given = _arguments(graph, suite, check, options)
    try:
        plan = entry.plan(graph, **given)
    except SchemaReferenceMissing:
        if not graph.is_empty():
            raise
        return True, {"params": given, "measured": {"population": 0, "violations": 0, "violation_count": 0}, "expected": {"violations": 0}}
    row = timed(lambda: plan.row(scan.row((suite.id, check.id)) if scan is not None else None))
    population, bad = row["population"], row["violation_count"]
    measured = {"population": population, "violations": bad, "violation_count": bad} | {k: row[k] for k in _EXTRA if k in row}
    expected = {"violations": 0}
    passed = bad == 0
    if entry.runs == "completeness":
        threshold = given.get("threshold", 1.0)
        passed, expected, measured = row["coverage"] >= threshold, {"threshold": threshold}, {"coverage": row["coverage"], "population": population, "violations": bad}
    out = {"params": given, "measured": measured, "expected": expected}
    size = row.get("sample_size")
    if size is not None:
        wanted = min(population, given.get("sample_size", population))
        exact = size == population if plan.degrees is not None else size <= max(wanted, 0)
        if not (0 <= bad <= size <= population and (size > 0 or population == 0) and exact):
            raise CheckError("engine.invalid_query_result", f"{bad} violations, {size} sampled of {wanted} wanted, {population} in all")
    if size is not None and 0 < size < population:
        out["estimate"] = wilson(bad, size, population)
    if isinstance(plan, PiiPlan) and bad:
        # the matched values stay in the plan: a finding names a place, an extrapolated count and a confidence
        measured["findings"] = [
            {"pattern": r["pattern"], "location": {"labels": list(r["labels"]), "property": r["property"]}, "exposure_count": half_even(population * r["observed"], size), "confidence": plan.measured["confidence"]}
            for r in timed(plan.findings.orderBy("pattern", "property", "labels").collect)
        ]
    if not passed:
        rows = [r.asDict() for r in timed(plan.capped(options.evidence_cap).collect)]
        out["evidence"] = comp.evidence([r | {"labels": list(r["labels"]) if r["labels"] is not None else None} for r in rows], f"{bad} of {population} violate {spec.check}", options.evidence_cap, bad)
    return passed, out


def _query(graph: PropertyGraph, spec: Competency, params: dict):
    """The result of a competency query, analysed but not run."""
    require_read_only(graph.spark, spec.query)
    graph.register_views(spec.query)
    try:
        df = graph.spark.sql(spec.query, args=params)
        df.schema  # noqa: B018 - analysis happens here
    except Exception as e:
        text = str(e)
        if "TABLE_OR_VIEW_NOT_FOUND" in text or "UNRESOLVED_COLUMN" in text:
            raise CheckError("engine.schema_reference_missing", text.splitlines()[0]) from None
        if "UNBOUND_SQL_PARAMETER" in text:
            raise CheckError("engine.parameter_missing", text.splitlines()[0]) from None
        raise
    return df


def _competency(graph, suite, check, options):
    spec = check.spec
    params = comp.bind(graph, spec.query, spec.params)
    df = _query(graph, spec, params)
    found = timed(lambda: comp.assess(df, spec.expect, options.row_ceiling, options.evidence_cap))
    out = {"compiled_query": spec.query, "params": params, "measured": found.measured, "expected": spec.expect.model_dump(exclude_none=True)}
    if not found.passed:
        elements = comp.pointers(found.rows) + comp.pointers(params)
        if not elements:
            raise CheckError("engine.evidence_missing", "a failing result points at no element: project node_element_id or rel_element_id")
        out["evidence"] = comp.evidence(elements, "; ".join(found.failures), options.evidence_cap, len(found.rows))
    return found.passed, out


def _drift(graph, suite, check, options, measured=None):
    spec = check.spec
    bl.check_tolerance(spec.tolerance)
    source = options.baselines
    base = source.resolve(spec.baseline) if hasattr(source, "resolve") else source.get(spec.baseline, source if "statistics" in source or spec.metric in source else None) if isinstance(source, dict) else source
    before = bl.require(base, spec.metric, spec.target)
    plan = drift_metric(graph, spec.metric, spec.target)
    row = None if measured is None else timed(lambda: measured.row((suite.id, check.id)))
    now = (timed(plan.summary.first) if row is None else row)["current"]
    if spec.metric == "property_coverage" and not (0 <= now <= 100 and 0 <= before <= 100):
        raise CheckError("engine.baseline_invalid", "coverage is a percentage")
    broken = bl.within(spec.tolerance, now, before)
    out = {"params": dict(spec.target), "measured": bl.drift_measured(now, before), "expected": dict(spec.tolerance)}
    if broken:
        key = f"{spec.metric}:{bl.target_key(spec.target)}"
        label = spec.target.get("label")
        own = {"kind": "aggregate", "id": key, "labels": None if label is None else [label], "type": spec.target.get("type")}
        out["evidence"] = comp.evidence([own, *bl.entry_evidence(base, spec.metric, spec.target)], "; ".join(broken), options.evidence_cap)
    return not broken, out


def _results(graph, suites, checks, options, began, run_id, status, reason=None, error=None) -> dict:
    code = scoring.exit_code(checks, status)
    return {
        "schema_version": SCHEMA_VERSION,
        "run": {
            "id": run_id, "started_at": began, "finished_at": _now(), "version": VERSION, "pack_version": VERSION, "status": status, "partial_reason": reason, "exit_code": code,
            "selection": {"suites": [s.id for s in suites], "tags": list(options.tags), "fail_fast": options.fail_fast}, "redaction": {"policy": "none", "applied": False}, "target": graph.target() if graph is not None and status != "failed" else None, "error": error,
        },
        "score": {"value": scoring.score(checks).value, "method": "weighted-by-severity", "weights": dict(scoring.WEIGHTS)},
        "totals": scoring.totals(checks),
        "suites": [{"id": s.id, "source_sha": s.sha, "score": scoring.score(own).value, "totals": scoring.totals(own)} for s in suites for own in [[c for c in checks if c["suite_id"] == s.id]]],
        "checks": checks,
    }


def check_results(results: dict) -> None:
    """What a stored result must satisfy on every load: totals, scores and exit code follow from its checks."""
    checks, run = results["checks"], results["run"]
    wrong = []
    if results["totals"] != scoring.totals(checks):
        wrong.append("totals")
    if results["score"]["value"] != scoring.score(checks).value:
        wrong.append("score")
    if run["exit_code"] != scoring.exit_code(checks, run["status"]):
        wrong.append("exit_code")
    for s in results["suites"]:
        own = [c for c in checks if c["suite_id"] == s["id"]]
        if s["totals"] != scoring.totals(own) or s["score"] != scoring.score(own).value:
            wrong.append(f"suite {s['id']}")
    if wrong:
        raise CheckError("results.invalid", f"do not follow from the checks: {', '.join(wrong)}")


def blocked_checks(capabilities: dict, suites: Iterable[Suite]) -> list[dict]:
    """Conformance checks that a graph with these capabilities cannot run."""
    return [
        {"suite_id": s.id, "id": c.id, "missing": missing} for s in suites for c in s.checks if isinstance(c.spec, Conformance)
        if (missing := [x for x in CHECKS[c.spec.check].requires if not capabilities.get(x)])
    ]
