"""Command line: init, debug, profile, monitor, baseline, diff, run, report, redact, serve."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pellucid.errors import CheckError

_SAMPLE = """suite: sample
conformance:
  - id: orders-have-items
    check: no_orphans
    with: {label: Order, rel_type: CONTAINS, direction: out}
  - id: part-names-are-unique
    check: uniqueness
    severity: warn
    with: {label: Part, property: p_name}
"""


def _graph(args):
    from pyspark.sql import SparkSession

    from pellucid.sources.tables import load_graph

    spark = SparkSession.builder.appName("pellucid").config("spark.sql.session.timeZone", "UTC").config("spark.scheduler.mode", "FAIR").getOrCreate()
    return load_graph(spark, args.data)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="pellucid", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, *args):
        p = sub.add_parser(name)
        for flags, more in args:
            p.add_argument(*flags, **more)
        return p

    data = (("--data",), {"required": True, "help": "folder of the tables"})
    folder = lambda flag, default: ((flag,), {"default": default})
    command("init", folder("--checks", "checks"))
    command("debug", data, folder("--checks", "checks"))
    command("profile", data, folder("--baselines", "baselines"))
    command("monitor", data, (("--rounds",), {"type": int, "default": 1}), (("--interval",), {"type": float, "default": 15.0}))
    command("baseline", (("name",), {}), folder("--baselines", "baselines"))
    command("diff", folder("--baselines", "baselines"), (("--from",), {"dest": "a"}), (("--to",), {"dest": "b"}), (("--json",), {"action": "store_true"}))
    command("run", data, folder("--checks", "checks"), folder("--runs", "runs"), folder("--baselines", "baselines"), (("--packs",), {"help": "folder of pack manifests"}), (("--select",), {}), (("--suite",), {}), (("--fail-fast",), {"action": "store_true"}), (("--seed",), {"default": 0}), (("--concurrency",), {"type": int, "default": 1}))
    command(
        "report", folder("--runs", "runs"), (("run",), {"nargs": "*", "help": "run ids; none: the newest"}), (("--list",), {"action": "store_true"}), (("--failures-only",), {"action": "store_true"}),
        (("--verdict",), {"action": "append", "choices": ("pass", "fail", "warn", "errored", "skipped")}), (("--json",), {"action": "store_true"}),
    )
    command("redact", folder("--runs", "runs"), (("run",), {}))
    command("serve", data, folder("--checks", "checks"), folder("--runs", "runs"))
    args = top.parse_args(argv)
    try:
        return globals()[f"_{args.command}"](args)
    except CheckError as e:
        print(e, file=sys.stderr)
        return 3 if args.command == "run" else 2


def _init(args) -> int:
    path = Path(args.checks) / "sample.yml"
    if path.exists():
        raise CheckError("init.exists", f"{path} is there already")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(_SAMPLE)
    return 0


def _debug(args) -> int:
    from pellucid.runner import blocked_checks
    from pellucid.sources.suites import load_suites

    graph = _graph(args)
    print(json.dumps({"target": graph.target(), "blocked": blocked_checks(graph.capabilities, load_suites(args.checks))}, indent=2))
    return 0


def _profile(args) -> int:
    from pellucid.baseline import Snapshots
    from pellucid.profiler import profile

    found = profile(_graph(args))
    print(Snapshots(args.baselines).write(found))
    return 0 if found["status"] == "complete" else 2


def _monitor(args) -> int:
    from pellucid.streaming.monitor import Metrics, check_health

    graph, metrics = _graph(args), Metrics()
    for i in range(args.rounds):
        if i:
            time.sleep(args.interval)
        began = time.monotonic()
        metrics.record(check_health(graph.spark), time.monotonic() - began)
    print(metrics.text(), end="")
    return 0 if metrics.connected else 1


def _baseline(args) -> int:
    from pellucid.baseline import Snapshots

    Snapshots(args.baselines).set_current(args.name)
    return 0


def _diff(args) -> int:
    from pellucid import diff
    from pellucid.baseline import Snapshots

    store = Snapshots(args.baselines)
    found = diff.compare(*map(store.read, store.pair(args.a, args.b)))
    print(json.dumps(found, indent=2) if args.json else diff.render(found))
    return diff.exit_code(found, args.json)


def _run(args) -> int:
    from pellucid.baseline import Snapshots
    from pellucid.history import Runs
    from pellucid.report import headline, html
    from pellucid.runner import Options, run_suites
    from pellucid.sources.suites import load_what_can_be, parse_selector

    if args.packs:
        from pellucid.packs import load_packs

        load_packs(args.packs)
    tag = parse_selector(args.select) if args.select else None
    suites, broken = load_what_can_be(args.checks, args.suite)
    results = run_suites(_graph(args), suites, Options(tags=(tag,) if tag else (), fail_fast=args.fail_fast, seed=args.seed, concurrency=args.concurrency, baselines=Snapshots(args.baselines)), broken)
    Runs(args.runs).write(results, html(results))
    print(headline(results))
    return results["run"]["exit_code"]


def _report(args) -> int:
    """A page for each run asked for; with --json the checks, worst first; with --list the stored runs."""
    from pellucid.history import Runs, chosen_ids, listing
    from pellucid.report import FAILURES, html, ordered

    store = Runs(args.runs)
    if args.list:
        print(json.dumps(listing(store.all()), indent=2))
        return 0
    if not args.run:
        newest = store.all()[:1]
        if not newest:
            raise CheckError("history.not_found", "no run is stored")
        runs = newest
    else:
        runs = [store.read(x) for x in chosen_ids(args.run)]
    verdicts = tuple(args.verdict) if args.verdict else FAILURES if args.failures_only else None
    for results in runs:
        print(json.dumps({"id": results["run"]["id"], "checks": ordered(results["checks"], verdicts)}, indent=2) if args.json else html(results, verdicts))
    return 0


def _serve(args) -> int:
    """Tools for agents over standard input and output, until the input ends."""
    from functools import partial

    from pellucid import tools
    from pellucid.serve import Server

    graph = _graph(args)
    Server({"list_checks": partial(tools.list_checks, args.checks), "get_results": partial(tools.get_results, args.runs), "run_suite": lambda suite: tools.run_suite(graph, args.checks, args.runs, suite)}).run(sys.stdin, sys.stdout)
    return 0


def _redact(args) -> int:
    from pellucid.history import Runs
    from pellucid.redaction import redact

    print(json.dumps(redact(Runs(args.runs).read(args.run)), indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
