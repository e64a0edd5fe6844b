"""Entry points for callers: suites as text, checks compiled without running, reports of stored runs."""

import json

import pytest

from pellucid import cli
from pellucid.graph import NodeSet, PropertyGraph, RelSet
from pellucid.history import Runs
from pellucid.plans import CheckPlan
from pellucid.report import html
from pellucid.runner import compile_check, evaluate, run_yaml
from pellucid.runner import Options
from pellucid.sources.suites import load_suite

SUITE = """
suite: s
conformance:
  - {id: named, check: completeness, with: {label: N, property: name}}
  - {id: hubs, check: hub_outlier, with: {label: N}}
competency:
  - {id: two, question: q, query: "SELECT node_element_id FROM node_N WHERE id = :x", params: {x: a}, expect: {rows: {exactly: 1}}}
  - {id: typo, question: q, query: "SELECT nothing FROM node_N", expect: {empty: true}}
drift:
  - {id: fewer, metric: node_count, target: {label: N}, tolerance: {max_drop_pct: 1}}
"""


@pytest.fixture(scope="module")
def graph(spark):
    return PropertyGraph(spark, [NodeSet(("N",), spark.createDataFrame([("a", "x"), ("b", None)], "id string, name string"))], [RelSet("R", spark.createDataFrame([("r", "a", "b")], "id string, src string, dst string"))])


def test_run_yaml(graph):
    found = run_yaml(graph, SUITE, Options(baselines={"latest": {"node_count": {"label=N": 2}}}))
    assert {c["id"]: c["verdict"] for c in found["checks"]} == {"named": "fail", "hubs": "pass", "two": "pass", "typo": "errored", "fewer": "pass"}
    broken = run_yaml(graph, "suite: s\nwhat: 1")
    assert broken["run"]["status"] == "failed" and broken["run"]["error"]["code"] == "run.suite_invalid" and broken["checks"] == []


def test_checks_are_compiled_without_running(graph, spark):
    suite = load_suite(SUITE)
    by = {c.id: c for c in suite.checks}
    plans = {k: compile_check(graph, suite, by[k]) for k in ("named", "hubs", "fewer", "two")}
    assert all(isinstance(plans[k], CheckPlan) for k in ("named", "hubs", "fewer")) and plans["two"].columns == ["node_element_id"]
    assert plans["named"].summary.columns == ["population", "violation_count", "conforming_count", "coverage"]
    with pytest.raises(Exception, match="schema_reference_missing"):
        compile_check(graph, suite, by["typo"])
    assert evaluate(graph, suite, by["named"], Options())["verdict"] == "fail"


def test_reports_of_stored_runs(graph, tmp_path, capsys):
    store = Runs(tmp_path)
    runs = [run_yaml(graph, SUITE, Options(baselines={"latest": {"node_count": {"label=N": n}}})) for n in (2, 9)]
    for r in runs:
        store.write(r, html(r))
    say = lambda *args: (cli.main(["report", "--runs", str(tmp_path), *args]), capsys.readouterr().out)
    code, out = say("--list")
    assert code == 0 and {x["id"] for x in json.loads(out)} == {r["run"]["id"] for r in runs}
    ids = [r["run"]["id"] for r in runs]
    code, out = say(ids[0], ids[1])
    assert code == 0 and all(f"Run {i}" in out for i in ids) and out.count("<!doctype") == 2
    code, out = say(ids[1], "--json", "--verdict", "fail", "--verdict", "pass")
    assert [c["id"] for c in json.loads(out)["checks"]] == ["fewer", "named", "hubs", "two"]
    assert say(ids[1], "--json", "--failures-only")[1].count('"verdict"') == 3
    assert say()[0] == 0 and say("run_unknown")[0] == 2 and say(ids[0], ids[0])[0] == 2
