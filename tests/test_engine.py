"""Suites, runs, competency, baselines, profiles, history and exports."""

import datetime as dt
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pellucid import baseline as bl
from pellucid import diff, report, scoring, tools
from pellucid.errors import CheckError
from pellucid.events import reconcile
from pellucid.functions import sampling
from pellucid.functions.checksums import luhn_ok, verhoeff_ok
from pellucid.graph import NodeSet, PropertyGraph, RelSet
from pellucid.history import Runs, compare_runs
from pellucid.operators import CHECKS
from pellucid.operators import competency as comp
from pellucid.profiler import profile
from pellucid.redaction import redact, secrets
from pellucid.runner import Options, blocked_checks, check_results, run_suites
from pellucid.sources.suites import Expect, Rows, load_suite, load_suites, load_what_can_be, parse_selector
from pellucid.sqlguard import require_read_only


@pytest.fixture(scope="module")
def graph(spark):
    people = spark.createDataFrame([("P:1", "Ann", True), ("P:2", "Bob", False), ("P:3", None, True)], "id string, name string, active boolean")
    knows = spark.createDataFrame([("k1", "P:1", "P:2")], "id string, src string, dst string")
    return PropertyGraph(spark, [NodeSet(("Customer",), people)], [RelSet("KNOWS", knows)])


SUITE = """
suite: people
defaults: {severity: error, tags: [prod]}
conformance:
  - {id: named, check: completeness, with: {label: Customer, property: name, threshold: 0.6}}
  - {id: named-all, check: completeness, with: {label: Customer, property: name}, tags: [strict]}
  - {id: linked, check: no_orphans, with: {label: Customer}, severity: warn}
  - {id: broken, check: completeness, with: {label: Nobody, property: name}}
  - {id: dangling, check: dangling_rels}
  - {id: idea, check: completeness, with: {label: Customer, property: name}, generated: true}
competency:
  - {id: few, question: How many, query: "SELECT node_element_id, name FROM node_Customer WHERE id = :who", params: {who: $first-active-customer}, expect: {rows: {exactly: 1}, columns: [node_element_id, name]}}
  - {id: names, question: Who, query: "SELECT name FROM node_Customer WHERE name IS NOT NULL", expect: {equals: [Bob, Ann]}}
  - {id: too-many, question: Too many, query: "SELECT node_element_id FROM node_Customer", expect: {rows: {max: 2}}}
  - {id: no-pointer, question: Pointer, query: "SELECT name FROM node_Customer", expect: {empty: true}}
  - {id: write, question: Write, query: "DROP TABLE x", expect: {empty: true}}
drift:
  - {id: shrunk, metric: node_count, target: {label: Customer}, tolerance: {max_drop_pct: 10}}
"""


@pytest.fixture(scope="module")
def results(graph):
    return run_suites(graph, [load_suite(SUITE)], Options(baselines={"latest": {"node_count": {"label=Customer": 5}}}))


def test_a_run_isolates_failures(results):
    got = {c["id"]: (c["verdict"], (c["error"] or {}).get("code"), c["skip_reason"]) for c in results["checks"]}
    assert got == {
        "named": ("pass", None, None), "named-all": ("fail", None, None), "linked": ("warn", None, None), "broken": ("errored", "engine.schema_reference_missing", None), "dangling": ("skipped", None, "unsupported"),
        "idea": ("skipped", None, "generated"), "few": ("pass", None, None), "names": ("pass", None, None), "too-many": ("fail", None, None), "no-pointer": ("errored", "engine.evidence_missing", None),
        "write": ("errored", "spark.write_rejected", None), "shrunk": ("fail", None, None),
    }
    assert results["run"]["status"] == "partial" and results["run"]["exit_code"] == 1
    by = {c["id"]: c for c in results["checks"]}
    assert by["named-all"]["evidence"]["elements"][0]["id"] == "P:3"
    assert by["linked"]["measured"]["violations"] == 1
    assert by["shrunk"]["measured"] == {"current": 3, "baseline": 5, "delta": -2, "change_pct": -40.0}
    assert by["shrunk"]["evidence"]["elements"][0] == {"kind": "aggregate", "id": "node_count:label=Customer", "labels": ["Customer"], "type": None}
    assert by["few"]["params"] == {"who": "P:1"}
    check_results(results)


def test_selection_fail_fast_and_deadline(graph):
    suite = load_suite(SUITE)
    only = run_suites(graph, [suite], Options(tags=("strict",)))
    assert [c["id"] for c in only["checks"]] == ["named-all"]
    fast = run_suites(graph, [suite], Options(fail_fast=True))
    assert [c["skip_reason"] for c in fast["checks"]].count("not_run") == len(suite.checks) - 2
    ticks = iter([0.0] + [1e9] * 99)
    late = run_suites(graph, [suite], Options(clock=lambda: next(ticks)))
    assert {c["verdict"] for c in late["checks"]} == {"skipped"} and late["run"]["status"] == "partial"
    assert run_suites(graph, [suite, suite])["run"]["error"]["code"] == "engine.duplicate_suite"
    assert blocked_checks(graph.capabilities, [suite]) == [{"suite_id": "people", "id": "dangling", "missing": ["store_consistency"]}]


def test_concurrent_runs_keep_the_order(graph):
    a, b = (run_suites(graph, [load_suite(SUITE)], Options(concurrency=n, baselines={"node_count": 3})) for n in (1, 4))
    assert [(c["id"], c["verdict"]) for c in a["checks"]] == [(c["id"], c["verdict"]) for c in b["checks"]]


@pytest.mark.parametrize("text", ["suite: a\nsuite: b", "conformance: [{id: x, check: nope}]", "conformance: [{id: x, check: uniqueness, with: {label: A}}]", "what: 1", "competency: [{id: x, question: q, query: s, expect: {}}]", "drift: [{id: x, metric: m}]", "competency: [{id: x, question: q, query: s, expect: {rows: {min: 3, max: 1}}}]"])
def test_bad_suites_are_rejected(text):
    with pytest.raises(CheckError, match="suite_invalid"):
        load_suite(text)


def test_suites_of_a_folder(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/one.yml").write_text("conformance: [{id: x, check: no_orphans, with: {label: A}, tags: [t]}]")
    assert [(s.id, [c.id for c in s.checks]) for s in load_suites(tmp_path, tag="t")] == [("one", ["x"])]
    with pytest.raises(CheckError, match="checks_missing"):
        load_suites(tmp_path / "none")
    assert parse_selector("tag:a") == "a"
    with pytest.raises(CheckError):
        parse_selector("suite:a")


@pytest.mark.parametrize("expect", ["{rows: {exactly: 3, min: 1, max: 9}}", "{equals: [a, b], contains: [b]}", "{empty: false, rows: {min: 0}}", "{empty: true, equals: []}"])
def test_consistent_overlays_are_taken(expect):
    assert load_suite(f"competency: [{{id: x, question: q, query: s, expect: {expect}}}]").checks


@pytest.mark.parametrize("expect", ["{rows: {exactly: 3, min: 4}}", "{equals: [a], contains: [b]}", "{empty: true, rows: {min: 1}}", "{empty: true, rows: {exactly: 2, min: 0}}", "{empty: false, rows: {max: 0}}", "{equals: [a], rows: {max: 0}}", "{contains: [a], rows: {exactly: 0}}", "{empty: false, equals: []}"])
def test_contradictions_are_rejected(expect):
    with pytest.raises(CheckError, match="suite_invalid"):
        load_suite(f"competency: [{{id: x, question: q, query: s, expect: {expect}}}]")


def test_a_suite_that_does_not_load_makes_the_run_partial(graph, tmp_path):
    (tmp_path / "a.yml").write_text("suite: good\nconformance: [{id: x, check: no_orphans, with: {label: Customer}, severity: warn}]")
    (tmp_path / "b.yml").write_text("suite: bad\nwhat: 1")
    suites, broken = load_what_can_be(tmp_path)
    found = run_suites(graph, suites, broken=broken)
    assert [s["id"] for s in found["suites"]] == ["good"] and found["checks"][0]["verdict"] == "warn"
    assert found["run"]["status"] == "partial" and "b.yml could not be loaded" in found["run"]["partial_reason"]


@pytest.mark.parametrize(("rows", "n", "want"), [(Rows(max=5), 50, None), (Rows(exactly=5), 50, None), (Rows(min=5), 50, None), (Rows(min=3), 50, True), (Rows(max=2), 50, False), (Rows(min=2, max=9), 50, None), (Rows(max=3), 3, True), (Rows(exactly=3), 3, True), (Rows(min=4), 3, False)])
def test_row_bounds_and_the_ceiling(spark, rows, n, want):
    expect = Expect(rows=rows)
    found = comp.fetch(spark.range(n), expect, 3)
    if want is None:
        with pytest.raises(CheckError, match="result_limit_exceeded"):
            comp.judge(["id"], *found, expect)
    else:
        assert comp.judge(["id"], *found, expect).passed is want


def test_a_result_is_read_until_it_is_decided(spark):
    read = lambda expect, df: len(comp.fetch(df, expect, 1000)[0])
    ids, twice = spark.range(0, 600, 1, 3), spark.range(0, 600, 1, 3).selectExpr("id DIV 2 AS id")
    assert read(Expect(unique=True), twice) == read(Expect(unique=False), twice) == 2 and read(Expect(unique=True), ids) == 600
    assert read(Expect(contains=[1, 3]), ids) == 4 and read(Expect(contains=[417]), ids) == 418 and read(Expect(contains=[-1]), ids) == 600
    assert read(Expect(contains=[1], rows=Rows(min=30)), ids) == 30 and read(Expect(equals=[1]), ids) == 600 and read(Expect(contains=[1], rows=Rows(max=4)), ids) == 5
    assert read(Expect(contains=[1], columns=["x"]), ids) <= 1 and read(Expect(unique=True, empty=True), ids) == 1
    with pytest.raises(CheckError, match="result_limit_exceeded"):
        comp.judge(["id"], *comp.fetch(ids, Expect(contains=[-1]), 50), Expect(contains=[-1]))


def test_checks_of_one_table_share_a_scan(graph, monkeypatch):
    from pellucid.plans import base

    alone = []
    monkeypatch.setattr(base.CheckPlan, "row", lambda self, counts=None, f=base.CheckPlan.row: (alone.append(self.name) if counts is None else None) or f(self, counts))
    suite = load_suite("""
suite: s
conformance:
  - {id: a, check: completeness, with: {label: Customer, property: name, threshold: 0.5}}
  - {id: b, check: property_format, with: {label: Customer, property: name, regex: "A.*"}}
  - {id: c, check: no_orphans, with: {label: Customer}}
""")
    found = run_suites(graph, [suite])
    assert alone == ["no_orphans"] and [(c["verdict"], c["measured"]["population"], c["measured"]["violations"]) for c in found["checks"]] == [("pass", 3, 1), ("fail", 2, 1), ("fail", 3, 1)]
    monkeypatch.setattr(base, "fuse", lambda plans: 1 / 0)
    again = run_suites(graph, [suite])
    assert [c["verdict"] for c in again["checks"]] == ["pass", "fail", "fail"] and len(alone) == 4


def test_tools(graph, results, tmp_path):
    (tmp_path / "checks").mkdir()
    (tmp_path / "checks/people.yml").write_text(SUITE)
    listed = tools.list_checks(tmp_path / "checks")["suites"]
    assert listed[0]["suite"] == "people" and listed[0]["checks"][1] == {"id": "named-all", "kind": "conformance", "severity": "error", "tags": ["prod", "strict"], "generated": False}
    with pytest.raises(CheckError, match="suite_unknown"):
        tools.run_suite(graph, tmp_path / "checks", tmp_path / "runs", "nobody")
    ran = tools.run_suite(graph, tmp_path / "checks", tmp_path / "runs", "people", Options(tags=("strict",)))
    assert tools.get_results(tmp_path / "runs")["run"]["id"] == tools.get_results(tmp_path / "runs", ran["run"]["id"])["run"]["id"] == ran["run"]["id"]
    for name, code in (("../x", "invalid_run_id"), ("a\\b", "invalid_run_id"), ("", "invalid_run_id"), ("none", "results_not_found")):
        with pytest.raises(CheckError, match=code):
            tools.get_results(tmp_path / "runs", name)
    (tmp_path / "runs/latest/results.json").write_text("{}")
    with pytest.raises(CheckError, match="results_unreadable") as e:
        tools.get_results(tmp_path / "runs")
    assert str(tmp_path) not in str(e.value)


def test_server_answers_lines():
    import io

    from pellucid.serve import Server

    def failing(suite):
        raise CheckError("run.suite_unknown", suite)

    server = Server({"list_checks": lambda: {"suites": []}, "get_results": lambda run_id="latest": 1 / 0, "run_suite": failing})
    call = lambda i, name, **given: {"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": given}}
    asked = [{"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
             call(3, "list_checks"), call(4, "run_suite", suite="x"), call(5, "get_results"), call(6, "run_suite"), call(7, "nothing"), {"jsonrpc": "2.0", "id": 8, "method": "what"}]
    out = io.StringIO()
    server.run(io.StringIO("\n".join([*map(json.dumps, asked), "no json", "[1]", ""])), out)
    got = {r["id"] if r["id"] is not None else r["error"]["code"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert len(got) == 10 and got[1]["result"]["capabilities"] == {"tools": {}}
    assert [t["name"] for t in got[2]["result"]["tools"]] == ["list_checks", "get_results", "run_suite"]
    assert json.loads(got[3]["result"]["content"][0]["text"]) == {"suites": []} and not got[3]["result"]["isError"]
    assert got[4]["result"]["isError"] and json.loads(got[4]["result"]["content"][0]["text"]) == {"code": "run.suite_unknown", "message": "x"}
    assert json.loads(got[5]["result"]["content"][0]["text"]) == {"code": "mcp.internal_error", "message": "ZeroDivisionError"}
    assert got[6]["error"]["code"] == got[7]["error"]["code"] == -32602 and got[8]["error"]["code"] == -32601 and {-32700, -32600} <= got.keys()


def test_gates_and_decisions(spark):
    assert sampling.gate_limit(10, 320) == sampling.MODULUS and sampling.gate_limit(10, 3200) == -(-sampling.MODULUS // 10)
    assert [sampling.decide(n, 10, 100) for n in (5, 100, 101)] == ["exact", "exact", "sampled"] and sampling.decide(150, 200, 100) == "exact"
    rows = spark.range(5000).selectExpr("id", "cast(id as string) as name")
    got = [r["id"] for r in sampling.bottom_k(rows, F.col("id"), 4, 9, population=5000).collect()]
    gate, rank = sampling.hash_coefficients(10), sampling.hash_coefficients(9)
    open_ = [i for i in range(5000) if sampling.hash_rank_of(i, gate) < sampling.gate_limit(4, 5000)]
    assert 4 < len(open_) < 400 and sorted(got) == sorted(sorted(open_, key=lambda i: (sampling.hash_rank_of(i, rank), i))[:4])


@pytest.mark.parametrize("options", [{}, {"concurrency": 3}, {"fail_fast": True}])
def test_events_of_a_run_add_up(graph, options):
    seen = []
    found = run_suites(graph, [load_suite(SUITE)], Options(events=seen.append, baselines={"node_count": 3}, **options))
    reconcile(seen)
    done = [e for e in seen if e["kind"] == "check_processed"]
    assert sorted((e["id"], e["verdict"]) for e in done) == sorted((c["id"], c["verdict"]) for c in found["checks"])
    assert {e["queries"] > 0 for e in done if e["verdict"] in ("pass", "fail")} == {True} and {e["queries"] for e in done if e["skip_reason"]} <= {0}
    for change in (
        lambda e: e.pop(2), lambda e: e[0].update(kind="check_processed"), lambda e: e[-1].update(queries=99), lambda e: e[-1].update(verdicts={}), lambda e: e.pop(), lambda e: e[3].update(run_id="x"), lambda e: e[0].update(selected=99),
        lambda e: next(x for x in e if x["kind"] == "check_processed").update(queries=7), lambda e: next(x for x in e if x["kind"] == "query_finished").update(check=0), lambda e: e.append(e[-1] | {"sequence": len(e) + 1}),
    ):
        broken = [dict(e) for e in seen]
        change(broken)
        with pytest.raises(ValueError):
            reconcile(broken)


def test_profile_invariants(graph):
    from pellucid.profiler import check_profile, fingerprint

    def broken(change):
        p = json.loads(json.dumps(profile(graph)))
        change(p)
        p["fingerprint"] = fingerprint(p) if p["fingerprint"] != "x" else "x"
        with pytest.raises(CheckError, match="profile.invalid"):
            check_profile(p)

    check_profile(profile(graph))
    for change in (
        lambda p: p.update(partial_reason="late"), lambda p: p.update(status="partial"), lambda p: p.update(fingerprint="x"), lambda p: p["schema"]["labels"][0].update(count=99),
        lambda p: p["schema"]["labels"][0]["degree_distribution"].update(median=99), lambda p: p["schema"]["labels"][0].pop("degree_distribution"), lambda p: p["schema"]["relationship_types"][0].update(count=9),
        lambda p: p["statistics"]["property_coverage"].reverse(), lambda p: p["schema"]["labels"].append(dict(p["schema"]["labels"][0])),
    ):
        broken(change)


def test_baseline_entries_with_evidence():
    entry = {"value": 7, "evidence": [{"kind": "node", "id": "P:1"}]}
    for source in (entry, {"node_count": entry}, {"node_count": {"label=A": entry}}, {"node_count": {"A": entry}}):
        assert bl.require(source, "node_count", {"label": "A"}) == 7
        assert bl.entry_evidence(source, "node_count", {"label": "A"}) == [{"kind": "node", "id": "P:1", "labels": None, "type": None}]
    assert bl.entry_evidence({"node_count": 3}, "node_count", {}) == []


def test_deductions_share_out_the_rounded_loss(spark):
    from fractions import Fraction
    from itertools import product

    kinds = [("error", "pass"), ("error", "fail"), ("warn", "warn"), ("warn", "pass"), ("error", "errored"), ("warn", "skipped")]
    rows, want = [], {}
    for run, mix in enumerate(product(range(3), repeat=len(kinds))):
        checks = [{"suite_id": f"s{i % 2}", "id": f"{k}-{i}", "severity": kinds[k][0], "verdict": kinds[k][1]} for k, n in enumerate(mix) for i in range(n)]
        got = scoring.deductions(checks)
        rows += [(run, c["suite_id"], c["id"], c["severity"], c["verdict"]) for c in checks]
        want |= {(run, d["suite_id"], d["check_id"]): d["points"] for d in got}
        bad = [c for c in checks if c["verdict"] not in ("pass", "skipped")]
        if bad:
            lost = 100 - scoring.score(checks).value
            weight = {(c["suite_id"], c["id"]): scoring.WEIGHTS[c["severity"]] for c in bad}
            share = {k: Fraction(lost * w, sum(weight.values())) for k, w in weight.items()}
            points = {(d["suite_id"], d["check_id"]): d["points"] for d in got}
            assert sum(points.values()) == lost and all(abs(points[k] - share[k]) < 1 for k in share)
            up = [share[k] % 1 for k in share if points[k] > share[k]]
            down = [share[k] % 1 for k in share if points[k] <= share[k] and share[k] % 1]
            assert not up or not down or min(up) >= max(down)
    frame = scoring.deduction_frame(spark.createDataFrame(rows, "run_id int, suite_id string, id string, severity string, verdict string"))
    assert {(r["run_id"], r["suite_id"], r["check_id"]): r["points"] for r in frame.collect()} == want
    one = {"suite_id": "s", "id": "x", "severity": "error", "verdict": "fail"}
    with pytest.raises(ValueError):
        scoring.deductions([one, one])


def test_report_order_of_frames_and_lists_agree(spark):
    from itertools import product

    checks = [{"suite_id": s, "id": f"{v}{e}", "severity": e, "verdict": v} for s, e, v in product(("b", "a"), ("warn", "error"), scoring.VERDICTS)]
    frame = spark.createDataFrame([("r", *c.values()) for c in checks], "run_id string, suite_id string, id string, severity string, verdict string")
    for only in (None, report.FAILURES):
        got = [(r["suite_id"], r["id"]) for r in report.ordered_frame(frame, only).orderBy("place").collect()]
        assert got == [(c["suite_id"], c["id"]) for c in report.ordered(checks, only)]


def test_evidence_of_elements_that_come_twice(spark):
    rows = spark.createDataFrame([(f"N:{i}", None if i % 2 else "x") for i in range(8)], "id string, p string")
    twice = PropertyGraph(spark, [NodeSet(("A",), rows), NodeSet(("A", "B"), rows)], [])
    plan = CHECKS["completeness"].plan(twice, label="A", property="p")
    assert plan.repeats == 2 and [r["id"] for r in plan.capped(3).collect()] == ["N:1", "N:3", "N:5"]
    assert CHECKS["completeness"].plan(twice, label="B", property="p").repeats == 1


def test_windows_over_a_stream(spark, tmp_path):
    from pellucid.streaming.monitor import start_monitor_stream, violation_counts

    folder, seen = tmp_path / "in", []
    schema = "ts timestamp, value double"
    put = lambda rows: spark.createDataFrame([(dt.datetime(2024, 1, 1, h, m), v) for h, m, v in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))
    put([(0, 5, 1.0), (0, 50, -1.0), (1, 10, None)])
    stream = spark.readStream.schema(schema).parquet(str(folder))
    counts = violation_counts(stream, F.col("value").isNull() | (F.col("value") < 0), "ts", "1 hour", "10 minutes")

    def go():
        running = start_monitor_stream(counts, lambda rows, _: seen.extend((r["window_start"].hour, r["population"], r["violation_count"]) for r in rows.collect()), str(tmp_path / "state"))
        running.processAllAvailable()
        running.stop()

    go()
    put([(3, 0, 2.0)])
    go()  # goes on from the checkpoint
    put([(0, 1, -5.0), (5, 0, 2.0)])  # the first one is too late for its window
    go()
    assert sorted(seen) == [(0, 2, 1), (1, 1, 1), (3, 1, 0)]


def test_tokens_are_registered(graph):
    comp.register_token("$three", lambda g: 3)
    try:
        assert comp.bind(graph, "SELECT :x, :y", {"x": "$three", "y": "$first-active-customer"}) == {"x": 3, "y": "P:1"}
        for name in ("$three", "three"):
            with pytest.raises(CheckError, match="runtime_mismatch"):
                comp.register_token(name, len)
    finally:
        del comp.TOKENS["$three"]
    with pytest.raises(CheckError, match="token_unknown"):
        comp.bind(graph, "SELECT :x", {"x": "$three"})


def test_history_lists_and_selects(results):
    from pellucid.history import chosen_ids, listing

    later = json.loads(json.dumps(results, default=str))
    later["run"] |= {"id": "run_later", "started_at": "2999-01-01T00:00:00Z"}
    shown = listing([results, later])
    assert [(x["id"], x["latest"]) for x in shown] == [("run_later", True), (results["run"]["id"], False)]
    assert shown[0]["suite_scores"] == [{"id": "people", "score": results["suites"][0]["score"]}]
    assert chosen_ids(["a", "b"], 2) == ["a", "b"]
    for bad in ([], ["a", "a"], [""], "a", [str(i) for i in range(101)], [1]):
        with pytest.raises(CheckError, match="selection_invalid"):
            chosen_ids(bad)
    with pytest.raises(CheckError, match="selection_invalid"):
        chosen_ids(["a"], 2)


def test_guard(spark):
    for ok in ("SELECT 1", "WITH a AS (SELECT 1 x) SELECT * FROM a WHERE x IN (SELECT 2)", "SELECT x, count(*) FROM VALUES (1) t(x) GROUP BY x HAVING count(*) > 0 ORDER BY 1 LIMIT 3", "SELECT 1 UNION ALL SELECT 2"):
        require_read_only(spark, ok)
    for bad in ("DROP TABLE a", "INSERT INTO a SELECT 1", "WITH a AS (SELECT 1) INSERT INTO b SELECT * FROM a", "SET x=1", "CACHE TABLE a", "CREATE TABLE a AS SELECT 1", "SELECT reflect('java.lang.System', 'exit', 1)", "EXPLAIN SELECT 1", "SELECT (SELECT java_method('a', 'b'))", "SHOW TABLES"):
        with pytest.raises(CheckError, match="write_rejected"):
            require_read_only(spark, bad)


def verdict(result, complete=True, **expect):
    if isinstance(expect.get("rows"), dict):
        expect["rows"] = Rows(**expect["rows"])
    return comp.judge(list(result[0]) if result else ["a"], result, complete, Expect(**expect)).passed


@given(st.lists(st.integers(0, 3)), st.randoms())
def test_equals_is_a_bag(values, random):
    rows = [{"a": v} for v in values]
    other = values[:]
    random.shuffle(other)
    assert verdict(rows, equals=other)
    assert not verdict(rows, equals=[*other, 9])


def test_assertions():
    assert verdict([{"a": 1}, {"a": 2}], contains=[2], unique=True, rows={"min": 1, "max": 2})
    assert not verdict([{"a": True}], contains=[1])
    assert not verdict([{"a": 1}, {"a": 1}], unique=True) and verdict([{"a": 1}, {"a": 1}], unique=False)
    assert verdict([{"a": 1, "b": [1, {"x": 2}]}], equals=[{"b": [1, {"x": 2}], "a": 1}])
    assert verdict([{"a": 1}] * 3, False, rows={"min": 2}) and not verdict([{"a": 1}] * 3, False, rows={"max": 2})
    with pytest.raises(CheckError, match="result_limit"):
        verdict([{"a": 1}], False, equals=[1])
    assert comp.parameters("SELECT :a, ':b', \":c\", `:d`, x::int -- :e\n/* :f */ + :g") == ["a", "g"]
    assert comp.pointers([{"customer_id": 1, "node_element_id": "n", "deep": [{"kind": "rel", "id": "r"}]}]) == [{"kind": "node", "id": "n", "labels": None, "type": None}, {"kind": "rel", "id": "r", "labels": None, "type": None}]


@pytest.mark.parametrize(("tolerance", "now", "before", "ok"), [({"max_drop_pct": 10}, 90, 100, True), ({"max_drop_pct": 10}, 89, 100, False), ({"max_increase_pct": 10}, 50, 100, True), ({"max_increase_pct": 10}, 111, 100, False), ({"max_change_pct": 0}, 100, 100, True), ({"max_change_pct": 5}, 0, 100, False), ({"absolute": 3}, 97, 100, True), ({"absolute": 9, "max_delta": 2}, 97, 100, False), ({"min": 5}, 4, 9, False), ({"max": 5}, 6, 5, False), ({"max_increase_pct": 900}, 1, 0, False)])
def test_tolerances(tolerance, now, before, ok):
    assert (bl.within(tolerance, now, before) == []) is ok


def test_baseline_lookups():
    assert bl.lookup(7, "node_count", {}) == 7
    assert bl.lookup({"property_coverage": {"A": {"p": 50.0}}}, "property_coverage", {"label": "A", "property": "p"}) == 50.0
    for base, code in ((None, "baseline_missing"), ({"node_count": -1}, "baseline_invalid"), ({"status": "partial", "schema": {"labels": []}, "statistics": {}}, "baseline_partial_missing")):
        with pytest.raises(CheckError, match=code):
            bl.require(base, "node_count", {"label": "A"} if isinstance(base, dict) and "schema" in base else {})
    with pytest.raises(CheckError, match="tolerance_unsupported"):
        bl.within({"speed": 1}, 1, 1)


def test_profile_snapshots_and_diff(graph, spark, tmp_path):
    first = profile(graph)
    assert first["status"] == "complete" and first["statistics"]["node_count"] == 3
    label = first["schema"]["labels"][0]
    assert label["count"] == 3 and label["degree_distribution"] == {"median": 1.0, "p95": 1.0, "p99": 1.0, "maximum": 1}
    assert {x["property"]: x["coverage"] for x in first["statistics"]["property_coverage"]} == {"name": 66.67, "active": 100.0}
    smaller = PropertyGraph(spark, [NodeSet(("Customer",), graph.node_sets[0].df.where("name = 'Ann'"))], graph.rel_sets)
    store, now = bl.Snapshots(tmp_path), dt.datetime(2026, 1, 1)
    store.write(first, now)
    store.write(profile(smaller), now)
    assert store.names() == ["20260101T000000.000000", "20260101T000000.000001"]
    found = diff.compare(*map(store.read, store.pair()))
    assert found["labels"]["changed"] == [{"name": "Customer", "from": 3, "to": 1, "delta": -2, "pct": -66.7}]
    assert found["drift_detected"] and diff.exit_code(found) == 1 and "Customer 3 -> 1" in diff.render(found)
    assert not diff.compare(first, first)["drift_detected"]
    assert bl.require(first, "property_coverage", {"label": "Customer", "property": "name"}) == 66.67
    late = profile(graph, budget=-1)
    assert late["status"] == "partial" and late["partial_reason"] == "profile.budget_exceeded"
    with pytest.raises(CheckError, match="partial_baseline"):
        diff.compare(first, late)


def check(verdict, severity="warn", suite_id="s", id="c"):
    return {"verdict": verdict, "severity": severity, "suite_id": suite_id, "id": id, "error": None}


def test_scores():
    mixed = [check("pass", "error"), check("fail", "error"), check("warn"), check("errored"), check("skipped", "error")]
    assert scoring.score(mixed) == scoring.Score(38, 3, 8, 4, 1) and scoring.score(mixed).coverage_percent == 80
    assert scoring.score([check("pass")] + [check("warn")] * 7).value == 12
    assert scoring.score([check("pass")] * 3 + [check("warn")] * 5).value == 38
    three = [check("pass", "error"), check("fail", "error", id="a"), check("warn", id="b")]
    assert scoring.score(three).value == 43 and [d["points"] for d in scoring.deductions(three)] == [43, 14]
    assert scoring.score([]).value is None
    assert [scoring.exit_code(x, s) for x, s in (([check("pass")], "complete"), ([check("warn")], "complete"), ([], "complete"), ([check("errored", "error")], "complete"), ([check("pass")], "partial"), ([], "failed"))] == [0, 2, 2, 1, 2, 3]


@given(st.lists(st.tuples(st.sampled_from(scoring.VERDICTS), st.sampled_from(["error", "warn"])), max_size=30))
def test_deductions_add_up(raw):
    checks = [check(v, s, id=str(i)) for i, (v, s) in enumerate(raw)]
    total = scoring.score(checks)
    lost = sum(d["points"] for d in scoring.deductions(checks))
    assert lost == (0 if total.value is None else 100 - total.value)


def test_history_and_reports(results, tmp_path):
    runs = Runs(tmp_path)
    runs.write(results, report.html(results))
    second = json.loads(json.dumps(results, default=str))
    second["run"] |= {"id": "run_b", "started_at": "2999-01-01T00:00:00Z"}
    runs.write(second)
    assert [r["run"]["id"] for r in runs.all()] == ["run_b", results["run"]["id"]]
    found = compare_runs(results, second)
    assert not found["regressions"] and not found["added"]
    assert runs.prune(1) == [results["run"]["id"]]
    with pytest.raises(CheckError):
        runs.delete("../x")
    with pytest.raises(CheckError):
        runs.write(second | {"totals": {}})
    page = report.html(results)
    assert "<script" not in page and "named-all" in page
    assert [c["verdict"] for c in report.ordered(results["checks"], report.FAILURES)][0] in ("fail", "errored")


def test_redaction_leaves_no_literal(results):
    text = json.dumps(redact(results))
    assert secrets(results) and not any(s in text for s in ("Customer", "P:3", "Ann", "named-all", "people"))


def test_wilson_and_samples():
    assert sampling.wilson(50, 100, 1000)["ci"] == pytest.approx([0.4038315303659956, 0.5961684696340044], abs=1e-15)
    assert sampling.wilson(0, 100, 1000)["ci"] == pytest.approx([0.0, 0.03699349820698568]) and sampling.wilson(100, 100, 1000)["ci"][1] == 1.0
    with pytest.raises(ValueError):
        sampling.wilson(1, 10, 10)
    seed = sampling.check_seed(7, "g", "s", "c")
    assert sampling.check_seed(7, "a", "bc", "d") != sampling.check_seed(7, "ab", "c", "d") and seed != sampling.check_seed("7", "g", "s", "c")
    picked = sampling.sample_indices(100, 8, seed)
    assert picked == sampling.sample_indices(100, 8, seed) and len(set(picked)) == 8 and all(0 <= i < 100 for i in picked)


@given(st.integers(0, 2**62), st.integers())
def test_hash_rank_agrees_with_itself_in_range(value, seed):
    c = sampling.hash_coefficients(seed)
    assert 0 <= sampling.hash_rank_of(value, c) < sampling.MODULUS


def test_columns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("4111-1111-1111-1111", 12345678901), ("4111-1111-1111-1112", 5), ("2363", 7), ("2364", 0), ("", 1), ("7", 2)], "s string, n long")
    c = sampling.hash_coefficients(3)
    got = rows.select("s", "n", luhn_ok(F.col("s")).alias("l"), verhoeff_ok(F.col("s")).alias("v"), sampling.hash_rank(F.col("n"), c).alias("h")).collect()
    assert {r["s"]: r["l"] for r in got if "-" in r["s"] or len(r["s"]) < 2} == {"4111-1111-1111-1111": True, "4111-1111-1111-1112": False, "": False, "7": False}
    assert {r["s"]: r["v"] for r in got if len(r["s"]) == 4} == {"2363": True, "2364": False}
    assert all(r["h"] == sampling.hash_rank_of(r["n"], c) for r in got)


def test_monitor(spark):
    from pellucid.streaming.monitor import Metrics, check_health

    m = Metrics()
    m.record(check_health(spark), 0.02, 5.0)
    m.record(False, 9.0)
    assert "graph_connected 0" in m.text() and "graph_health_failures_total 1" in m.text() and 'bucket{le="+Inf"} 2' in m.text()


def test_cli(tmp_path, capsys):
    from pellucid.cli import main

    assert main(["init", "--checks", str(tmp_path / "c")]) == 0
    assert [s.id for s in load_suites(tmp_path / "c")] == ["sample"]
    assert main(["diff", "--baselines", str(tmp_path)]) == 2
