"""Each check on a small graph whose answers are worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pellucid.errors import CheckError, SchemaReferenceMissing
from pellucid.graph import NodeSet, PropertyGraph, RelSet
from pellucid.plans import conformance as c
from pellucid.plans import fuse, pii
from pellucid.plans.drift import drift_metric


@pytest.fixture(scope="module")
def graph(spark):
    d = dt.date
    customers = spark.createDataFrame(
        [
            ("Customer:1", "4111-1111-1111-1111", "a@b.co", 1.5, True, d(2020, 1, 1), d(2021, 1, 1), ["VIP"]), ("Customer:2", "4111111111111112", "A@B", float("nan"), False, d(2021, 1, 1), d(2020, 1, 1), []),
            ("Customer:3", None, "a@b.co", 2.0, None, None, d(2020, 1, 1), ["VIP", "Closed"]), ("Customer:4", "x", "line\nbreak", None, True, d(2020, 1, 1), d(2020, 1, 1), []),
        ],
        "id string, card string, email string, score double, ok boolean, opened date, closed date, labels array<string>",
    )
    accounts = spark.createDataFrame([(f"Account:{i}", i) for i in range(6)], "id string, number long")
    owns = spark.createDataFrame([("r1", "Customer:1", "Account:0"), ("r2", "Customer:1", "Account:1"), ("r3", "Customer:2", "Account:1"), ("r4", "Account:2", "Customer:3"), ("r5", "Customer:1", "Account:9")], "id string, src string, dst string")
    loops = spark.createDataFrame([("l1", "Account:5", "Account:5", None), ("l2", "Account:5", "Account:4", 7)], "id string, src string, dst string, weight int")
    return PropertyGraph(spark, [NodeSet(("Customer",), customers, ("VIP", "Closed", "Never")), NodeSet(("Account",), accounts)], [RelSet("OWNS", owns), RelSet("NEAR", loops)])


def counts(plan):
    row = plan.summary.first()
    return row["population"], row["violation_count"]


def ids(plan, cap=100):
    return [r["id"] for r in plan.capped(cap).collect()]


def test_completeness(graph):
    plan = c.completeness(graph, "Customer", "card", 0.7)
    row = plan.summary.first()
    assert (row["population"], row["violation_count"], row["coverage"]) == (4, 1, 0.75)
    assert ids(plan) == ["Customer:3"]
    assert c.completeness(graph, "Never", "card").summary.first()["coverage"] == 1.0


def test_cardinality_counts_nodes_without_relationships(graph):
    plan = c.cardinality(graph, "Account", "OWNS", "Customer", "in", 1)
    assert counts(plan) == (6, 5)
    assert "Account:0" not in ids(plan)
    assert counts(c.cardinality(graph, "Customer", "OWNS", "Account", "out", 2)) == (4, 3)


def test_no_orphans_and_loops(graph):
    assert ids(c.no_orphans(graph, "Account")) == ["Account:3"]
    assert counts(c.no_orphans(graph, "Account", "OWNS", "in")) == (6, 4)
    degrees = {r["id"]: r["degree"] for r in c.degrees(graph, "NEAR", "any").collect()}
    assert degrees == {"Account:5": 2, "Account:4": 1}


def test_dangling_needs_the_capability(graph):
    with pytest.raises(CheckError, match="check_unobservable"):
        c.dangling_rels(graph)
    able = PropertyGraph(graph.spark, graph.node_sets, graph.rel_sets, capabilities={"read": True, "store_consistency": True})
    assert counts(c.dangling_rels(able, "OWNS")) == (5, 1)
    assert ids(c.dangling_rels(able)) == ["r5"]


@pytest.mark.parametrize(("name", "kind", "expected"), [("score", "float", (3, 1)), ("score", "integer", (3, 3)), ("ok", "boolean", (3, 0)), ("opened", "date", (3, 0)), ("opened", "datetime", (3, 3)), ("card", "string", (3, 0))])
def test_property_type(graph, name, kind, expected):
    assert counts(c.property_type(graph, "Customer", name, kind)) == expected


def test_property_type_of_variants(spark):
    df = spark.createDataFrame([("1", '{"v": 1}'), ("2", '{"v": 1.5}'), ("3", '{"v": "x"}'), ("4", '{"v": [1]}'), ("5", None)], "id string, raw string").select("id", F.variant_get(F.parse_json("raw"), "$.v", "variant").alias("v"))
    g = PropertyGraph(spark, [NodeSet(("N",), df)], [])
    assert [counts(c.property_type(g, "N", "v", t)) for t in ("integer", "float", "string", "boolean")] == [(4, 3), (4, 3), (4, 3), (4, 4)]
    assert counts(c.property_format(g, "N", "v", ".*")) == (4, 3)


def test_property_format_is_a_whole_match(graph):
    assert ids(c.property_format(graph, "Customer", "email", "[a-z@.]+")) == ["Customer:2", "Customer:4"]
    assert counts(c.property_format(graph, "Customer", "score", ".*")) == (3, 3)
    with pytest.raises(CheckError, match="regex"):
        c.property_format(graph, "Customer", "email", "(")


def test_value_in_set_never_mixes_types(graph):
    assert counts(c.value_in_set(graph, "Customer", "ok", [True, 1, "true"])) == (3, 1)
    assert counts(c.value_in_set(graph, "Customer", "card", [1, 2])) == (3, 3)
    assert counts(c.value_in_set(graph, "Account", "number", [0, 1, 2.0, "3"])) == (6, 3)


def test_uniqueness_counts_all_members(graph):
    plan = c.uniqueness(graph, "Customer", "email")
    assert counts(plan) == (4, 2)
    assert ids(plan) == ["Customer:1", "Customer:3"]


def test_hub_outlier_is_strict_and_high_only(graph):
    row = c.hub_outlier(graph, "Customer", "OWNS", "out", 1.0).summary.first()
    assert (row["population"], row["sample_size"], row["violation_count"]) == (4, 4, 1)
    assert row["mean_degree"] == 1.0 and abs(row["degree_stddev"] - 1.224744871391589) < 1e-12
    sampled = c.hub_outlier(graph, "Account", None, "any", 1.0, sample_size=3, exhaustive_limit=2, seed=5).summary.first()
    assert (sampled["population"], sampled["sample_size"]) == (6, 3)


def test_labels_direction_and_time(graph):
    assert counts(c.label_cooccurrence(graph, "VIP", "Closed")) == (2, 1)
    plan = c.rel_direction(graph, "Customer", "Account", "OWNS")
    assert counts(plan) == (4, 1) and ids(plan) == ["r4"]
    plan = c.temporal_sanity(graph, "Customer", "opened", "closed")
    assert counts(plan) == (3, 1) and ids(plan) == ["Customer:2"]
    assert counts(c.temporal_sanity(graph, "Customer", "opened", "score")) == (2, 0)


def test_unknown_names_are_errors(graph):
    for call in (lambda: c.completeness(graph, "Nobody", "card"), lambda: c.completeness(graph, "Customer", "nothing"), lambda: c.no_orphans(graph, "Customer", "HATES")):
        with pytest.raises(SchemaReferenceMissing):
            call()
    for call in (lambda: c.label_cooccurrence(graph, "VIP", "VIP"), lambda: c.cardinality(graph, "Customer", "OWNS", "Account", "up"), lambda: c.hub_outlier(graph, "Customer", z_threshold=0)):
        with pytest.raises(CheckError, match="invalid_check"):
            call()


def test_pii(graph):
    plan = pii.pii_value_match(graph, "Customer")
    found = plan.findings.groupBy("pattern", "property").agg(F.sum("observed").alias("n")).collect()
    assert {(r["pattern"], r["property"]): r["n"] for r in found} == {("email", "email"): 2, ("credit_card", "card"): 1}
    names = pii.pii_name_match(graph, "Customer")
    assert {r["property"] for r in names.findings.collect()} == {"email"}
    assert counts(names)[0] == 4 + 3 + 3 + 3 + 3 + 4
    with pytest.raises(CheckError, match="pattern_unknown"):
        pii.pii_name_match(graph, patterns=["shoe size"])


def test_drift_metrics(graph):
    value = lambda *a: drift_metric(graph, *a).summary.first()["current"]
    assert value("node_count", {"label": "VIP"}) == 2 and value("node_count") == 10
    assert value("relationship_count", {"type": "OWNS"}) == 5
    assert value("property_coverage", {"label": "Customer", "property": "card"}) == 75.0
    assert value("property_coverage", {"type": "NEAR", "property": "weight"}) == 50.0
    assert value("property_coverage", {"label": "Never", "property": "card"}) == 100.0
    for bad in (("speed", {}), ("node_count", {"type": "x"}), ("property_coverage", {"property": "card"})):
        with pytest.raises(CheckError):
            drift_metric(graph, *bad)


def test_fused_checks_equal_single_ones(graph):
    plans = {"a": c.completeness(graph, "Customer", "card"), "b": c.property_format(graph, "Customer", "email", "[a-z@.]+"), "c": c.uniqueness(graph, "Customer", "email"), "d": c.value_in_set(graph, "Customer", "ok", [True])}
    fused = fuse(plans)
    assert {r["check"]: (r["population"], r["violation_count"]) for r in fused.collect()} == {k: counts(p) for k, p in plans.items()}


def test_paths_repeat_no_relationship(graph):
    found = graph.paths("NEAR", 1, 4).collect()
    assert sorted((r["start"], r["stop"], r["hops"]) for r in found) == [("Account:5", "Account:4", 1), ("Account:5", "Account:4", 2), ("Account:5", "Account:5", 1)]


def test_partitioning_changes_nothing(graph, spark):
    again = PropertyGraph(spark, [NodeSet(s.labels, s.df.repartition(7), s.optional) for s in graph.node_sets], [RelSet(r.type, r.df.orderBy(F.desc("id")).repartition(3)) for r in graph.rel_sets])
    for run in (lambda g: c.uniqueness(g, "Customer", "email"), lambda g: c.hub_outlier(g, "Customer", "OWNS"), lambda g: c.no_orphans(g, "Account")):
        assert counts(run(graph)) == counts(run(again)) and ids(run(graph), 1) == ids(run(again), 1)
