"""What checks of a run share, counts from metadata, mixed types, and the small mendings around them."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pellucid import diff
from pellucid.errors import CheckError
from pellucid.events import reconcile
from pellucid.functions import sampling
from pellucid.graph import NodeSet, PropertyGraph, RelSet
from pellucid.plans import conformance as c
from pellucid.plans import drift, pii
from pellucid.plans.degrees import SharedDegrees
from pellucid.profiler import check_profile, observed_types, profile
from pellucid.runner import Options, run_suites
from pellucid.sources import catalogue
from pellucid.sources.metadata import metadata_counts, metadata_plan
from pellucid.sources.suites import load_suite
from pellucid.sources.tables import load_graph
from pellucid.streaming.monitor import Metrics


def counting(spark, frame):
    """The frame, and an accumulator of the rows that are read from it."""
    seen, schema = spark.sparkContext.accumulator(0), frame.schema

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(run, schema), seen


@pytest.fixture(scope="module")
def parts(spark):
    people = spark.createDataFrame([(f"P:{i}", i, ["VIP"] if i % 3 == 0 else []) for i in range(30)], "id string, n int, labels array<string>")
    shops = spark.createDataFrame([(f"S:{i}", None if i == 2 else i) for i in range(5)], "id string, n int")
    buys = spark.createDataFrame([(f"b{i}", f"P:{i * i % 30}", f"S:{i % 4}" if i % 7 else f"P:{i % 30}") for i in range(90)], "id string, src string, dst string")
    return people, shops, buys


def small(spark, parts):
    people, shops, buys = parts
    return PropertyGraph(spark, [NodeSet(("Person",), people, ("VIP",)), NodeSet(("Shop",), shops)], [RelSet("BUYS", buys)])


@pytest.mark.parametrize("direction", ["out", "in", "any"])
def test_shared_degrees_equal_single_checks_in_one_scan(spark, parts, direction):
    people, shops, buys = parts
    counted, seen = counting(spark, buys)
    graph = PropertyGraph(spark, [NodeSet(("Person",), people, ("VIP",)), NodeSet(("Shop",), shops)], [RelSet("BUYS", counted)])
    plans = {}
    for label in ("Person", "VIP", "Shop"):
        plans[label, "orphans"] = c.no_orphans(graph, label, "BUYS", direction)
        plans[label, "hubs"] = c.hub_outlier(graph, label, "BUYS", direction, 1.0)
        for other in ("Shop", "VIP"):
            plans[label, other] = c.cardinality(graph, label, "BUYS", other, direction, 2)
    shared = SharedDegrees(graph, {k: p.degrees for k, p in plans.items()})
    seen.value = 0
    rows = {k: shared.row(k) for k in plans}
    assert seen.value == 90  # twelve checks, one scan of the relationships
    for k, p in plans.items():
        alone = p.summary.first().asDict()
        assert {n: pytest.approx(v) for n, v in alone.items()} == rows[k], k
    hub = plans["Person", "hubs"]
    assert hub.summary.first()["violation_count"] == hub.evidence.count()


def test_a_run_shares_degrees_and_drift(spark, parts):
    suite = load_suite("""
suite: shared
conformance:
  - {id: buyers, check: no_orphans, with: {label: Person, rel_type: BUYS, direction: out}}
  - {id: two, check: cardinality, with: {from_label: Person, rel_type: BUYS, to_label: Shop, exactly: 2}}
  - {id: hubs, check: hub_outlier, with: {label: Person, rel_type: BUYS, direction: out, z_threshold: 1.0}}
drift:
  - {id: people, metric: node_count, target: {label: Person}, tolerance: {max_drop_pct: 1}}
  - {id: all, metric: node_count, target: {}, tolerance: {max_drop_pct: 1}}
  - {id: vips, metric: node_count, target: {label: VIP}, tolerance: {max_drop_pct: 1}}
  - {id: shops, metric: property_coverage, target: {label: Shop, property: n}, tolerance: {max_drop_pct: 1}}
  - {id: buys, metric: relationship_count, target: {type: BUYS}, tolerance: {max_drop_pct: 1}}
  - {id: wrong, metric: node_count, target: {label: Nobody}, tolerance: {max_drop_pct: 1}}
""")
    people, shops, buys = parts
    counted, seen = counting(spark, buys)
    nodes, met = counting(spark, shops)
    graph = PropertyGraph(spark, [NodeSet(("Person",), people, ("VIP",)), NodeSet(("Shop",), nodes)], [RelSet("BUYS", counted)])
    base = {"latest": {"node_count": {"label=Person": 30, "": 35, "label=VIP": 20, "label=Nobody": 1}, "property_coverage": {"label=Shop|property=n": 80.0}, "relationship_count": {"type=BUYS": 90}}}
    graph.counts()
    seen.value = met.value = 0
    events = []
    found = run_suites(graph, [suite], Options(baselines=base, evidence_cap=3, events=events.append))
    by = {x["id"]: x for x in found["checks"]}
    assert {k: x["verdict"] for k, x in by.items()} == {"buyers": "fail", "two": "fail", "hubs": "fail", "people": "pass", "all": "pass", "vips": "fail", "shops": "pass", "buys": "pass", "wrong": "errored"}
    assert by["vips"]["measured"] == {"current": 10, "baseline": 20, "delta": -10, "change_pct": -50.0} and by["hubs"]["measured"]["sample_size"] == 30
    # one scan for the three checks, one for drift, and one for the evidence of each failing check; the hubs' evidence sums and lists
    assert seen.value <= 90 * (1 + 1 + 4)
    reconcile(events, found)
    with pytest.raises(ValueError, match="another run"):
        reconcile(events, {**found, "run": {**found["run"], "id": "run_other"}})
    with pytest.raises(ValueError, match="other verdicts"):
        reconcile(events, {**found, "checks": found["checks"][1:]})


def test_drift_measures_are_taken_in_one_scan_of_each_table(spark, parts):
    people, shops, buys = parts
    (people, p), (shops, s), (buys, b) = (counting(spark, x) for x in parts)
    graph = PropertyGraph(spark, [NodeSet(("Person",), people, ("VIP",)), NodeSet(("Shop",), shops)], [RelSet("BUYS", buys)])
    asks = {
        "a": ("node_count", {}), "b": ("node_count", {"label": "VIP"}), "c": ("node_count", {"label": "Shop"}), "d": ("property_coverage", {"label": "Shop", "property": "n"}), "e": ("property_coverage", {"label": "VIP", "property": "n"}),
        "f": ("relationship_count", {}), "g": ("relationship_count", {"type": "BUYS"}), "h": ("property_coverage", {"label": "Person", "property": "n"}),
    }
    rows = {r["number"]: r for r in drift.measure(graph, asks).collect()}
    assert (p.value, s.value, b.value) == (30, 5, 90)
    for i, ask in enumerate(asks.values()):
        alone = drift.drift_metric(graph, *ask).summary.first()
        assert (rows[i]["current"], rows[i]["population"]) == (alone["current"], alone["population"]), ask
    found = drift.against(drift.measure(graph, asks), [None, 20, 0, 80.0, 100.0, 90, 90, 100.0]).orderBy("number").collect()
    assert [(r["baseline"], r["delta"], r["change_pct"]) for r in found[:4]] == [(None, None, None), (20, -10, -50.0), (0, 5, None), (80.0, 0.0, 0.0)]
    assert drift.measure(graph, {}).collect() == []


def test_counts_from_metadata_read_no_row_group(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS k", "CASE WHEN id % 4 = 0 THEN 'x' END AS v", "array(id) AS l")
    rows.repartition(3).write.parquet(f"{tmp_path}/t.parquet")
    assert metadata_counts(spark, f"{tmp_path}/t.parquet", ("k", "v")) == {"*": 1000, "k": 1000, "v": 250}
    plan = metadata_plan(spark, f"{tmp_path}/t.parquet", ("v",))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(v)]" in plan
    assert metadata_counts(spark, f"{tmp_path}/t.parquet", ("l",)) is None
    stored = NodeSet(("N",), lambda: spark.read.parquet(f"{tmp_path}/t.parquet").withColumn("id", F.col("k").cast("string")), stored=f"{tmp_path}/t.parquet")
    other = NodeSet(("N", "M"), spark.range(7).selectExpr("CAST(id AS string) AS id"))
    graph = PropertyGraph(spark, [stored, other], [])
    assert (graph.population("N"), graph.population("M"), graph.population()) == (1007, 7, 1007)


def test_gates_and_samples_know_their_population(spark, tmp_path):
    spark.range(20_000).selectExpr("id AS k", "CAST(id AS string) AS email").write.parquet(f"{tmp_path}/t.parquet")
    load = lambda: spark.read.parquet(f"{tmp_path}/t.parquet").withColumn("id", F.concat(F.lit("N:"), "k"))
    graph = PropertyGraph(spark, [NodeSet(("N",), load, stored=f"{tmp_path}/t.parquet")], [RelSet("R", spark.createDataFrame([("r", "N:1", "N:2")], "id string, src string, dst string"))])
    assert pii.known_population(graph, "N", False) == 40_000 and pii.known_population(graph, "N", True) == 20_000
    plan = pii.pii_name_match(graph, "N", 50, seed=3)
    row = plan.summary.first()
    assert (row["population"], row["sample_size"]) == (40_000, 50) and "Filter" in plan.summary._jdf.queryExecution().optimizedPlan().toString()
    assert row["violation_count"] == plan.evidence.count() == sum(r["observed"] for r in plan.findings.collect())
    hub = c.hub_outlier(graph, "N", "R", sample_size=40, exhaustive_limit=100, seed=1).summary.first()
    assert (hub["population"], hub["sample_size"]) == (20_000, 40)
    few = pii.pii_name_match(graph, "N", 100_000).summary.first()
    assert (few["population"], few["sample_size"], few["violation_count"]) == (40_000, 40_000, 20_000)
    assert sampling.gate_limit(40, 20_000) < sampling.MODULUS


def test_documents_are_joined_with_their_labels_only_where_asked(spark):
    graph = load_graph(spark, "/root/testdata/sf0.001")
    plan = lambda p: p.summary._jdf.queryExecution().optimizedPlan().toString()
    for p in (pii.pii_value_match(graph, "Document", pii.ALL, ["email"], ["text"]), c.property_format(graph, "Document", "lang", "[a-z]+"), c.uniqueness(graph, "Document", "text")):
        assert "Join" not in plan(p)
    assert "Join" in plan(c.completeness(graph, "Document", "quality"))
    found = c.property_format(graph, "Document", "lang", "xx").capped(500).collect()
    assert {x for r in found for x in r["labels"]} == {"Document", "Quality", "Toxic"}
    hits = pii.pii_name_match(PropertyGraph(spark, [NodeSet(("D",), spark.createDataFrame([("1", "x", ["V"]), ("2", "y", [])], "id string, email string, labels array<string>"), ("V",))], []), "D")
    assert {tuple(r["labels"]) for r in hits.findings.collect()} == {("D", "V"), ("D",)}


def variants(spark, *values):
    rows = [(str(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id string, raw string").select("id", F.parse_json("raw").alias("v"))


def test_mixed_types_are_looked_at_value_by_value(spark):
    graph = PropertyGraph(spark, [NodeSet(("N",), variants(spark, '"a"', '"b"', "1", "1.0", "true", '"1"', "[1]", None))], [])
    counts = lambda p: tuple(p.summary.first()[k] for k in ("population", "violation_count"))
    assert counts(c.value_in_set(graph, "N", "v", ["a", "b"])) == (7, 5) and counts(c.value_in_set(graph, "N", "v", [1])) == (7, 5) and counts(c.value_in_set(graph, "N", "v", [True, "1"])) == (7, 5)
    plan = c.uniqueness(graph, "N", "v")
    assert counts(plan) == (7, 2) and {r["id"] for r in plan.evidence.collect()} == {"2", "3"}
    assert observed_types(graph).first()["types"] == ["BOOLEAN", "FLOAT", "INTEGER", "LIST", "STRING"]


def test_nan_lies_neither_before_nor_behind(spark):
    nan = float("nan")
    rows = spark.createDataFrame([("1", nan, 1.0), ("2", 1.0, nan), ("3", 2.0, 1.0), ("4", nan, nan), ("5", 1.0, 2.0)], "id string, a double, b double")
    plan = c.temporal_sanity(PropertyGraph(spark, [NodeSet(("N",), rows)], []), "N", "a", "b")
    assert [r["id"] for r in plan.evidence.collect()] == ["3"]
    mixed = variants(spark, "2", "2", '"b"', "2").withColumnRenamed("v", "a").join(variants(spark, "1.5", "3", '"a"', '"1"').withColumnRenamed("v", "b"), "id")
    plan = c.temporal_sanity(PropertyGraph(spark, [NodeSet(("N",), mixed)], []), "N", "a", "b")
    assert sorted(r["id"] for r in plan.evidence.collect()) == ["0", "2"]


def test_constraints_come_from_the_tables_or_a_catalogue(spark, tmp_path):
    rows = spark.createDataFrame([("1", 1, "a"), ("2", 1, "b"), ("3", None, "c"), ("4", 4, None)], "id string, k int, v string")
    graph = PropertyGraph(spark, [NodeSet(("N",), rows, keys=("k",))], [])
    assert catalogue.declared(graph) == [{"name": "n_key", "type": "NODE_KEY", "labels_or_types": ["N"], "properties": ["k"]}]
    (tmp_path / "c.yml").write_text("constraints:\n  - {name: v_there, type: NODE_PROPERTY_EXISTENCE, labels_or_types: [N], properties: [v]}\n  - {name: k_once, type: UNIQUENESS, labels_or_types: [N], properties: [k]}\nindexes:\n  - {name: by_v, type: RANGE, labels_or_types: [N], properties: [v]}")
    constraints, indexes = catalogue.read_catalogue(tmp_path / "c.yml")
    found = {r["name"]: (r["elements"], r["broken"]) for r in catalogue.kept(graph, constraints + catalogue.declared(graph)).collect()}
    assert found == {"n_key": (4, 3), "v_there": (4, 1), "k_once": (4, 2)}
    first, second = profile(graph), profile(graph, constraints=constraints, indexes=indexes)
    check_profile(json.loads(json.dumps(second)))
    assert first["fingerprint"] == second["fingerprint"] and [x["name"] for x in first["schema"]["constraints"]] == ["n_key"]
    moved = diff.compare(first, second)
    assert {x["name"] for x in moved["constraints"]["added"]} == {"v_there", "k_once"} and [x["name"] for x in moved["constraints"]["removed"]] == ["n_key"]
    frame = lambda xs: spark.createDataFrame([(x["name"], x["type"], x["properties"]) for x in xs], "name string, type string, properties array<string>")
    changed = [constraints[0], {**constraints[1], "type": "NODE_KEY"}]
    assert sorted((r["name"], r["type"], r["change"]) for r in diff.definition_diff(frame(constraints), frame(changed)).collect()) == [("k_once", "NODE_KEY", "added"), ("k_once", "UNIQUENESS", "removed")]
    for bad in ("constraints: [{name: x, type: WHAT, labels_or_types: [N]}]", "other: 1", "constraints: [{name: x, type: UNIQUENESS, labels_or_types: [N]}, {name: x, type: UNIQUENESS, labels_or_types: [M]}]", "[", "indexes: [{name: x}]"):
        (tmp_path / "bad.yml").write_text(bad)
        with pytest.raises(CheckError, match="catalogue_invalid"):
            catalogue.read_catalogue(tmp_path / "bad.yml")


def test_health_metrics_do_not_grow():
    m = Metrics()
    for seconds in (0.001, 0.005, 0.3, 9.0):
        m.record(True, seconds, 5.0)
    text = m.text()
    assert 'bucket{le="0.005"} 2' in text and 'bucket{le="0.5"} 3' in text and 'bucket{le="5"} 3' in text and 'bucket{le="+Inf"} 4' in text and "seconds_count 4" in text and len(m.buckets) == 11
    assert dt.timedelta(seconds=m.seconds) == dt.timedelta(seconds=9.306)
