"""Pack manifests: what they add, and what does not load."""

import pytest
from pyspark.sql import functions as F

from pellucid import packs
from pellucid.errors import CheckError
from pellucid.graph import NodeSet, PropertyGraph, RelSet
from pellucid.operators import CHECKS
from pellucid.operators import competency as comp
from pellucid.plans import pii
from pellucid.runner import Options, run_suites
from pellucid.sources.suites import load_suite

MANIFEST = """
pack: house
version: "2"
checks:
  present: {runs: completeness}
  too-linked: {runs: hub_outlier, samples: true}
  private-names: {runs: pii_name_match, samples: true}
patterns:
  names: {badge: {keys: [badge, Badge_No]}}
  values: {badge: {format: "B[0-9]{6}"}, ticket: {format: "[0-9]{8}", check: luhn}}
tokens:
  $first-active-guest: {runs: first_active, with: {label: Guest}}
"""


@pytest.fixture
def house():
    pack = packs.load_pack(MANIFEST)
    yield pack
    packs.unload_pack(pack.name)


def test_a_pack_adds_checks_patterns_and_tokens(spark, house):
    rows = spark.createDataFrame([("G:2", "B123456", "x", "inactive"), ("G:1", "B12", "79927398713"[:8], "inactive"), ("G:3", None, None, "active")], "id string, badge_no string, note string, status string")
    rows = rows.withColumn("note", F.when(F.col("id") == "G:2", "18").otherwise(F.col("note")))
    graph = PropertyGraph(spark, [NodeSet(("Guest",), rows)], [RelSet("MET", spark.createDataFrame([("m", "G:1", "G:2")], "id string, src string, dst string"))])
    suite = load_suite("""
suite: house
conformance:
  - {id: there, check: present, with: {label: Guest, property: badge_no, threshold: 0.6}}
  - {id: names, check: private-names, severity: warn, with: {label: Guest, patterns: [badge]}}
  - {id: values, check: pii_value_match, severity: warn, with: {label: Guest, patterns: [badge]}}
  - {id: hubs, check: too-linked, with: {label: Guest, rel_type: MET}}
competency:
  - {id: first, question: q, query: "SELECT node_element_id FROM node_Guest WHERE id = :g", params: {g: $first-active-guest}, expect: {equals: ["G:3"]}}
""")
    by = {x["id"]: x for x in run_suites(graph, [suite], Options())["checks"]}
    assert {k: x["verdict"] for k, x in by.items()} == {"there": "pass", "names": "warn", "values": "warn", "hubs": "pass", "first": "pass"}
    assert by["there"]["measured"]["coverage"] == pytest.approx(2 / 3) and by["hubs"]["measured"]["sample_size"] == 3
    assert [(f["pattern"], f["location"]["property"], f["exposure_count"]) for f in by["names"]["measured"]["findings"]] == [("badge", "badge_no", 2)]
    assert [(f["pattern"], f["exposure_count"]) for f in by["values"]["measured"]["findings"]] == [("badge", 1)]
    assert packs.listing()[2:] == [{"pack": "house", "version": "2", "checks": ["present", "too-linked", "private-names"], "patterns": ["badge", "ticket"], "tokens": ["$first-active-guest"]}]


def test_the_built_in_packs_come_from_their_manifests():
    core, own = packs.PACKS["core"], packs.PACKS["pii"]
    assert len(core.checks) == 12 and core.tokens == ["$first-active-customer"] and own.checks == ["pii_name_match", "pii_value_match"] and set(CHECKS) >= {*core.checks, *own.checks}
    assert len(own.names) == 15 and own.values == ["email", "e164_phone", "nric", "aadhaar", "credit_card"]
    assert pii.NAME_PATTERNS["phone"][-1] == "msisdn" and pii.VALUE_PATTERNS["aadhaar"] == (r"^\d{12}$", "verhoeff")
    assert {CHECKS[k].runs for k in own.checks} == set(own.checks) and CHECKS["dangling_rels"].requires == ("read", "store_consistency")


def test_unloading_leaves_nothing_behind():
    before = set(CHECKS), set(pii.NAME_PATTERNS), set(pii.VALUE_PATTERNS), set(comp.TOKENS)
    packs.load_pack(MANIFEST)
    with pytest.raises(CheckError, match="runtime_mismatch"):
        packs.load_pack(MANIFEST)
    packs.unload_pack("house")
    assert before == (set(CHECKS), set(pii.NAME_PATTERNS), set(pii.VALUE_PATTERNS), set(comp.TOKENS))


@pytest.mark.parametrize(("body", "code"), [
    ("checks: {x: {runs: nothing}}", "runtime_mismatch"), ("checks: {x: {runs: completeness, samples: true}}", "runtime_mismatch"), ("checks: {x: {runs: dangling_rels, elements: rel}}", "runtime_mismatch"), ("checks: {x: {runs: completeness, elements: rel}}", "runtime_mismatch"),
    ("checks: {completeness: {runs: completeness}}", "runtime_mismatch"), ("patterns: {values: {v: {format: x, check: crc}}}", "runtime_mismatch"), ("patterns: {names: {email: {keys: [x]}}}", "runtime_mismatch"), ("tokens: {$t: {runs: what}}", "runtime_mismatch"),
    ("tokens: {$t: {runs: first_active, with: {labels: x}}}", "runtime_mismatch"), ("tokens: {t: {runs: first_active, with: {label: x}}}", "runtime_mismatch"), ("checks: {x: {runs: completeness, code: y}}", "manifest_invalid"), ("patterns: {values: {v: {format: '('}}}", "manifest_invalid"),
    ("patterns: {names: {v: {keys: [a, A]}}}", "manifest_invalid"), ("patterns: {names: {v: {keys: []}}}", "manifest_invalid"), ("version: two", "manifest_invalid"), ("what: 1", "manifest_invalid"), ("[", "manifest_invalid"),
])
def test_a_pack_that_does_not_fit_does_not_load_at_all(body, code, tmp_path):
    before = set(CHECKS), set(pii.NAME_PATTERNS), set(pii.VALUE_PATTERNS), set(comp.TOKENS)
    (tmp_path / "p.yml").write_text(f'pack: odd\nversion: "1"\n{body}\n')
    with pytest.raises(CheckError, match=f"packs.{code}"):
        packs.load_packs(tmp_path)
    assert before == (set(CHECKS), set(pii.NAME_PATTERNS), set(pii.VALUE_PATTERNS), set(comp.TOKENS)) and "odd" not in packs.PACKS
