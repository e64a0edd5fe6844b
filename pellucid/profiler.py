"""Profiles of a graph: schema, degrees and coverage, from one aggregate for each table."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.errors import CheckError
from pellucid.functions.types import family, profile_name, variant_name
from pellucid.graph import PropertyGraph
from pellucid.plans.degrees import degrees
from pellucid.sources.catalogue import declared

BUDGET_SECONDS = 60.0


def _quoted(p: str):
    return F.col(f"`{p}`")


def degree_frame(graph: PropertyGraph) -> DataFrame:
    """label, median, p95, p99, maximum of the degrees over all relationships of both directions, for every label.

    Degrees are aggregated once for the whole graph; percentiles are exact and interpolate.
    """
    rows = graph.nodes(with_labels=True).join(degrees(graph, None, "any"), "id", "left").select(F.explode("labels").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"))
    found = rows.groupBy("label").agg(F.percentile("degree", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"), F.max("degree").alias("maximum"))
    return found.select("label", F.element_at("p", 1).alias("median"), F.element_at("p", 2).alias("p95"), F.element_at("p", 3).alias("p99"), "maximum")


def tally(graph: PropertyGraph, owner: str = "node") -> DataFrame:
    """owner_name, property, total, populated for every label (or type) and each of its properties.

    A row with a null property carries the total alone. One aggregation for each table, whatever the number of
    its labels, and all tables in one job; a label that several tables hold is summed over them.
    """
    sets = graph.node_sets if owner == "node" else graph.rel_sets
    names_of = lambda s: (*s.labels, *s.optional) if owner == "node" else (s.type,)
    props_of: dict[str, set] = {}
    for s in sets:
        for name in names_of(s):
            props_of.setdefault(name, set()).update(s.properties)
    parts = []
    for s in sets:
        sums, cells = [], []

        def count(what, sums=sums):
            sums.append(what.alias(f"n{len(sums)}"))
            return F.col(f"n{len(sums) - 1}")

        for name in names_of(s):
            whole = owner != "node" or name in s.labels
            carries = None if whole else F.array_contains("labels", name)
            total = count(F.count("*") if whole else F.count_if(carries))
            cells.append((name, None, total, total))
            for p in sorted(props_of[name]):
                there = _quoted(p) if whole else F.when(carries, _quoted(p))
                cells.append((name, p, total, count(F.count(there)) if p in s.properties else F.lit(0)))
        listed = F.array(*[F.struct(F.lit(n).alias("owner_name"), F.lit(p).cast("string").alias("property"), t.cast("long").alias("total"), c.cast("long").alias("populated")) for n, p, t, c in cells])
        parts.append(s.df.agg(*sums).select(F.explode(listed).alias("x")).select("x.*"))
    if not parts:
        return graph.spark.createDataFrame([], "owner_name string, property string, total long, populated long")
    return reduce(DataFrame.unionByName, parts).groupBy("owner_name", "property").agg(F.sum("total").alias("total"), F.sum("populated").alias("populated"))


def observed_types(graph: PropertyGraph, label: str | None = None) -> DataFrame:
    """label, property, types: the types that values of a property have, sorted, from the values themselves.

    A column of one type is of that type where any value is there; of a column of mixed types (VARIANT) the values
    are looked at one by one. A property without values has no row. One aggregation for each table.
    """
    parts = []
    for s in graph.node_sets:
        names = [x for x in (*s.labels, *s.optional) if label in (None, x)]
        aggregates, cells = [], []
        for name in names:
            carries = F.lit(True) if name in s.labels else F.array_contains("labels", name)
            for p in s.properties:
                there, at = carries & _quoted(p).isNotNull(), f"t{len(cells)}"
                mixed = family(s.kind(p)) == "variant"
                aggregates.append((F.collect_set(F.when(there, variant_name(_quoted(p)))) if mixed else F.max(F.when(there, profile_name(s.kind(p))))).alias(at))  # a handful of type names at most
                cells.append(F.struct(F.lit(name).alias("label"), F.lit(p).alias("property"), (F.col(at) if mixed else F.array_compact(F.array(at))).alias("types")))
        if cells:
            parts.append(s.rows(s.properties, bool(s.optional)).agg(*aggregates).select(F.explode(F.array(*cells)).alias("x")).select("x.*"))
    if not parts:
        return graph.spark.createDataFrame([], "label string, property string, types array<string>")
    each = reduce(DataFrame.unionByName, parts).select("label", "property", F.explode("types").alias("type"))
    return each.groupBy("label", "property").agg(F.array_sort(F.collect_set("type")).alias("types"))


def coverage_frame(graph: PropertyGraph, owner: str = "node") -> DataFrame:
    """owner_name, property, total, populated for every label (or type) and property that occurs."""
    return tally(graph, owner).where("property IS NOT NULL AND populated > 0")


def profile(graph: PropertyGraph, budget: float = BUDGET_SECONDS, constraints: list[dict] | None = None, indexes: list[dict] = (), version: str = "0.1.0") -> dict:
    """A snapshot as a dictionary. After the budget, or where a stage fails, what is complete stays and status is partial.

    constraints: those of a catalogue file; without any, what the tables declare themselves.
    """
    began, reason = time.monotonic(), None
    try:
        nodes, rels = graph.counts()
    except Exception as e:
        raise CheckError("profile.counts_unavailable", str(e).splitlines()[0]) from e
    labels, types, coverage = [], [], []

    def stage(run):
        nonlocal reason
        if reason is None and time.monotonic() - began > budget:
            reason = "profile.budget_exceeded"
        if reason is None:
            try:
                run()
            except Exception as e:  # completed stages stay, the reason says why the rest is missing
                reason = f"{type(e).__name__}: {str(e).splitlines()[0]}"

    degrees_of: dict[str, dict] = {}
    stage(lambda: degrees_of.update({r["label"]: r.asDict() for r in degree_frame(graph).collect()}))

    types_of: dict[tuple, list[str]] = {}
    stage(lambda: types_of.update({(r["label"], r["property"]): r["types"] for r in observed_types(graph).collect()}))  # a row for each property of the catalogue

    def counted(owner: str) -> dict[str, tuple[int, dict[str, int]]]:
        out: dict[str, tuple[int, dict[str, int]]] = {}
        rows = tally(graph, owner).collect()  # a row for each name and property of the catalogue
        for r in rows:
            if r["property"] is None:
                out[r["owner_name"]] = r["total"], {q["property"]: q["populated"] for q in rows if q["owner_name"] == r["owner_name"] and q["property"] is not None and q["populated"]}
        return out

    def of_nodes():
        for label, (n, props) in sorted(counted("node").items()):
            d = degrees_of.get(label, {})
            kinds = {p: " | ".join(types_of.get((label, p), ["ANY"])) for p in props}
            labels.append({
                "name": label, "count": n, "properties": [{"name": p, "type": kinds[p]} for p in sorted(props)],
                "degree_distribution": {"median": round(d.get("median") or 0.0, 2), "p95": round(d.get("p95") or 0.0, 2), "p99": round(d.get("p99") or 0.0, 2), "maximum": int(d.get("maximum") or 0)},
            })
            coverage.extend({"owner": "node", "owner_name": label, "property": p, "coverage": percent(k, n)} for p, k in props.items())

    def of_rels():
        for type_, (n, props) in sorted(counted("relationship").items()):
            types.append({"name": type_, "count": n})
            coverage.extend({"owner": "relationship", "owner_name": type_, "property": p, "coverage": percent(k, n)} for p, k in props.items())

    stage(of_nodes)
    stage(of_rels)
    coverage.sort(key=lambda x: (x["owner"], x["owner_name"], x["property"]))
    listed = lambda xs: sorted(({k: sorted(v) if isinstance(v, (list, tuple)) else v or [] for k, v in x.items()} for x in xs), key=lambda x: x["name"])
    out = {
        "schema_version": "1.0", "status": "partial" if reason else "complete", "partial_reason": reason, "target": {k: v for k, v in graph.target().items() if k in ("database", "server_version", "edition", "fingerprint", "capabilities")},
        "schema": {"labels": labels, "relationship_types": types, "constraints": listed(declared(graph) if constraints is None else constraints), "indexes": listed(indexes)},
        "statistics": {"node_count": nodes, "relationship_count": rels, "property_coverage": coverage},
        "metadata": {"generated_at": dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "version": version},
    }
    out["fingerprint"] = fingerprint(out)
    return out


def check_profile(p: dict) -> None:
    """What a stored profile must satisfy when it is read: reasons, counts, order, and its own fingerprint."""
    wrong, schema, stats = [], p["schema"], p["statistics"]
    if (p["status"] == "complete") != (p["partial_reason"] is None) or p["status"] == "partial" and not p["partial_reason"]:
        wrong.append("partial_reason does not fit status")
    wrong += [f"label {x['name']} has more nodes than there are" for x in schema["labels"] if x["count"] > stats["node_count"]]
    if p["status"] == "complete":
        wrong += [f"type {x['name']} has more relationships than there are" for x in schema["relationship_types"] if x["count"] > stats["relationship_count"]]
        wrong += [f"label {x['name']} has no degrees" for x in schema["labels"] if x.get("degree_distribution") is None]
    for x in schema["labels"]:
        d = x.get("degree_distribution")
        if d is not None and not 0 <= d["median"] <= d["p95"] <= d["p99"] <= d["maximum"]:
            wrong.append(f"the degrees of {x['name']} are out of order")
    lists = {f"{k} by name": [x["name"] for x in schema[k]] for k in ("labels", "relationship_types", "constraints", "indexes")}
    lists |= {f"properties of {x['name']}": [q["name"] for q in x["properties"]] for x in schema["labels"]}
    lists |= {f"{k} of {x['name']}": list(x.get(k) or ()) for g in ("constraints", "indexes") for x in schema[g] for k in ("labels_or_types", "properties")}
    lists["property_coverage"] = [(x["owner"], x["owner_name"], x["property"]) for x in stats["property_coverage"]]
    wrong += [f"{k} are not sorted and distinct" for k, v in lists.items() if v != sorted(set(v))]
    if p["fingerprint"] != fingerprint(p):
        wrong.append("the fingerprint is another's")
    if wrong:
        raise CheckError("profile.invalid", "; ".join(wrong))


def percent(part: int, whole: int) -> float:
    return round(100 * part / whole, 2) if whole else 0.0


def fingerprint(p: dict) -> str:
    """Digest of labels, types and counts; constraints, indexes and coverage do not enter."""
    shape = {"labels": [{k: x[k] for k in ("name", "count", "properties")} for x in p["schema"]["labels"]], "types": p["schema"]["relationship_types"], "counts": [p["statistics"]["node_count"], p["statistics"]["relationship_count"]]}
    return "sha256:" + hashlib.sha256(json.dumps(shape, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def property_types(graph: PropertyGraph, label: str) -> dict[str, str]:
    return {r["property"]: " | ".join(r["types"]) for r in observed_types(graph, label).collect()}
