"""Differences of two profiles, and of the tables that many profiles flatten to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pellucid.errors import CheckError


def _counts(before: list[dict], after: list[dict]) -> dict:
    a, b = ({x["name"]: x["count"] for x in xs} for xs in (before, after))
    entry = lambda n: {"name": n, "from": a[n], "to": b[n], "delta": b[n] - a[n], "pct": round(100 * (b[n] - a[n]) / a[n], 1) if a[n] else None}
    return {
        "changed": [entry(n) for n in sorted(a.keys() & b.keys()) if a[n] != b[n]], "added": [{"name": n, "count": b[n]} for n in sorted(b.keys() - a.keys())],
        "removed": [{"name": n, "count": a[n]} for n in sorted(a.keys() - b.keys())], "unchanged": [n for n in sorted(a.keys() & b.keys()) if a[n] == b[n]],
    }


def _definitions(before: list[dict], after: list[dict]) -> dict:
    """A definition that changed is removed and added."""
    key = lambda x: json.dumps(x, sort_keys=True)
    a, b = ({key(x): x for x in xs} for xs in (before, after))
    return {"added": [b[k] for k in sorted(b.keys() - a.keys())], "removed": [a[k] for k in sorted(a.keys() - b.keys())]}


def compare(before: dict, after: dict) -> dict:
    """All drift between two complete profiles of one schema version."""
    if before["schema_version"] != after["schema_version"]:
        raise CheckError("diff.schema_version_mismatch", f"{before['schema_version']} and {after['schema_version']}")
    if "partial" in (before["status"], after["status"]):
        raise CheckError("diff.partial_baseline", "a partial profile cannot be compared")
    s, t = before["schema"], after["schema"]
    cover = [{(x["owner_name"], x["property"], x["owner"]): x["coverage"] for x in p["statistics"]["property_coverage"]} for p in (before, after)]
    both = sorted(cover[0].keys() & cover[1].keys())
    named = lambda k: {"owner": k[2], "owner_name": k[0], "property": k[1]}
    degree = [{x["name"]: x.get("degree_distribution") for x in p["labels"]} for p in (s, t)]
    out = {
        "database_changed": before["target"]["database"] != after["target"]["database"], "fingerprint_changed": before["fingerprint"] != after["fingerprint"],
        "nodes": {"from": before["statistics"]["node_count"], "to": after["statistics"]["node_count"]}, "relationships": {"from": before["statistics"]["relationship_count"], "to": after["statistics"]["relationship_count"]},
        "labels": _counts(s["labels"], t["labels"]), "relationship_types": _counts(s["relationship_types"], t["relationship_types"]),
        "constraints": _definitions(s["constraints"], t["constraints"]), "indexes": _definitions(s["indexes"], t["indexes"]),
        "coverage": {
            "changed": [named(k) | {"from": cover[0][k], "to": cover[1][k], "delta_pp": round(cover[1][k] - cover[0][k], 1)} for k in both if cover[0][k] != cover[1][k]],
            "added": [named(k) | {"coverage": cover[1][k]} for k in sorted(cover[1].keys() - cover[0].keys())], "removed": [named(k) | {"coverage": cover[0][k]} for k in sorted(cover[0].keys() - cover[1].keys())],
        },
        "degrees": [{"name": n, "from": degree[0][n], "to": degree[1][n]} for n in sorted(degree[0].keys() & degree[1].keys()) if degree[0][n] != degree[1][n]],
    }
    parts = [out[k][x] for k in ("labels", "relationship_types", "constraints", "indexes", "coverage") for x in ("changed", "added", "removed") if x in out[k]]
    out["drift_detected"] = bool(out["fingerprint_changed"] or any(parts) or out["degrees"] or any(out[k]["from"] != out[k]["to"] for k in ("nodes", "relationships")))
    return out


def exit_code(d: dict, as_json: bool = False) -> int:
    """0 without drift, 1 with; 2 where two databases are to be compared for a machine (people are shown the difference)."""
    return 2 if d["database_changed"] and as_json else int(d["drift_detected"])


def render(d: dict) -> str:
    """A few lines of text."""
    lines = [f"{k}: {d[k]['from']} -> {d[k]['to']}" for k in ("nodes", "relationships")]
    for k in ("labels", "relationship_types"):
        lines += [f"{k}: {x['name']} {x['from']} -> {x['to']} ({x['delta']:+d}, {'new' if x['pct'] is None else f'{x["pct"]:+.1f} %'})" for x in d[k]["changed"]]
        lines += [f"{k}: {w} {x['name']} ({x['count']})" for w in ("added", "removed") for x in d[k][w]]
    lines += [f"coverage: {x['owner_name']}.{x['property']} {x['from']} -> {x['to']} ({x['delta_pp']:+.1f} pp)" for x in d["coverage"]["changed"]]
    lines += [f"{k}: {w} {x['name']}" for k in ("constraints", "indexes") for w in ("added", "removed") for x in d[k][w]]
    return "\n".join([*lines, "drift" if d["drift_detected"] else "no drift"])


def count_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, n_from, n_to, delta, pct, change for two frames of name, count: one full outer join."""
    a, b = before.select("name", F.col("count").alias("n_from")), after.select("name", F.col("count").alias("n_to"))
    change = F.when(F.col("n_from").isNull(), "added").when(F.col("n_to").isNull(), "removed").when(F.col("n_from") == F.col("n_to"), "unchanged").otherwise("changed")
    both = F.col("n_from").isNotNull() & F.col("n_to").isNotNull()
    rows = a.join(b, "name", "full")
    return rows.select("name", "n_from", "n_to", F.when(both, F.col("n_to") - F.col("n_from")).alias("delta"), F.when(both & (F.col("n_from") != 0), 100.0 * (F.col("n_to") - F.col("n_from")) / F.col("n_from")).alias("pct"), change.alias("change"))


def coverage_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """owner_name, property, c_from, c_to, delta_pp for two frames of owner_name, property, coverage."""
    keys = ["owner_name", "property"]
    rows = before.select(*keys, F.col("coverage").alias("c_from")).join(after.select(*keys, F.col("coverage").alias("c_to")), keys, "full")
    return rows.withColumn("delta_pp", F.col("c_to") - F.col("c_from"))


def definition_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, change and the definition for two frames of definitions (name and any further columns): a full outer join on all of them.

    A definition that changed is removed and added; columns that are lists compare without order, nulls as a value.
    """
    columns = before.columns
    flat = lambda df: df.select(*[(F.array_sort(c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c)).alias(c) for c in columns]).distinct()
    a, b = flat(before).withColumn("before", F.lit(True)), flat(after).withColumn("after", F.lit(True))
    same = [a[c].eqNullSafe(b[c]) for c in columns]
    rows = a.join(b, same, "full").where(F.col("before").isNull() | F.col("after").isNull())
    change = F.when(F.col("before").isNull(), "added").otherwise("removed").alias("change")
    return rows.select(*[F.when(F.col("before").isNull(), b[c]).otherwise(a[c]).alias(c) for c in columns], change)


def degree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, measure, d_from, d_to for two frames of degree distributions (name, median, p95, p99, maximum): what moved of the names in both.

    A distribution that one side lacks is null and no move.
    """
    measures = ("median", "p95", "p99", "maximum")
    tall = lambda df, value: df.select("name", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m).cast("double"), 2).alias(value)) for m in measures])).alias("x")).select("name", "x.*")
    return tall(before, "d_from").join(tall(after, "d_to"), ["name", "measure"]).where("d_from <> d_to")
