"""Redacted exports: names become aliases, literals are masked, and the export is searched for leaks."""

from __future__ import annotations

import copy
import json
import re

from pellucid.errors import CheckError

MASK = "[redacted]"
#: Strings that may stay: words of the format itself.
_FREE = re.compile(r"(?:[a-z_-]{1,40}(?:\.[a-z_-]+)*|sha256:[0-9a-f]+|\d{4}-\d\d-\d\dT[\d:.]+Z?|\d+\.\d+(?:\.\d+)?)")


class _Aliases:
    def __init__(self):
        self.names: dict[tuple[str, str], str] = {}

    def __call__(self, kind: str, name: str) -> str:
        return self.names.setdefault((kind, name), f"{kind}-{sum(k == kind for k, _ in self.names) + 1}")


def redact(results: dict) -> dict:
    """A copy without suite, check, tag, label and type names and without any literal of queries, parameters or evidence."""
    out, alias = copy.deepcopy(results), _Aliases()
    run = out["run"]
    run["redaction"] = {"policy": "full", "applied": True}
    run["id"] = alias("run", run["id"])
    run["selection"]["suites"] = [alias("suite", x) for x in run["selection"]["suites"]]
    run["selection"]["tags"] = [alias("tag", x) for x in run["selection"]["tags"]]
    if run["target"]:
        run["target"] |= {"database": MASK, "fingerprint": MASK, "labels": [alias("label", x) for x in run["target"]["labels"]], "relationship_types": [alias("type", x) for x in run["target"]["relationship_types"]]}
    for s in out["suites"]:
        s |= {"id": alias("suite", s["id"]), "source_sha": MASK}
    for c in out["checks"]:
        c |= {"id": alias("check", f"{c['suite_id']}/{c['id']}"), "suite_id": alias("suite", c["suite_id"]), "name": MASK, "provenance": None if c["provenance"] is None else MASK, "compiled_query": None if c["compiled_query"] is None else MASK}
        for k in ("params", "expected", "measured"):
            c[k] = _masked(c[k], k == "measured")
        if c["evidence"]:
            c["evidence"] |= {"message": MASK, "elements": [{"kind": e["kind"], "id": alias("element", e["id"]), "labels": [alias("label", x) for x in e.get("labels") or []], "type": alias("type", e["type"]) if e.get("type") else None} for e in c["evidence"]["elements"]]}
        if c["error"]:
            c["error"] = {"code": c["error"]["code"], "message": MASK}
    if run.get("error"):
        run["error"] = {"code": run["error"]["code"], "message": MASK}
    verify(results, out)
    return out


def _masked(value, numbers: bool):
    """Numbers and booleans of measurements stay; every other literal and every free key goes."""
    if isinstance(value, dict):
        return {(k if _FREE.fullmatch(str(k)) else MASK): _masked(v, numbers) for k, v in value.items()}
    if isinstance(value, list):
        return [_masked(v, numbers) for v in value]
    return value if value is None or isinstance(value, bool) or numbers and isinstance(value, (int, float)) else MASK


def secrets(results: dict) -> set[str]:
    """Strings of a result that an export must not hold."""
    found: set[str] = set()

    def walk(v):
        if isinstance(v, dict):
            for x in v.values():
                walk(x)
        elif isinstance(v, list):
            for x in v:
                walk(x)
        elif isinstance(v, str) and len(v) > 3:
            found.add(v)

    for c in results["checks"]:
        walk([c["name"], c["provenance"], c["compiled_query"], c["params"], c["expected"], (c["evidence"] or {}).get("elements"), (c["evidence"] or {}).get("message"), (c["error"] or {}).get("message"), c["id"], c["suite_id"]])
    return {s for s in found if not _FREE.fullmatch(s)}


def verify(results: dict, export: dict) -> None:
    text = json.dumps(export)
    if any(json.dumps(s)[1:-1] in text for s in secrets(results)):
        raise CheckError("redaction.leak", "the export still holds a masked string")
