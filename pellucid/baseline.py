"""Baselines: lookup of a metric's earlier value, and the tolerances that drift is held against."""

from __future__ import annotations

import datetime as dt
import json
import math
import os
import re
from pathlib import Path

from pellucid.errors import CheckError

TOLERANCES = ("max_drop_pct", "max_increase_pct", "max_change_pct", "max_delta", "absolute", "min", "max")
_FILE = re.compile(r"\d{8}T\d{6}\.\d{6}\.json")


def target_key(target: dict) -> str:
    return "|".join(f"{k}={target[k]}" for k in sorted(target))


def lookup(baseline, metric: str, target: dict):
    """A metric's value in a scalar, a {metric: ...} mapping (flat, keyed or nested by owner) or a profile; None if absent.

    An entry may be the value itself or a mapping with the keys value and, if wanted, evidence.
    """
    found = _entry(baseline, metric, target)
    return found.get("value") if isinstance(found, dict) else found


def entry_evidence(baseline, metric: str, target: dict) -> list[dict]:
    """Elements that a baseline entry names as evidence."""
    found = _entry(baseline, metric, target)
    listed = found.get("evidence") or [] if isinstance(found, dict) else []
    return [{"kind": e["kind"], "id": str(e["id"]), "labels": e.get("labels"), "type": e.get("type")} for e in listed]


def _entry(baseline, metric: str, target: dict):
    if isinstance(baseline, dict) and "statistics" in baseline and "schema" in baseline:
        return _from_profile(baseline, metric, target)
    if not isinstance(baseline, dict) or set(baseline) <= {"value", "evidence"} and "value" in baseline:
        return baseline
    found = baseline.get(metric)
    if isinstance(found, dict) and (key := target_key(target)) in found:
        return found[key]
    for part in [target[k] for k in ("label", "type", "property") if k in target]:
        if not isinstance(found, dict) or "value" in found:
            break
        found = found.get(part)
    return None if isinstance(found, dict) and "value" not in found else found


def _from_profile(p: dict, metric: str, target: dict):
    named = lambda group, name: next((x["count"] for x in p["schema"][group] if x["name"] == name), None)
    if metric == "node_count":
        return named("labels", target["label"]) if "label" in target else p["statistics"].get("node_count")
    if metric == "relationship_count":
        return named("relationship_types", target["type"]) if "type" in target else p["statistics"].get("relationship_count")
    owner, name = ("node", target.get("label")) if "label" in target else ("relationship", target.get("type"))
    return next((x["coverage"] for x in p["statistics"]["property_coverage"] if (x["owner"], x["owner_name"], x["property"]) == (owner, name, target.get("property"))), None)


def require(baseline, metric: str, target: dict) -> float:
    """The value, which must be a finite number of 0 or more."""
    value = None if baseline is None else lookup(baseline, metric, target)
    if value is None:
        partial = isinstance(baseline, dict) and baseline.get("status") == "partial"
        raise CheckError("engine.baseline_partial_missing" if partial else "engine.baseline_missing", f"no baseline for {metric} {target_key(target)}".rstrip())
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value < 0:
        raise CheckError("engine.baseline_invalid", f"{value!r} is no baseline value")
    return value


class Snapshots:
    """A folder of profiles, one JSON file each, named by the time at which it was written."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def write(self, profile: dict, now: dt.datetime | None = None) -> Path:
        """Never overwrites: a taken name moves on by a microsecond."""
        now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        self.folder.mkdir(parents=True, exist_ok=True)
        while True:
            path = self.folder / f"{now:%Y%m%dT%H%M%S.%f}.json"
            try:
                with path.open("x") as out:
                    json.dump(profile, out, indent=2, sort_keys=True)
                return path
            except FileExistsError:
                now += dt.timedelta(microseconds=1)

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json") if _FILE.fullmatch(p.name)) if self.folder.is_dir() else []

    def read(self, name: str) -> dict:
        path = self.folder / f"{name}.json"
        if not path.is_file():
            raise CheckError("baseline.not_found", f"no snapshot {name}")
        try:
            found = json.loads(path.read_text())
        except ValueError:
            raise CheckError("baseline.invalid", f"{name} is no JSON") from None
        if isinstance(found, dict) and {"schema", "statistics", "fingerprint"} <= found.keys():
            from pellucid.profiler import check_profile

            check_profile(found)
        return found

    def set_current(self, name: str) -> None:
        if name not in self.names():
            raise CheckError("baseline.not_found", f"no snapshot {name}")
        part = self.folder / "current-baseline.json.part"
        part.write_text(json.dumps({"baseline": name}))
        os.replace(part, self.folder / "current-baseline.json")

    def current(self) -> str | None:
        """The chosen snapshot, else the last but one."""
        path = self.folder / "current-baseline.json"
        if path.is_file():
            name = json.loads(path.read_text()).get("baseline")
            if name not in self.names():
                raise CheckError("baseline.not_found", f"the current baseline {name} is gone")
            return name
        return self.names()[-2] if len(self.names()) > 1 else None

    def pair(self, a: str | None = None, b: str | None = None) -> tuple[str, str]:
        """What a diff compares: both as named, else the current one with the last."""
        if (a is None) != (b is None):
            raise CheckError("baseline.pair_invalid", "name both snapshots or none")
        if a is not None:
            return a, b
        names = self.names()
        if len(names) < 2 or self.current() is None:
            raise CheckError("baseline.not_enough", "two snapshots are needed")
        return self.current(), names[-1]

    def resolve(self, ref: str) -> dict | None:
        names = self.names() or sorted(p.stem for p in self.folder.glob("*.json")) if self.folder.is_dir() else []
        name = names[-1] if ref == "latest" and names else ref
        return self.read(name) if name in names else None


def check_tolerance(tolerance: dict) -> None:
    if unknown := set(tolerance) - set(TOLERANCES):
        raise CheckError("engine.tolerance_unsupported", f"unknown tolerance {', '.join(sorted(unknown))}")
    if not tolerance:
        raise CheckError("engine.tolerance_invalid", "no tolerance is given")
    for k, v in tolerance.items():
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or (v < 0 and k not in ("min", "max")):
            raise CheckError("engine.tolerance_invalid", f"{k}: {v!r}")


def within(tolerance: dict, current: float, baseline: float) -> list[str]:
    """What the move from baseline to current breaks; percent of a zero baseline is infinite unless nothing moved."""
    check_tolerance(tolerance)
    delta = current - baseline
    pct = 0.0 if delta == 0 else 100 * abs(delta) / abs(baseline) if baseline else math.inf
    limit = tolerance.get("max_delta", tolerance.get("absolute"))
    broken = {
        "max_drop_pct": delta < 0 and pct > tolerance.get("max_drop_pct", math.inf),
        "max_increase_pct": delta > 0 and pct > tolerance.get("max_increase_pct", math.inf),
        "max_change_pct": pct > tolerance.get("max_change_pct", math.inf) or pct == math.inf and "max_change_pct" in tolerance,
        "max_delta": limit is not None and abs(delta) > limit,
        "min": current < tolerance.get("min", -math.inf),
        "max": current > tolerance.get("max", math.inf),
    }
    if pct == math.inf:
        broken["max_drop_pct"] = delta < 0 and "max_drop_pct" in tolerance
        broken["max_increase_pct"] = delta > 0 and "max_increase_pct" in tolerance
    return [f"{k}: {baseline:g} to {current:g} ({'' if pct == math.inf else '-' if delta < 0 else '+'}{pct:.4g}%)" for k, bad in broken.items() if bad]


def drift_measured(current: float, baseline: float) -> dict:
    return {"current": current, "baseline": baseline, "delta": current - baseline, "change_pct": None if not baseline else 100 * (current - baseline) / abs(baseline)}
