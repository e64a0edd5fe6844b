"""Stored runs: writing, finding, comparing and pruning; and the same comparison over a frame of many runs."""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.errors import CheckError
from pellucid.runner import check_results

#: A verdict's rank: higher is worse. An errored check of severity error ranks with failures.
RANK = {"pass": 0, "skipped": 1, "warn": 2, "errored": 3, "fail": 4}


def rank(check: dict) -> int:
    return 4 if check["verdict"] == "errored" and check["severity"] == "error" else RANK[check["verdict"]]


class Runs:
    """A folder of runs (<id>/results.json) and a copy of the newest in `latest`."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def write(self, results: dict, report: str | None = None) -> Path:
        """Writes into a folder beside and renames it, so that no reader sees half a run."""
        check_results(results)
        run_id = results["run"]["id"]
        if not run_id or "/" in run_id or run_id in (".", "..", "latest"):
            raise CheckError("results.invalid", f"{run_id!r} is no run id")
        part, final = self.folder / f".{run_id}.part", self.folder / run_id
        part.mkdir(parents=True, exist_ok=False)
        summary = {"id": run_id, "status": results["run"]["status"], "exit_code": results["run"]["exit_code"], "score": results["score"]["value"], "totals": results["totals"]}
        for name, text in (("results.json", json.dumps(results, indent=2, sort_keys=True, default=str)), ("summary.json", json.dumps(summary, sort_keys=True)), ("report.html", report)):
            if text is not None:
                (part / name).write_text(text)
        os.rename(part, final)
        fresh = self.folder / ".latest.part"
        shutil.rmtree(fresh, ignore_errors=True)
        shutil.copytree(final, fresh)
        shutil.rmtree(self.folder / "latest", ignore_errors=True)
        os.rename(fresh, self.folder / "latest")
        return final

    def all(self) -> list[dict]:
        """Results by start, newest first; one for each run id, `latest` only where nothing else has it."""
        found: dict[str, dict] = {}
        for path in sorted(self.folder.glob("*/results.json"), key=lambda p: p.parent.name == "latest"):
            results = json.loads(path.read_text())
            check_results(results)
            found.setdefault(results["run"]["id"], results)
        return sorted(found.values(), key=lambda r: (r["run"]["started_at"], r["run"]["id"]), reverse=True)

    def read(self, run_id: str) -> dict:
        for r in self.all():
            if r["run"]["id"] == run_id:
                return r
        raise CheckError("history.not_found", f"no run {run_id}")

    def prune(self, keep: int) -> list[str]:
        """Deletes all but the newest `keep` runs."""
        if keep < 1:
            raise ValueError("keep at least one run")
        gone = [r["run"]["id"] for r in self.all()[keep:]]
        for run_id in gone:
            self.delete(run_id)
        return gone

    def delete(self, run_id: str) -> None:
        path = (self.folder / run_id).resolve()
        if path.parent != self.folder.resolve() or not (path / "results.json").is_file() or (self.folder / run_id).is_symlink():
            raise CheckError("history.not_found", f"no run {run_id}")
        shutil.rmtree(path)


def listing(runs: list[dict]) -> list[dict]:
    """What a list of stored runs shows of each: newest first, the first one marked as the latest."""
    order = sorted(runs, key=lambda r: (r["run"]["started_at"], r["run"]["id"]), reverse=True)
    return [
        {"id": r["run"]["id"], "finished_at": r["run"]["finished_at"], "status": r["run"]["status"], "suite_scores": [{"id": s["id"], "score": s["score"]} for s in r["suites"]], "latest": i == 0}
        for i, r in enumerate(order)
    ]


def chosen_ids(asked, exactly: int | None = None) -> list[str]:
    """Run ids of a request: 1 to 100 distinct ones, or just so many."""
    if not isinstance(asked, list) or not 1 <= len(asked) <= 100 or any(not isinstance(x, str) or not x for x in asked) or len(set(asked)) < len(asked) or exactly not in (None, len(asked)):
        raise CheckError("history.selection_invalid", f"name {exactly or '1 to 100'} different runs")
    return asked


def compare_runs(before: dict, after: dict) -> dict:
    """Regressions, improvements and other changes of the checks that both runs have; what came and went; suite scores."""
    a, b = ({(c["suite_id"], c["id"]): c for c in r["checks"]} for r in (before, after))
    out = {"regressions": [], "improvements": [], "other": [], "added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys())}
    for k in sorted(a.keys() & b.keys()):
        if a[k]["verdict"] != b[k]["verdict"]:
            move = rank(b[k]) - rank(a[k])
            out["regressions" if move > 0 else "improvements" if move < 0 else "other"].append({"suite_id": k[0], "id": k[1], "from": a[k]["verdict"], "to": b[k]["verdict"]})
    s, t = ({x["id"]: x["score"] for x in r["suites"]} for r in (before, after))
    out["suites"] = [{"id": i, "from": s.get(i), "to": t.get(i), "delta": t[i] - s[i] if s.get(i) is not None and t.get(i) is not None else None} for i in sorted(s.keys() | t.keys())]
    return out


def results_frame(spark: SparkSession, runs: list[dict]) -> DataFrame:
    """run_id, started_at, suite_id, id, pattern, severity, verdict, duration_ms: a row for each check of each run."""
    rows = [(r["run"]["id"], r["run"]["started_at"], c["suite_id"], c["id"], c["pattern"], c["severity"], c["verdict"], c["duration_ms"]) for r in runs for c in r["checks"]]
    return spark.createDataFrame(rows, "run_id string, started_at string, suite_id string, id string, pattern string, severity string, verdict string, duration_ms long")


def rank_column():
    out = F.when((F.col("verdict") == "errored") & (F.col("severity") == "error"), 4)
    for v, n in RANK.items():
        out = out.when(F.col("verdict") == v, n)
    return out


def compare_frames(before: DataFrame, after: DataFrame) -> DataFrame:
    """suite_id, id, v_from, v_to, change for two frames of check results: one full outer join."""
    keys = ["suite_id", "id"]
    a = before.select(*keys, F.col("verdict").alias("v_from"), rank_column().alias("r_from"))
    b = after.select(*keys, F.col("verdict").alias("v_to"), rank_column().alias("r_to"))
    change = (
        F.when(F.col("v_from").isNull(), "added").when(F.col("v_to").isNull(), "removed").when(F.col("v_from") == F.col("v_to"), "same")
        .when(F.col("r_to") > F.col("r_from"), "regression").when(F.col("r_to") < F.col("r_from"), "improvement").otherwise("other")
    )
    return a.join(b, keys, "full").select(*keys, "v_from", "v_to", change.alias("change"))


def totals_frame(results: DataFrame, *by: str) -> DataFrame:
    from pellucid.scoring import VERDICTS

    return results.groupBy(*by).agg(F.count("*").alias("checks"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def count_band(n):
    """0, 1-5, 6-20, 21-100, 101+."""
    return F.when(n == 0, "0").when(n <= 5, "1-5").when(n <= 20, "6-20").when(n <= 100, "21-100").otherwise("101+")
