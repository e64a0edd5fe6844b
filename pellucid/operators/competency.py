"""Assertions over the result of any read-only query."""

from __future__ import annotations

import copy
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pellucid.errors import CheckError
from pellucid.functions.canonical import canonical_of, digest, digest_of
from pellucid.functions.consumption import Consumption, sieve
from pellucid.graph import PropertyGraph
from pellucid.sources.suites import Expect
from pellucid.workers import ship

#: Rows that a result may have before an assertion that needs all of them gives up.
ROW_CEILING = 100_000
#: Rows of a task that are looked through at once for repeats, and partitions at least that the keys of a result are dealt to.
SLICE, DEALT = 1 << 18, 200
#: Columns whose values point at elements.
POINTERS = {"node_element_id": "node", "rel_element_id": "rel", "relationship_element_id": "rel"}
#: Tokens that stand for a value of the graph, and how each is looked up; register_token adds more.
TOKENS: dict[str, Callable[[PropertyGraph], Any]] = {}


def register_token(token: str, lookup: Callable[[PropertyGraph], Any]) -> None:
    """Adds a token; lookup gives its value, or None where nothing stands for it. A name that is taken is an error."""
    if not token.startswith("$") or token in TOKENS:
        raise CheckError("packs.runtime_mismatch", f"the token {token} is no $name or is there already")
    TOKENS[token] = lookup


def freeze(value: Any) -> str:
    """A text under which equal results are equal: booleans apart from numbers, maps without order, instants in UTC."""
    return canonical_of(value)


def _cell(columns: list[str], row: dict) -> Any:
    return row[columns[0]] if len(columns) == 1 else row


@dataclass
class Verdict:
    """What the assertions found; undecided where the ceiling came first."""

    passed: bool
    failures: list[str]
    measured: dict
    rows: list[dict]
    complete: bool


def rows_needed(expect: Expect, ceiling: int = ROW_CEILING) -> int:
    """Rows that every assertion but `unique`, `contains` and `equals` needs, the ceiling and one more at most.

    A lower bound needs that many rows, an upper bound one more; a bare `empty` or `columns` needs one. Only
    what must see a whole result (or find its pinned values) may have to read up to the ceiling.
    """
    if expect.unique is not None or expect.contains is not None or expect.equals is not None:
        return ceiling + 1
    most, r = 1, expect.rows
    if r is not None:
        most = max(most, r.min or 0, *[x + 1 for x in (r.max, r.exactly) if x is not None])
    return min(most, ceiling + 1)


def _zone(df: DataFrame) -> str:
    return df.sparkSession.conf.get("spark.sql.session.timeZone", "UTC")


def _keys(df: DataFrame) -> tuple[Column, Column, T.DataType]:
    """Digests of the whole row and of what a pinned value is held against, and the latter's type."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    whole = digest(row, df.schema)
    return (whole, digest(F.col(f"`{df.columns[0]}`"), df.schema[0].dataType), df.schema[0].dataType) if len(df.columns) == 1 else (whole, whole, df.schema)


def consume(df: DataFrame, expect: Expect, ceiling: int = ROW_CEILING) -> tuple[list[dict], bool, dict]:
    """The rows that decide, whether they are all, and what is known then of `unique`, `contains` and `equals`.

    Where only counts and columns are asked for, a limit that Spark pushes into the plan. Else one lazy pass: a
    task stops in the middle of its partition as soon as its own rows decide, and the next partitions (a few more
    each time, as for a limit) are only opened while all rows so far do not. No partition is computed twice.
    """
    need = rows_needed(expect, ceiling)
    if expect.unique is None and expect.contains is None and expect.equals is None:
        rows = [r.asDict() for r in df.limit(need).collect()]
        return rows, len(rows) < need, {}
    ship(df.sparkSession)
    whole, cell, kind = _keys(df)
    zone = _zone(df)
    state = Consumption(expect, df.columns, [digest_of(v, kind, zone) for v in expect.contains or ()])
    blank, rows, cells = copy.deepcopy(state), [], Counter()
    taken = df.select(whole.alias("whole"), cell.alias("cell"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).rdd
    sc, size, at, step = df.sparkSession.sparkContext, taken.getNumPartitions(), 0, 1
    while at < size and not state.decided and len(rows) < need:
        left = need - len(rows)
        for row in sc.runJob(taken, lambda part, left=left: list(sieve(part, copy.deepcopy(blank), left)), list(range(at, min(size, at + step)))):
            rows.append(row[2].asDict())
            cells[row[1]] += 1
            if state.take(row[0], row[1]) or len(rows) == need:
                break
        at += step
        step = step * 4 if not rows else max(1, min(4 * step, int(1.5 * at * (need - len(rows)) / len(rows))))
    complete = at >= size and not state.decided and len(rows) < need
    known = {}
    if expect.unique is not None and (complete or state.repeated):
        known["unique"] = not state.repeated
    if expect.contains is not None and (complete or not state.open):
        known["contains"] = not state.open
    if expect.equals is not None and complete:
        known["equals"] = cells == Counter(digest_of(v, kind, zone) for v in expect.equals)
    return rows, complete, known


def fetch(df: DataFrame, expect: Expect, ceiling: int = ROW_CEILING) -> tuple[list[dict], bool]:
    """The rows that decide, and whether they are all."""
    return consume(df, expect, ceiling)[:2]


def _thinned(batches):
    """Of each whole number two at most in every SLICE rows: a row that stands very often goes to no single task."""

    def two(held: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([values, values[n > 1]]))], ["head"])

    held, n = [], 0
    for batch in batches:
        held.append(np.asarray(batch.column(0)))
        n += batch.num_rows
        if n >= SLICE:
            yield two(held)
            held, n = [], 0
    if held:
        yield two(held)


def _head(key: Column) -> Column:
    """64 bits of a digest."""
    return F.xxhash64(key)


def _repeated(df: DataFrame, whole: Column, most: int) -> list[bytes]:
    """Digests of rows that stand more than once, `most` of them at most.

    64 bits of each digest are dealt, without a table of them in the task that reads the rows; those that meet their
    like are looked at again in full. Should all of them differ after all, whole digests are counted.
    """
    spark = df.sparkSession
    parts = max(DEALT, int(spark.conf.get("spark.sql.shuffle.partitions")))
    heads = df.select(_head(whole).alias("head")).mapInArrow(_thinned, "head long").repartition(parts, "head")
    some = [(r["head"],) for r in heads.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").limit(most).collect()]
    if not some:
        return []
    keys = df.select(whole.alias("key"))
    twice = lambda rows: [bytes(r["key"]) for r in rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").limit(most).collect()]
    known = F.broadcast(spark.createDataFrame(some, "head long"))  # `most` at most
    return twice(keys.join(known, _head(F.col("key")) == known["head"], "left_semi")) or twice(keys)


def settle(df: DataFrame, expect: Expect, evidence_cap: int = 100) -> tuple[dict, list[dict]]:
    """`unique`, `contains` and `equals` of a result of any size, decided where it lies.

    Rows are known by digests of their canonical text: a repeated row is a digest that stands twice, a pinned value that
    is missing stands nowhere, and bags are equal if each pinned digest stands as often as it is pinned, and no other.
    Pinned values are as many as the suite holds, and tasks count those alone: none holds more of a larger result.
    Returns what holds (None for what is not asked) and some rows that break it.
    """
    spark, zone = df.sparkSession, _zone(df)
    ship(spark)
    whole, cell, kind = _keys(df)
    shown = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    found: dict[str, bool] = {}
    rows: list[dict] = []
    listed = lambda keys: F.broadcast(spark.createDataFrame([(k,) for k in keys], "key binary"))  # noqa: E731  the suite's own values, or evidence_cap

    def pick(keys: DataFrame, key: Column, how: str = "left_semi") -> None:
        hit = df.select(key.alias("key"), shown.alias("row")).join(keys, "key", how).limit(evidence_cap - len(rows))
        rows.extend(r["row"].asDict() for r in hit.collect())

    if expect.unique is not None:
        twice = _repeated(df, whole, evidence_cap)
        found["unique"] = not twice
        if expect.unique and twice:
            pick(listed(twice), whole)
    if expect.contains is not None:
        pinned = {digest_of(v, kind, zone) for v in expect.contains}
        there = df.select(cell.alias("key")).join(listed(pinned), "key", "left_semi").distinct().count()
        found["contains"] = there == len(pinned)
    if expect.equals is not None:
        wanted = Counter(digest_of(v, kind, zone) for v in expect.equals)
        asked = listed(wanted).withColumn("asked", F.col("key"))
        counts = df.select(cell.alias("key")).join(asked, "key", "left").groupBy("asked").agg(F.count("*").alias("n"))
        n = {r["asked"] and bytes(r["asked"]): r["n"] for r in counts.collect()}  # as many as are pinned, and None for all others
        apart = [k for k, v in wanted.items() if n.get(k, 0) != v]
        found["equals"] = not apart and None not in n
        if apart:
            pick(listed(apart[:evidence_cap]), cell)
        if None in n and len(rows) < evidence_cap:
            pick(listed(wanted), cell, "left_anti")
    return found, rows


def judge(columns: list[str], rows: list[dict], complete: bool, expect: Expect, known: dict | None = None) -> Verdict:
    """Holds a result against its assertions. Rows compare as bags; pinned values are scalars for one column, else maps.

    Rows of a result that is not complete only decide what further rows cannot change: a lower bound that is
    reached, an upper one that is passed. known: what consume() or settle() found by digests. What is still open raises
    engine.result_limit_exceeded, unless another assertion has failed already.
    """
    known = known or {}
    n, failures, measured = len(rows), [], {"columns": list(columns), "empty": len(rows) == 0}
    measured["rows" if complete else "observed_rows_at_least"] = n
    undecided = False
    r = expect.rows
    if r is not None:
        for bound, what, short, over in ((r.min, "at least", True, False), (r.max, "at most", False, True), (r.exactly, "exactly", True, True)):
            if bound is None:
                continue
            if over and n > bound or short and n < bound and complete:
                failures.append(f"{n} rows, {what} {bound} expected")
            elif not complete and (over or n < bound):
                undecided = True
    if expect.columns is not None and list(columns) != expect.columns:
        failures.append(f"columns {list(columns)}, {expect.columns} expected")
    if expect.unique is not None:
        repeated = not known["unique"] if "unique" in known else max(Counter(freeze(x) for x in rows).values(), default=1) > 1
        if repeated or complete or "unique" in known:
            measured["unique"] = not repeated
            if repeated is expect.unique:
                failures.append("a row stands more than once" if repeated else "no row stands more than once")
        else:
            undecided = True
    if expect.empty is not None and (n == 0) is not expect.empty:
        failures.append("the result is empty" if n == 0 else "the result is not empty")
    asked = (expect.contains is not None and "contains" not in known) or (expect.equals is not None and "equals" not in known)
    cells = Counter(canonical_of(_cell(columns, x)) for x in rows) if asked else Counter()
    if expect.contains is not None:
        there = known["contains"] if "contains" in known else all(canonical_of(v) in cells for v in expect.contains)
        if there or complete or "contains" in known:
            measured["contains"] = there
            if not there:
                failures.append("a pinned value is missing")
        else:
            undecided = True
    if expect.equals is not None:
        if complete or "equals" in known:
            measured["equals"] = known["equals"] if "equals" in known else cells == Counter(map(canonical_of, expect.equals))
            if not measured["equals"]:
                failures.append("the result differs from the pinned values")
        else:
            undecided = True
    if undecided and not failures:
        raise CheckError("engine.result_limit_exceeded", f"not decided within {n} rows")
    return Verdict(not failures, failures, measured, rows, complete)


def assess(df: DataFrame, expect: Expect, ceiling: int = ROW_CEILING, evidence_cap: int = 100) -> Verdict:
    """One lazy pass up to the ceiling; what a larger result leaves open of `unique`, `contains` and `equals` is settled in the cluster.

    Bounds of rows beyond the ceiling stay open.
    """
    rows, complete, known = consume(df, expect, ceiling)
    broken = []
    try:
        return judge(df.columns, rows, complete, expect, known)
    except CheckError:
        if expect.unique is None and expect.contains is None and expect.equals is None:
            raise
        known, broken = settle(df, expect, evidence_cap)
    found = judge(df.columns, rows, complete, expect, known)
    if broken:
        found.rows = broken
    return found


def pointers(values: Any, column: str | None = None) -> list[dict]:
    """Elements that result values point at: {kind, id} maps at any depth and the pointer columns; plain ids never count."""
    if isinstance(values, Row):
        values = values.asDict()
    if isinstance(values, dict):
        if values.get("kind") in ("node", "rel") and values.get("id") is not None:
            return [{"kind": values["kind"], "id": str(values["id"]), "labels": values.get("labels"), "type": values.get("type")}]
        return [x for k, v in values.items() for x in ([{"kind": POINTERS[k], "id": str(v), "labels": None, "type": None}] if k in POINTERS and v is not None and not isinstance(v, (dict, list, Row)) else pointers(v, k))]
    if isinstance(values, (list, tuple)):
        if column in POINTERS:
            return [{"kind": POINTERS[column], "id": str(v), "labels": None, "type": None} for v in values]
        return [x for v in values for x in pointers(v)]
    return []


def evidence(elements: list[dict], message: str, cap: int, total: int | None = None) -> dict:
    """Distinct elements in the order in which they came, `cap` of them at most."""
    seen = {(e["kind"], e["id"]): e for e in reversed(elements)}
    kept = list(reversed(seen.values()))
    total = max(len(kept), total or 0)
    return {"message": message, "elements": kept[:cap], "truncated": total > min(len(kept), cap), "cap": cap, "total_count": total}


_NAME = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|::|(?<![:\w]):([A-Za-z_]\w*)", re.S)


def parameters(query: str) -> list[str]:
    """Names of :parameters, outside of quotes, back-ticks and comments."""
    return list(dict.fromkeys(m[1] for m in _NAME.finditer(query) if m[1]))


def bind(graph: PropertyGraph, query: str, params: dict) -> dict:
    """Values for the query's parameters; tokens such as $first-active-customer are looked up in the graph."""
    if not query.strip():
        raise CheckError("engine.empty_query", "the query is empty")
    if missing := [n for n in parameters(query) if n not in params]:
        raise CheckError("engine.parameter_missing", f"no value for {', '.join(missing)}")
    return {k: resolve_token(graph, v) if isinstance(v, str) and v.startswith("$") else v for k, v in params.items()}


def resolve_token(graph: PropertyGraph, token: str) -> Any:
    if token not in TOKENS:
        raise CheckError("engine.parameter_token_unknown", f"unknown token {token}")
    value = TOKENS[token](graph)
    if value is None:
        raise CheckError("engine.parameter_token_unresolved", f"nothing stands for {token}")
    return value


def first_active(graph: PropertyGraph, label: str = "Customer") -> DataFrame:
    """The node of the smallest id (as text) that is active: `active`, else `status` = 'active', else neither is set."""
    have = {p for s in graph.node_sets if label in s.labels or label in s.optional for p in s.properties}
    tests = [F.col("active").cast("boolean")] * ("active" in have) + [F.lower("status") == "active"] * ("status" in have)
    rows = graph.nodes(label, sorted(have & {"active", "status"}))
    return rows.where(F.coalesce(*tests, F.lit(True))).select("id").orderBy("id").limit(1)
