"""Canonical texts, and results decided in one pass or in the cluster."""

import datetime as dt
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pellucid.errors import CheckError
from pellucid.functions import canonical as can
from pellucid.functions.consumption import Consumption, sieve
from pellucid.operators import competency as comp
from pellucid.sources.suites import Expect, Rows


def texts(spark, schema, values):
    frame = spark.createDataFrame([(v,) for v in values], f"x {schema}")
    return [r[0] for r in frame.select(can.canonical(F.col("x"), frame.schema["x"].dataType)).collect()]


BIG = [0, 1, -1, 10**18 - 1, 10**18, 10**18 + 1, 2**60, 2**63 - 1, -(2**63), 9 * 10**18, 9 * 10**18 + 1]
CASES = {
    "bigint": BIG, "int": [0, -5, 2**31 - 1, None], "double": [0.0, -0.0, 1.0, 0.1, 1e18, 2.0**60, 1e300, -2.5, float("nan"), float("inf"), float("-inf"), None], "float": [0.5, 0.1, 3.0],
    "decimal(10,2)": [Decimal("1.00"), Decimal("0.10"), Decimal("-2.50"), None], "decimal(38,10)": [Decimal("0.1"), Decimal("12345678901234567890.1234567891"), Decimal("5"), Decimal("1000000000000000001")],
    "decimal(38,0)": [Decimal(10**23), Decimal(10**30 + 1), Decimal(7), Decimal(2**60)], "string": ["", "a", "ß€😀", "7", None], "binary": [b"", b"\x00\xff"], "boolean": [True, False, None], "date": [dt.date(2020, 2, 29), dt.date(1, 1, 1)],
    "timestamp_ntz": [dt.datetime(2020, 1, 2, 3, 4, 5), dt.datetime(1999, 12, 31, 23, 59, 59, 120000)], "array<int>": [[], [1, None, 2], None], "array<string>": [["a", "b"], ["ab", ""]],
    "map<string,int>": [{"b": 1, "a": 2}, {"a": 2, "b": 1}, {}], "map<string,string>": [{"kind": "node", "id": "n1", "x": "y"}, {"kind": "other", "id": "n1"}], "struct<a:int,b:array<double>>": [{"a": 1, "b": [1.0, None]}, None],
    "struct<kind:string,id:string,labels:array<string>>": [{"kind": "rel", "id": "r", "labels": None}, {"kind": "none", "id": "r", "labels": ["L"]}],
}


@pytest.mark.parametrize("schema", CASES)
def test_spark_and_python_write_the_same_text(spark, schema):
    kind = spark.createDataFrame([], f"x {schema}").schema["x"].dataType
    single = (lambda v: float(spark.range(1).select(F.lit(v).cast("float")).first()[0])) if schema == "float" else (lambda v: v)
    assert texts(spark, schema, CASES[schema]) == [can.canonical_of(single(v), kind) for v in CASES[schema]]


def test_equal_values_of_different_types_have_one_text(spark):
    one = {texts(spark, s, [v])[0] for s, v in (("int", 1), ("double", 1.0), ("decimal(5,2)", Decimal("1.00")), ("decimal(38,18)", Decimal(1)))} | {can.canonical_of(x) for x in (1, 1.0, Decimal("1.0"))}
    tenth = {texts(spark, s, [v])[0] for s, v in (("double", 0.1), ("decimal(5,2)", Decimal("0.10")), ("decimal(38,18)", Decimal("0.1")))} | {can.canonical_of(0.1)}
    assert len(one) == len(tenth) == 1 and can.canonical_of(True) not in one
    variant = spark.sql("SELECT parse_json(j) AS x FROM VALUES ('1'), ('1.0'), ('1.00'), ('true'), ('\"1\"'), ('null'), ('0.1'), ('[1]'), ('[1.0]'), ('1e0') t(j)")
    found = [r[0] for r in variant.select(can.canonical(F.col("x"), variant.schema["x"].dataType)).collect()]
    assert found[:3] == [can.canonical_of(1)] * 3 and found[9] == found[0] and found[3:7] == [can.canonical_of(x) for x in (True, "1", None, 0.1)]


def test_instants_are_compared_in_utc(spark):
    east = dt.timezone(dt.timedelta(hours=5))
    frame = spark.sql("SELECT timestamp'2020-01-01 00:00:00' AS x")
    kind = frame.schema["x"].dataType
    assert frame.select(can.canonical(F.col("x"), kind)).first()[0] == can.canonical_of(dt.datetime(2020, 1, 1, 5, tzinfo=east)) == can.canonical_of(dt.datetime(2020, 1, 1), kind, "UTC")
    assert comp.assess(frame, Expect(equals=[dt.datetime(2020, 1, 1)])).passed


def test_texts_do_not_run_into_each_other():
    rng = random.Random(2)
    value = lambda d: rng.choice([None, True, rng.randint(-3, 30), rng.choice("ab1[]:"), rng.random(), *([[value(d - 1) for _ in range(rng.randint(0, 3))], {rng.choice("abc"): value(d - 1) for _ in range(2)}] if d else [])])
    same = lambda a, b: type(a) is type(b) and (len(a) == len(b) and all(map(same, a, b)) if isinstance(a, list) else a.keys() == b.keys() and all(same(a[k], b[k]) for k in a) if isinstance(a, dict) else a == b)
    values = [value(2) for _ in range(300)]
    for a, b in itertools.combinations(values, 2):
        assert (can.canonical_of(a) == can.canonical_of(b)) is same(a, b), (a, b)


def test_a_task_stops_in_the_middle():
    pulled = []
    rows = lambda: ((pulled.append(i) or i, i) for i in range(1_000_000))
    for expect, n in ((Expect(rows=Rows(min=3)), 3), (Expect(rows=Rows(max=2)), 3), (Expect(contains=[7]), 8), (Expect(unique=True, empty=True), 1), (Expect(equals=[1]), 50), (Expect(contains=[7], unique=True), 50)):
        pulled.clear()
        assert len(list(sieve(rows(), Consumption(expect, ["x"], expect.contains or ()), 50))) == len(pulled) == n, expect


def counted(spark, rows_each, parts):
    """A result whose partitions say which of them were opened, and how far they were read."""
    opened, read = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def run(batches):
        opened.add(1)
        for batch in batches:
            for a in range(0, batch.num_rows, 10):
                read.add(min(10, batch.num_rows - a))
                yield batch.slice(a, 10)

    return spark.range(0, rows_each * parts, 1, parts).mapInArrow(run, "id long"), opened, read


def test_one_pass_opens_no_partition_twice(spark):
    df, opened, read = counted(spark, 1_000, 12)
    assert comp.assess(df, Expect(contains=[5, 2_500])).passed
    assert opened.value <= 5
    opened.value = read.value = 0
    assert comp.assess(df, Expect(equals=list(range(12_000)))).passed and opened.value == 12 and read.value == 12_000
    opened.value = read.value = 0
    found = comp.assess(df, Expect(unique=True, rows=Rows(exactly=12_000)))
    assert found.passed and found.complete and found.measured["rows"] == 12_000 and opened.value == 12


def test_a_large_bag_is_decided_where_it_lies(spark):
    n = 300_000
    df = spark.range(0, n, 1, 6).selectExpr("id DIV 100000 AS k", "named_struct('a', id % 3 = 5) AS v")
    bag = [{"k": k, "v": {"a": False}} for k in (0, 1, 2) for _ in range(100_000)]
    found = comp.assess(df, Expect(equals=bag), ceiling=1_000)
    assert found.passed and found.measured["equals"] and not found.complete and len(found.rows) == 1_001
    found = comp.assess(df, Expect(equals=[*bag[1:], bag[-1]]), ceiling=1_000)
    assert not found.passed and {r["k"] for r in found.rows} <= {0, 2} and len(found.rows) <= 100
    assert not comp.assess(df, Expect(contains=[bag[0], {"k": 7, "v": {"a": False}}]), ceiling=1_000).passed
    late = spark.range(0, n, 1, 6)
    assert comp.assess(late, Expect(contains=[n - 1, 5.0]), ceiling=1_000).passed and comp.assess(late, Expect(unique=True), ceiling=1_000).passed
    twice = late.selectExpr(f"id % {n - 3} AS node_element_id")
    found = comp.assess(twice, Expect(unique=True), ceiling=1_000)
    assert not found.passed and {r["node_element_id"] for r in found.rows} <= {0, 1, 2} and comp.assess(twice, Expect(unique=False), ceiling=1_000).passed
    with pytest.raises(CheckError, match="result_limit_exceeded"):
        comp.assess(late, Expect(unique=True, rows=Rows(max=n)), ceiling=1_000)


def test_verdicts_are_those_of_plain_counting(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["a", "b", None])) for _ in range(rng.randint(0, 8))]
        df = spark.createDataFrame(rows, "x int, y string").repartition(3)
        dicts = [{"x": x, "y": y} for x, y in rows]
        pinned = rng.sample(dicts, min(2, len(dicts))) or [{"x": 1, "y": "a"}]
        bag = dicts[:] if rng.random() < 0.6 else dicts + [{"x": 9, "y": None}]
        for expect in (Expect(unique=True), Expect(unique=False), Expect(contains=pinned), Expect(contains=[{"x": 1.0, "y": "a"}]), Expect(equals=bag)):
            want = comp.judge(["x", "y"], dicts, True, expect)
            for ceiling in (100, 1):
                found = comp.assess(df, expect, ceiling)
                assert found.passed is want.passed, (rows, expect, ceiling)


def stages(spark, call):
    """What call gives, and for each stage that it ran: tasks, records written to shuffles, execution memory of all its tasks."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()

    def seen():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return {s.stageId(): (s.numTasks(), s.shuffleWriteRecords(), s.peakExecutionMemory()) for s in (found.apply(i) for i in range(found.size()))}

    before = seen()
    out = call()
    return out, [v for k, v in seen().items() if k not in before]


def test_no_task_gathers_a_larger_result(spark):
    """Rows that break an assertion are picked where they lie, and no table of all rows is kept by the task that reads them."""
    same = spark.range(0, 200_000, 1, 2).selectExpr("IF(id % 2 = 0, 'a', 'b') AS x")
    (found, rows), ran = stages(spark, lambda: comp.settle(same, Expect(equals=["a", "b"])))
    assert found == {"equals": False} and len(rows) == 100 and sum(s[1] for s in ran) < 1_000
    (found, rows), ran = stages(spark, lambda: comp.settle(same, Expect(unique=True)))
    assert found == {"unique": False} and len(rows) == 100 and sum(s[1] for s in ran) < 1_000
    apart = spark.range(0, 600_000, 1, 1)
    (found, rows), ran = stages(spark, lambda: comp.settle(apart, Expect(unique=True)))
    assert found == {"unique": True} and not rows and max(s[1] for s in ran) == 600_000 and all(s[2] < 1 << 20 for s in ran if s[1])
    (found, rows), _ = stages(spark, lambda: comp.settle(apart.union(spark.range(599_990, 600_010)), Expect(unique=True, equals=[1, 7, -1])))
    assert found == {"unique": False, "equals": False} and {599_990, 599_999} <= {r["id"] for r in rows} and len(rows) == 100


def test_heads_that_meet_by_chance_are_no_repeats(spark, monkeypatch):
    """64 bits that are equal for all rows: the whole digests decide."""
    monkeypatch.setattr(comp, "_head", lambda key: F.lit(7).cast("long"))
    df = spark.range(0, 50, 1, 2)
    assert comp.settle(df, Expect(unique=True))[0] == {"unique": True}
    found, rows = comp.settle(df.union(spark.range(3, 5)), Expect(unique=True))
    assert found == {"unique": False} and sorted(r["id"] for r in rows) == [3, 3, 4, 4]
