"""Queries over the sample tables, one or more for each operator, with their DuckDB equivalents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid import baseline, diff, history, profiler, report, scoring
from pellucid.errors import CheckError
from pellucid.functions import checksums, sampling
from pellucid.graph import NodeSet, PropertyGraph
from pellucid.operators import competency as comp
from pellucid.plans import conformance as c
from pellucid.plans import drift, fuse, pii
from pellucid.plans.degrees import SharedDegrees
from pellucid.plans.drift import drift_metric
from pellucid.sources import catalogue
from pellucid.sources.suites import Expect, Rows
from pellucid.sources.tables import load_graph

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _summary(plan) -> DataFrame:
    return plan.summary.select("population", "violation_count")


def _summary_query(name: str, plan, sql: str) -> None:
    """A query that returns a check's population and violations."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _summary(plan(load_graph(spark, sf_dir)))

    run.__name__ = name
    query(sql)(run)


def _node_sql(table: str, population: str, violation: str) -> str:
    return f"SELECT count(*) FILTER ({population}) AS population, count(*) FILTER (({population}) AND ({violation})) AS violation_count FROM {table}"


DOCS = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"
_summary_query("cardinality_out", lambda g: c.cardinality(g, "Customer", "PLACED", "Order", "out", 10), "SELECT count(*) AS population, count(*) FILTER (n <> 10) AS violation_count FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
_summary_query("cardinality_in", lambda g: c.cardinality(g, "Order", "PLACED", "Customer", "in", 1), "SELECT count(*) AS population, count(*) FILTER (n <> 1) AS violation_count FROM (SELECT o_orderkey, count(c_custkey) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY o_orderkey)")
_summary_query("cardinality_any", lambda g: c.cardinality(g, "Nation", "IN_NATION", "Supplier", "any", 4), "SELECT count(*) AS population, count(*) FILTER (n <> 4) AS violation_count FROM (SELECT n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey)")
_summary_query("no_orphans_typed", lambda g: c.no_orphans(g, "Order", "CONTAINS", "out"), "SELECT (SELECT count(*) FROM orders) AS population, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS violation_count")
_summary_query("no_orphans_any", lambda g: c.no_orphans(g, "Part"), "SELECT (SELECT count(*) FROM part) AS population, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS violation_count")
_summary_query("property_type_static", lambda g: c.property_type(g, "Customer", "c_acctbal", "integer"), "SELECT count(*) AS population, count(*) AS violation_count FROM customer WHERE c_acctbal IS NOT NULL")
_summary_query("property_type_float", lambda g: c.property_type(g, "Customer", "c_acctbal", "float"), _node_sql("customer", "c_acctbal IS NOT NULL", "isnan(c_acctbal)"))
_summary_query("property_type_datetime", lambda g: c.property_type(g, "Order", "o_orderdate", "datetime"), _node_sql("orders", "o_orderdate IS NOT NULL", "false"))
_summary_query("property_format", lambda g: c.property_format(g, "Page", "url", "https://.*"), _node_sql("pages", "url IS NOT NULL", "NOT regexp_full_match(url, 'https://[^\\n]*')"))
_summary_query("property_format_names", lambda g: c.property_format(g, "Customer", "c_name", "Customer#[0-9]{9}"), _node_sql("customer", "c_name IS NOT NULL", "NOT regexp_full_match(c_name, 'Customer#[0-9]{9}')"))
_summary_query("value_in_set", lambda g: c.value_in_set(g, "Order", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]), _node_sql("orders", "o_orderpriority IS NOT NULL", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')"))
_summary_query("value_in_set_mixed", lambda g: c.value_in_set(g, "Part", "p_size", [1, 5, "7", True, 20]), _node_sql("part", "p_size IS NOT NULL", "p_size NOT IN (1, 5, 20)"))
_summary_query("uniqueness", lambda g: c.uniqueness(g, "Document", "text"), "SELECT coalesce(sum(n), 0)::BIGINT AS population, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS violation_count FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text)")
_summary_query("uniqueness_part_name", lambda g: c.uniqueness(g, "Part", "p_name"), "SELECT coalesce(sum(n), 0)::BIGINT AS population, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS violation_count FROM (SELECT count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name)")
_summary_query("label_cooccurrence", lambda g: c.label_cooccurrence(g, "Quality", "Toxic"), _node_sql(DOCS, "quality = 1 OR toxic = 1", "quality = 1 AND toxic = 1"))
_summary_query("temporal_sanity", lambda g: c.temporal_sanity(g, "LineItem", "o_orderdate", "l_shipdate"), _node_sql("lineitem JOIN orders ON l_orderkey = o_orderkey", "o_orderdate IS NOT NULL AND l_shipdate IS NOT NULL", "l_shipdate < o_orderdate"))
_summary_query("rel_direction", lambda g: c.rel_direction(g, "Nation", "Customer", "IN_NATION"), "SELECT count(*) AS population, count(*) AS violation_count FROM customer JOIN nation ON c_nationkey = n_nationkey")


def _contacts(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers with made-up personal data: a value of each format for some of them, and columns with telling names."""
    key = F.col("c_custkey")
    digits = lambda n, k: F.lpad((key * k % 10**n).cast("string"), n, "3")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("Contact:"), key.cast("string")).alias("id"), "c_name",
        F.when(key % 3 == 0, F.concat(F.lit("c"), key.cast("string"), F.lit("@mail.example"))).otherwise("no mail").alias("Email"),
        F.when(key % 5 != 0, F.concat(F.lit("+4"), digits(9, 7919))).alias("phone_number"),
        F.when(key % 2 == 0, F.concat(F.lit("S"), digits(7, 104729), F.lit("Q"))).otherwise("S12Q").alias("nric"),
        digits(12, 2363).alias("note_a"), F.regexp_replace(digits(16, 4111111), r"(.{4})(?=.)", "$1-").alias("note_b"),
    )
    return PropertyGraph(spark, [NodeSet(("Contact",), rows)], [])


_DIGITS = "lpad((c_custkey * {k} % {m})::VARCHAR, {n}, '3')"
CONTACTS = f"""(SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey || '@mail.example' ELSE 'no mail' END AS email, CASE WHEN c_custkey % 5 <> 0 THEN '+4' || {_DIGITS.format(k=7919, m=10**9, n=9)} END AS phone,
CASE WHEN c_custkey % 2 = 0 THEN 'S' || {_DIGITS.format(k=104729, m=10**7, n=7)} || 'Q' ELSE 'S12Q' END AS nric, {_DIGITS.format(k=2363, m=10**12, n=12)} AS a, {_DIGITS.format(k=4111111, m=10**16, n=16)} AS b FROM customer)"""


@query(f"SELECT count(c_name) + count(email) + count(phone) + count(nric) + count(a) + count(b) AS population, count(email) + count(phone) + count(nric) AS violation_count FROM {CONTACTS}")
def pii_name_match(spark, sf_dir):
    return _summary(pii.pii_name_match(_contacts(spark, sf_dir), "Contact", pii.ALL))


@query(f"SELECT 'email' AS pattern, 'Email' AS property, count(email) AS observed FROM {CONTACTS} UNION ALL SELECT 'phone', 'phone_number', count(phone) FROM {CONTACTS} UNION ALL SELECT 'nric', 'nric', count(nric) FROM {CONTACTS}")
def pii_name_findings(spark, sf_dir):
    return pii.pii_name_match(_contacts(spark, sf_dir), "Contact", pii.ALL).findings.select("pattern", "property", "observed")


LUHN = "list_sum([CASE WHEN i % 2 = 1 THEN d ELSE CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END END FOR d, i IN [s[len(s) - j]::INT FOR j IN range(len(s))]]) % 10 = 0"
# Fixed values of the Verhoeff scheme, written out: the product table of the dihedral group, and the eight digit permutations.
_VERHOEFF_D = """0123456789 1234067895 2340178956 3401289567 4012395678 5987604321 6598710432 7659821043 8765932104 9876543210"""
_VERHOEFF_P = """0123456789 1576283094 5803796142 8916043527 9453126870 4286573901 2793806415 7046913258"""


def _verhoeff_ok(s: str) -> str:
    """SQL that looks digit after digit up in the written-out tables."""
    d, p = (x.replace(" ", "") for x in (_VERHOEFF_D, _VERHOEFF_P))
    digits = f"[0] || [{s}[len({s}) - i]::INT + 10 * (i % 8) FOR i IN range(len({s}))]"
    return f"list_reduce({digits}, lambda a, x: '{d}'[a * 10 + '{p}'[x + 1]::INT + 1]::INT) = 0"


_VALUE_HITS = f"""SELECT 'email' AS pattern, 'Email' AS property, count(*) FILTER (regexp_full_match(email, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')) AS observed FROM {CONTACTS}
UNION ALL SELECT 'e164_phone', 'phone_number', count(*) FILTER (regexp_full_match(phone, '\\+[1-9][0-9]{{1,14}}')) FROM {CONTACTS}
UNION ALL SELECT 'nric', 'nric', count(*) FILTER (regexp_full_match(nric, '[STFGM][0-9]{{7}}[A-Z]')) FROM {CONTACTS}
UNION ALL SELECT 'aadhaar', 'note_a', count(*) FILTER ({_verhoeff_ok('a')}) FROM {CONTACTS}
UNION ALL SELECT 'credit_card', 'note_b', count(*) FILTER ({LUHN.replace('len(s)', 'len(b)').replace('s[', 'b[')}) FROM {CONTACTS}"""


@query(_VALUE_HITS)
def pii_value_findings(spark, sf_dir):
    return pii.pii_value_match(_contacts(spark, sf_dir), "Contact", pii.ALL).findings.select("pattern", "property", "observed")


@query(f"SELECT (SELECT (count(c_name) + count(email) + count(phone) + count(nric) + count(a) + count(b))::BIGINT FROM {CONTACTS}) AS population, (SELECT sum(observed)::BIGINT FROM ({_VALUE_HITS})) AS violation_count")
def pii_value_match(spark, sf_dir):
    return _summary(pii.pii_value_match(_contacts(spark, sf_dir), "Contact", pii.ALL))


@query(_node_sql("documents", "text IS NOT NULL", "regexp_full_match(text, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')"))
def pii_value_match_texts(spark, sf_dir):
    return _summary(pii.pii_value_match(load_graph(spark, sf_dir), "Document", pii.ALL, ["email"], ["text"]))


@query(f"SELECT population, violation_count, population - violation_count AS conforming_count, CASE WHEN population = 0 THEN 1.0 ELSE (population - violation_count) / population END AS coverage FROM ({_node_sql(DOCS, 'true', 'quality IS NULL')})")
def completeness(spark, sf_dir):
    return c.completeness(load_graph(spark, sf_dir), "Document", "quality").summary


@query("SELECT 'node' AS kind, 'Document:' || doc_id AS id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL ORDER BY 2 LIMIT 100")
def completeness_evidence(spark, sf_dir):
    return c.completeness(load_graph(spark, sf_dir), "Document", "quality").capped(100).select("kind", "id")


@query("SELECT 'node' AS kind, 'Document:' || doc_id AS id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1) ORDER BY 2 LIMIT 100")
def uniqueness_evidence(spark, sf_dir):
    return c.uniqueness(load_graph(spark, sf_dir), "Document", "text").capped(100).select("kind", "id")


DEGREES = "(SELECT c_custkey, count(o_orderkey) AS degree FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)"


@query(f"WITH s AS (SELECT count(*) AS n, avg(degree) AS m, stddev_pop(degree) AS d FROM {DEGREES}) SELECT n AS population, n AS sample_size, (SELECT count(*) FROM {DEGREES}, s WHERE d > 0 AND degree > m + 2 * d) AS violation_count, round(m, 6) AS mean_degree, round(d, 6) AS degree_stddev FROM s")
def hub_outlier(spark, sf_dir):
    found = c.hub_outlier(load_graph(spark, sf_dir), "Customer", "PLACED", "out", 2.0).summary
    return found.withColumn("mean_degree", F.round("mean_degree", 6)).withColumn("degree_stddev", F.round("degree_stddev", 6))


@query(f"SELECT degree, count(*) AS nodes FROM {DEGREES} GROUP BY degree")
def hub_outlier_degrees(spark, sf_dir):
    return c.with_degrees(load_graph(spark, sf_dir), "Customer", "PLACED", "out").groupBy("degree").agg(F.count("*").alias("nodes"))


@query("SELECT 'rel' AS kind, 'IN_NATION>Customer:' || c_custkey || '>Nation:' || c_nationkey AS id FROM customer ORDER BY 2 LIMIT 100")
def rel_direction_evidence(spark, sf_dir):
    return c.rel_direction(load_graph(spark, sf_dir), "Nation", "Customer", "IN_NATION").capped(100).select("kind", "id")


@query("SELECT count(*) AS population, count(*) FILTER (o_orderkey IS NULL OR p_partkey IS NULL) AS violation_count FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey")
def dangling_rels_ext(spark, sf_dir):
    graph = load_graph(spark, sf_dir)
    graph.capabilities["store_consistency"] = True
    return _summary(c.dangling_rels(graph, "CONTAINS"))


@query("SELECT 'name' AS what, count(*) AS population, 0::BIGINT AS violation_count FROM customer UNION ALL SELECT 'balance', count(*), count(*) FILTER (c_acctbal IS NULL) FROM customer UNION ALL SELECT 'segment', count(*), count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer")
def fused_checks(spark, sf_dir):
    g = load_graph(spark, sf_dir)
    plans = {"name": c.property_format(g, "Customer", "c_name", "Customer#[0-9]+"), "balance": c.completeness(g, "Customer", "c_acctbal"), "segment": c.value_in_set(g, "Customer", "c_mktsegment", ["BUILDING", "MACHINERY"])}
    return fuse(plans).withColumnRenamed("check", "what")


@query(f"SELECT c_custkey, {LUHN} AS ok FROM (SELECT c_custkey, lpad((c_custkey * 7919 + 4111111)::VARCHAR, 16, '4') AS s FROM customer)")
def pii_luhn(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    spaced = F.regexp_replace(F.lpad((F.col("c_custkey") * 7919 + 4111111).cast("string"), 16, "4"), r"(\d{4})(?=\d)", "$1-")
    return rows.select("c_custkey", checksums.luhn_ok(spaced).alias("ok"))


@query(f"SELECT c_custkey, {_verhoeff_ok('s')} AS ok FROM (SELECT c_custkey, lpad((c_custkey * 104729 + 2363)::VARCHAR, 12, '3') AS s FROM customer)")
def pii_verhoeff(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select("c_custkey", checksums.verhoeff_ok(F.lpad((F.col("c_custkey") * 104729 + 2363).cast("string"), 12, "3")).alias("ok"))


@query("SELECT (SELECT count(*) FROM customer) AS current, (SELECT count(*) FROM customer) AS population")
def drift_node_count(spark, sf_dir):
    return drift_metric(load_graph(spark, sf_dir), "node_count", {"label": "Customer"}).summary


@query("SELECT count(*) AS current, count(*) AS population FROM orders")
def drift_relationship_count(spark, sf_dir):
    return drift_metric(load_graph(spark, sf_dir), "relationship_count", {"type": "PLACED"}).summary


@query(f"SELECT 100.0 * count(quality) / count(*) AS current, count(*) AS population FROM {DOCS}")
def drift_property_coverage(spark, sf_dir):
    return drift_metric(load_graph(spark, sf_dir), "property_coverage", {"label": "Document", "property": "quality"}).summary


_TOLERANCES = {"max_drop_pct": 0.5, "max_increase_pct": 0.5, "max_change_pct": 0.2, "max_delta": 99, "absolute": 100, "min": 5_000, "max": 5_000}
_BROKEN = {
    "max_drop_pct": "d < 0 AND 100.0 * abs(d) / b > 0.5", "max_increase_pct": "d > 0 AND 100.0 * abs(d) / b > 0.5", "max_change_pct": "100.0 * abs(d) / b > 0.2", "max_delta": "abs(d) > 99", "absolute": "abs(d) > 100",
    "min": "b + d < 5000", "max": "b + d > 5000",
}
_MOVES = "(SELECT o_orderstatus AS status, CASE o_orderstatus WHEN 'F' THEN -100 WHEN 'O' THEN 100 ELSE 0 END AS d, count(*) - CASE o_orderstatus WHEN 'F' THEN -100 WHEN 'O' THEN 100 ELSE 0 END AS b FROM orders GROUP BY 1)"


@query(" UNION ALL ".join(f"SELECT status, '{k}' AS tolerance, {v} AS broken FROM {_MOVES}" for k, v in _BROKEN.items()))
def drift_tolerances(spark, sf_dir):
    """Each tolerance on its own over counts that fell, rose and stayed; a row for each status and tolerance."""
    move = {"F": -100, "O": 100}
    counts = load_graph(spark, sf_dir).nodes("Order", ["o_orderstatus"]).groupBy("o_orderstatus").agg(F.count("*").alias("n")).collect()  # a row for each status
    found = [(r[0], k, bool(baseline.within({k: v}, r["n"], r["n"] - move.get(r[0], 0)))) for r in counts for k, v in _TOLERANCES.items()]
    return spark.createDataFrame(found, "status string, tolerance string, broken boolean")


def _judged(spark: SparkSession, cases: dict[str, tuple[DataFrame, Expect, int]]) -> DataFrame:
    """case_name, passed, code: what the assertions say of each result; passed is null where the ceiling came first."""
    out = []
    for name, (df, expect, ceiling) in cases.items():
        try:
            out.append((name, comp.assess(df, expect, ceiling).passed, None))
        except CheckError as e:
            out.append((name, None, e.code))
    return spark.createDataFrame(out, "case_name string, passed boolean, code string")


def _case_sql(table: str, cases: dict[str, str], over: str = "false") -> str:
    """A row for each condition; `over`: the condition under which it is undecided."""
    return " UNION ALL ".join(f"SELECT '{k}' AS case_name, CASE WHEN {over} THEN NULL ELSE {v} END AS passed, CASE WHEN {over} THEN 'engine.result_limit_exceeded' END AS code FROM {table}" for k, v in cases.items())


_BOUNDS = {"at most 30": Rows(max=30), "at most 24": Rows(max=24), "exactly 25": Rows(exactly=25), "at least 26": Rows(min=26), "at least 3 and at most 25": Rows(min=3, max=25)}


@query(_case_sql("nation JOIN region ON n_regionkey = r_regionkey", {"at most 30": "count(*) <= 30", "at most 24": "count(*) <= 24", "exactly 25": "count(*) = 25", "at least 26": "count(*) >= 26", "at least 3 and at most 25": "count(*) BETWEEN 3 AND 25"}))
def competency_rows(spark, sf_dir):
    rows = load_graph(spark, sf_dir).match("Nation", "IN_REGION", "Region")
    return _judged(spark, {k: (rows, Expect(rows=r), comp.ROW_CEILING) for k, r in _BOUNDS.items()})


@query(_case_sql("customer", {"at most 500": "count(*) <= 500", "exactly 500": "count(*) = 500", "at least 500": "count(*) >= 500"}, "count(*) > 10") + " UNION ALL " + _case_sql("customer", {"at least 7": "count(*) >= 7", "at most 7": "count(*) <= 7"}))
def competency_row_ceiling(spark, sf_dir):
    """Bounds beyond a ceiling of 10 rows stay open; those within are decided by the rows that were read."""
    rows = load_graph(spark, sf_dir).nodes("Customer")
    bounds = {"at most 500": Rows(max=500), "exactly 500": Rows(exactly=500), "at least 500": Rows(min=500), "at least 7": Rows(min=7), "at most 7": Rows(max=7)}
    return _judged(spark, {k: (rows, Expect(rows=r), 10) for k, r in bounds.items()})


@query(_case_sql("customer", {"segments are unique": "count(*) = count(DISTINCT c_mktsegment)", "segments repeat": "count(*) > count(DISTINCT c_mktsegment)", "keys are unique": "count(*) = count(DISTINCT c_custkey)"}))
def competency_unique(spark, sf_dir):
    rows = load_graph(spark, sf_dir).nodes("Customer", ["c_mktsegment", "c_custkey"])
    segments, keys = rows.select("c_mktsegment"), rows.select("c_custkey")
    return _judged(spark, {"segments are unique": (segments, Expect(unique=True), comp.ROW_CEILING), "segments repeat": (segments, Expect(unique=False), comp.ROW_CEILING), "keys are unique": (keys, Expect(unique=True), comp.ROW_CEILING)})


@query(_case_sql("region", {"two": "count(DISTINCT r_name) FILTER (r_name IN ('ASIA', 'EUROPE')) = 2", "one too many": "count(DISTINCT r_name) FILTER (r_name IN ('ASIA', 'ATLANTIS')) = 2", "pairs": "count(*) FILTER (r_name = 'ASIA' AND r_regionkey = 2) > 0"}))
def competency_contains(spark, sf_dir):
    rows = load_graph(spark, sf_dir).nodes("Region", ["r_name", "r_regionkey"])
    names, pairs = rows.select("r_name"), rows.select("r_name", "r_regionkey")
    asked = {"two": (names, ["ASIA", "EUROPE"]), "one too many": (names, ["ASIA", "ATLANTIS"]), "pairs": (pairs, [{"r_name": "ASIA", "r_regionkey": 2}])}
    return _judged(spark, {k: (df, Expect(contains=v), comp.ROW_CEILING) for k, (df, v) in asked.items()})


@query(_case_sql("region", {"regions": "list_sort(list(r_regionkey)) = [0, 1, 2, 3, 4]", "fewer": "list_sort(list(r_regionkey)) = [0, 1, 2, 3]"}) + " UNION ALL " + _case_sql("nation", {"nations": "list_sort(list(n_regionkey)) = [0, 1, 2, 3, 4]"}))
def competency_equals_bag(spark, sf_dir):
    graph = load_graph(spark, sf_dir)
    regions, nations = graph.nodes("Region", ["r_regionkey"]).select("r_regionkey"), graph.nodes("Nation", ["n_regionkey"]).select("n_regionkey")
    asked = {"regions": (regions, [4, 2, 0, 1, 3]), "fewer": (regions, [0, 1, 2, 3]), "nations": (nations, [0, 1, 2, 3, 4])}
    return _judged(spark, {k: (df, Expect(equals=v), comp.ROW_CEILING) for k, (df, v) in asked.items()})


@query(_case_sql("nation", {"is empty": "count(*) = 0", "is not empty": "count(*) > 0", "none is nameless": "count(*) FILTER (n_name IS NULL) = 0"}) + " UNION ALL SELECT 'columns', true, NULL UNION ALL SELECT 'columns in another order', false, NULL")
def competency_empty_and_columns(spark, sf_dir):
    rows = load_graph(spark, sf_dir).nodes("Nation", ["n_name", "n_nationkey"])
    asked = {
        "is empty": (rows, Expect(empty=True)), "is not empty": (rows, Expect(empty=False)), "none is nameless": (rows.where("n_name IS NULL"), Expect(empty=True)),
        "columns": (rows, Expect(columns=["id", "n_name", "n_nationkey"])), "columns in another order": (rows, Expect(columns=["n_name", "id", "n_nationkey"])),
    }
    return _judged(spark, {k: (df, e, comp.ROW_CEILING) for k, (df, e) in asked.items()})


@query(" UNION ALL ".join([
    _case_sql("lineitem", {"lines are unique": "count(*) = count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey))", "orders are unique": "count(*) = count(DISTINCT l_orderkey)", "flags are there": "count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A', 'N', 'R')) = 3", "a flag too many": "count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A', 'X')) = 2", "flags alone": "list_sort(list(l_returnflag)) = ['A', 'N', 'R']"}),
    _case_sql("orders", {"numbers as floats": "count(*) FILTER (o_orderkey = 1) > 0 AND count(*) FILTER (o_orderkey = 2) > 0"}),
    _case_sql("(SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem)", {"pairs": "list_sort(list(f || s)) = ['AF', 'NF', 'NO', 'RF']"}),
]))
def competency_at_any_size(spark, sf_dir):
    """Results far beyond a ceiling of 1,000 rows: unique, contains and equals are settled where the rows lie."""
    graph = load_graph(spark, sf_dir)
    lines = graph.rels("CONTAINS", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"])
    flags, orders = lines.select("l_returnflag"), graph.nodes("Order", ["o_orderkey"]).select("o_orderkey")
    asked = {
        "lines are unique": (lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), Expect(unique=True)), "orders are unique": (lines.select("l_orderkey"), Expect(unique=True)), "flags are there": (flags, Expect(contains=["A", "N", "R"])),
        "a flag too many": (flags, Expect(contains=["A", "X"])), "flags alone": (flags, Expect(equals=["A", "N", "R"])), "numbers as floats": (orders, Expect(contains=[1.0, 2.0])),
        "pairs": (lines.selectExpr("l_returnflag AS f", "l_linestatus AS s").distinct(), Expect(equals=[{"s": s, "f": f} for f, s in ("RF", "NO", "NF", "AF")])),
    }
    return _judged(spark, {k: (df, e, 1_000) for k, (df, e) in asked.items()})


@query("SELECT c.c_custkey, count(*) AS n_orders FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY 1")
def competency_sql(spark, sf_dir):
    from pellucid.sqlguard import require_read_only

    graph = load_graph(spark, sf_dir)
    text = "SELECT c.c_custkey, count(*) AS n_orders FROM node_Customer c JOIN rel_PLACED r ON r.src = c.id WHERE c.c_mktsegment = :segment GROUP BY 1"
    graph.register_views(text)
    require_read_only(spark, text)
    return spark.sql(text, args=comp.bind(graph, text, {"segment": "BUILDING"}))


@query("SELECT min('Customer:' || c_custkey) AS id FROM customer")
def first_active_token(spark, sf_dir):
    return comp.first_active(load_graph(spark, sf_dir))


# What SHA-256 gives for the seeds 42 and 43, written out so that a wrong derivation shows.
_A = (2009566731, 811739796, 1225495611, 1953762775)
_HASH = f"((((({_A[0]} * k + {_A[1]}) % {sampling.MODULUS}) * k + {_A[2]}) % {sampling.MODULUS}) * k + {_A[3]}) % {sampling.MODULUS}"


@query(f"SELECT 'Customer:' || c_custkey AS id FROM (SELECT c_custkey, (c_custkey % {sampling.MODULUS})::BIGINT AS k FROM customer) ORDER BY {_HASH}, 1 LIMIT 20")
def sample_bottom_k(spark, sf_dir):
    return sampling.bottom_k(load_graph(spark, sf_dir).nodes("Customer", ["c_custkey"]), F.col("c_custkey"), 20, 42).select("id")


_G = (2073329003, 1617587024, 1167863393, 1032208260)
_GATE = f"((((({_G[0]} * k + {_G[1]}) % {sampling.MODULUS}) * k + {_G[2]}) % {sampling.MODULUS}) * k + {_G[3]}) % {sampling.MODULUS}"


@query(f"SELECT 'Customer:' || c_custkey AS id FROM (SELECT c_custkey, (c_custkey % {sampling.MODULUS})::BIGINT AS k FROM customer) WHERE {_GATE} < least({sampling.MODULUS}, ceil({sampling.MODULUS}::DOUBLE * 3 * 32 / (SELECT count(*) FROM customer))) ORDER BY {_HASH}, 1 LIMIT 3")
def sample_gated(spark, sf_dir):
    rows = load_graph(spark, sf_dir).nodes("Customer", ["c_custkey"])
    return sampling.bottom_k(rows, F.col("c_custkey"), 3, 42, population=rows.count()).select("id")


_Z = sampling.Z95
_WILSON = f"((p + {_Z * _Z} / (2 * n)) {{}} {_Z} * sqrt((p * (1 - p) + {_Z * _Z} / (4 * n)) / n)) / (1 + {_Z * _Z} / n)"


@query(f"SELECT c_mktsegment, n AS sample_size, 10 * n AS population, round({_WILSON.format('-')}, 9) AS low, round({_WILSON.format('+')}, 9) AS high FROM (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal > 0) / count(*) AS p FROM customer GROUP BY 1)")
def wilson_interval(spark, sf_dir):
    """The interval of each segment's share, as if it were a tenth of its population."""
    counts = load_graph(spark, sf_dir).nodes("Customer", ["c_mktsegment", "c_acctbal"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("hits")).collect()  # a row for each segment
    found = [(r["c_mktsegment"], sampling.wilson(r["hits"], r["n"], 10 * r["n"])) for r in counts]
    return spark.createDataFrame([(name, w["sample_size"], w["population"], round(w["ci"][0], 9), round(w["ci"][1], 9)) for name, w in found], "c_mktsegment string, sample_size long, population long, low double, high double")


@query(f"SELECT 'Order:' || o_orderkey AS id FROM (SELECT o_orderkey, (o_orderkey % {sampling.MODULUS})::BIGINT AS k FROM orders) ORDER BY {_HASH}, 1 LIMIT 500")
def hub_sample(spark, sf_dir):
    """The nodes that a sampled hub check looks at: those of the smallest ranks."""
    return sampling.bottom_k(load_graph(spark, sf_dir).nodes("Order", ["o_orderkey"]), F.col("o_orderkey"), 500, 42).select("id")


_SAMPLED = f"(SELECT c_custkey, count(o_orderkey) AS degree FROM (SELECT c_custkey FROM (SELECT c_custkey, (c_custkey % {sampling.MODULUS})::BIGINT AS k FROM customer) WHERE {_GATE} < least({sampling.MODULUS}, ceil({sampling.MODULUS}::DOUBLE * 100 * 32 / (SELECT count(*) FROM customer))) ORDER BY {_HASH}, 'Customer:' || c_custkey LIMIT 100) LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)"


@query(f"WITH s AS (SELECT avg(degree) AS m, stddev_pop(degree) AS d FROM {_SAMPLED}) SELECT (SELECT count(*) FROM customer) AS population, 100::BIGINT AS sample_size, (SELECT count(*) FROM {_SAMPLED}, s WHERE d > 0 AND degree > m + 1.5 * d) AS violation_count, round(m, 6) AS mean_degree, round(d, 6) AS degree_stddev FROM s")
def hub_outlier_sampled(spark, sf_dir):
    found = c.hub_outlier(load_graph(spark, sf_dir), "Customer", "PLACED", "out", 1.5, sample_size=100, exhaustive_limit=99, seed=42, key=F.col("c_custkey")).summary
    return found.withColumn("mean_degree", F.round("mean_degree", 6)).withColumn("degree_stddev", F.round("degree_stddev", 6))


_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
    "pages": "page_id url html", "conversations": "conv_id turn role text",
}
#: What holds the nodes of each label and the relationships of each type, and their properties, in SQL.
_NODES = {
    "Region": ("region", _COLUMNS["region"]), "Nation": ("nation", _COLUMNS["nation"]), "Customer": ("customer", _COLUMNS["customer"]), "Supplier": ("supplier", _COLUMNS["supplier"]), "Part": ("part", _COLUMNS["part"]),
    "Order": ("orders", _COLUMNS["orders"]), "LineItem": ("(SELECT lineitem.*, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", _COLUMNS["lineitem"] + " o_orderdate"),
    "User": ("(SELECT DISTINCT user_id FROM events)", "user_id"), "Event": ("events", _COLUMNS["events"]), "Page": ("pages", _COLUMNS["pages"]), "Conversation": ("(SELECT DISTINCT conv_id FROM conversations)", "conv_id"),
    "Message": ("conversations", _COLUMNS["conversations"]), **{label: (f"(SELECT * FROM {DOCS} WHERE {test})", "doc_id text lang source n_chars quality toxic") for label, test in (("Document", "true"), ("Quality", "quality = 1"), ("Toxic", "toxic = 1"))},
}
_RELS = {
    "IN_REGION": ("nation", "n_nationkey n_regionkey"), "PLACED": ("orders", "o_orderkey o_custkey"), "CONTAINS": ("lineitem", _COLUMNS["lineitem"]), "PERFORMED": ("events", "event_id user_id"),
    "IN_NATION": ("(SELECT c_custkey, c_nationkey, NULL AS s_suppkey, NULL AS s_nationkey FROM customer UNION ALL SELECT NULL, NULL, s_suppkey, s_nationkey FROM supplier)", "c_custkey c_nationkey s_suppkey s_nationkey"),
}


def _coverage_sql(held: dict) -> str:
    parts = [f"SELECT '{name}' AS owner_name, '{p}' AS property, count(*) AS total, count({p}) AS populated FROM {table}" for name, (table, props) in held.items() for p in props.split()]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE populated > 0"


@query(" UNION ALL ".join(f"SELECT '{name}' AS label, count(*) AS n FROM {table}" for name, (table, _) in _NODES.items()))
def profile_labels(spark, sf_dir):
    return profiler.tally(load_graph(spark, sf_dir)).where("property IS NULL").select(F.col("owner_name").alias("label"), F.col("total").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{name}' AS type, count(*) AS n FROM {table}" for name, (table, _) in _RELS.items()) + " UNION ALL SELECT 'NEXT', count(*) FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def profile_types(spark, sf_dir):
    return profiler.tally(load_graph(spark, sf_dir), "relationship").where("property IS NULL").select(F.col("owner_name").alias("type"), F.col("total").alias("n"))


_DEGREE_SQL = """
WITH e AS (
  SELECT 'Region:' || n_regionkey AS id FROM nation UNION ALL SELECT 'Nation:' || n_nationkey FROM nation
  UNION ALL SELECT 'Customer:' || c_custkey FROM customer UNION ALL SELECT 'Nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'Supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'Nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'Customer:' || o_custkey FROM orders UNION ALL SELECT 'Order:' || o_orderkey FROM orders
  UNION ALL SELECT 'Order:' || l_orderkey FROM lineitem UNION ALL SELECT 'Part:' || l_partkey FROM lineitem
  UNION ALL SELECT 'User:' || user_id FROM events UNION ALL SELECT 'Event:' || event_id FROM events
  UNION ALL SELECT 'Message:' || a.conv_id || '/' || a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  UNION ALL SELECT 'Message:' || b.conv_id || '/' || b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
), d AS (SELECT id, count(*) AS degree FROM e GROUP BY id),
n AS (SELECT 'Customer' AS label, 'Customer:' || c_custkey AS id FROM customer UNION ALL SELECT 'User', 'User:' || user_id FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT 'Nation', 'Nation:' || n_nationkey FROM nation
  UNION ALL SELECT 'Part', 'Part:' || p_partkey FROM part UNION ALL SELECT 'Region', 'Region:' || r_regionkey FROM region UNION ALL SELECT 'Supplier', 'Supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'Order', 'Order:' || o_orderkey FROM orders
  UNION ALL SELECT 'Event', 'Event:' || event_id FROM events UNION ALL SELECT 'Message', 'Message:' || conv_id || '/' || turn FROM conversations UNION ALL SELECT 'Page', 'Page:' || page_id FROM pages
  UNION ALL SELECT 'Conversation', 'Conversation:' || conv_id FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 'Document', 'Document:' || doc_id FROM documents
  UNION ALL SELECT 'Quality', 'Document:' || doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 UNION ALL SELECT 'Toxic', 'Document:' || doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1
  UNION ALL SELECT 'LineItem', 'LineItem:' || l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT label, quantile_cont(coalesce(degree, 0)::DOUBLE, 0.5) AS median, round(quantile_cont(coalesce(degree, 0)::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(coalesce(degree, 0)::DOUBLE, 0.99), 6) AS p99, max(coalesce(degree, 0)) AS maximum FROM n LEFT JOIN d USING (id) GROUP BY label
"""


@query(_DEGREE_SQL)
def profile_degrees(spark, sf_dir):
    found = profiler.degree_frame(load_graph(spark, sf_dir))
    return found.select("label", "median", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"), "maximum")


@query(_coverage_sql(_NODES))
def profile_coverage_nodes(spark, sf_dir):
    return profiler.coverage_frame(load_graph(spark, sf_dir))


@query(_coverage_sql(_RELS))
def profile_coverage_rels(spark, sf_dir):
    return profiler.coverage_frame(load_graph(spark, sf_dir), "relationship")


_TYPE_NAMES = "CASE typeof({c}) WHEN 'BIGINT' THEN 'INTEGER' WHEN 'INTEGER' THEN 'INTEGER' WHEN 'DOUBLE' THEN 'FLOAT' WHEN 'VARCHAR' THEN 'STRING' ELSE 'DateTime' END"
_MIXED = "(SELECT CASE p_size % 4 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'FLOAT' WHEN 2 THEN 'STRING' END AS type, CASE p_size % 4 WHEN 0 THEN p_size % 3 WHEN 1 THEN p_size % 3 END AS number, CASE p_size % 4 WHEN 2 THEN p_brand END AS word FROM part)"


def _mixed(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Parts with a property of mixed types: whole numbers, the same as floats, brands, or nothing."""
    size = F.col("p_size")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.concat(F.lit("Thing:"), F.col("p_partkey").cast("string")).alias("id"), "p_name",
        F.when(size % 4 == 0, (size % 3).cast("long").cast("variant")).when(size % 4 == 1, (size % 3).cast("double").cast("variant")).when(size % 4 == 2, F.col("p_brand").cast("variant")).alias("mixed"),
    )
    return PropertyGraph(spark, [NodeSet(("Thing",), rows)], [])


@query(" UNION ALL ".join(
    [f"SELECT '{label}' AS label, '{c}' AS property, max({_TYPE_NAMES.format(c=c)}) AS type FROM {table} WHERE {c} IS NOT NULL" for label, (table, names) in {"Customer": ("customer", _COLUMNS["customer"]), "Order": ("orders", _COLUMNS["orders"])}.items() for c in names.split()]
    + ["SELECT 'Thing', 'p_name', max('STRING') FROM part WHERE p_name IS NOT NULL", f"SELECT 'Thing', 'mixed', string_agg(DISTINCT type, ' | ' ORDER BY type) FROM {_MIXED}"]
))
def profile_property_types(spark, sf_dir):
    """Types that the values have, of plain columns and of one whose values have several."""
    graph = load_graph(spark, sf_dir)
    frames = [profiler.observed_types(graph, "Customer"), profiler.observed_types(graph, "Order"), profiler.observed_types(_mixed(spark, sf_dir), "Thing")]
    found = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return found.select("label", "property", F.array_join("types", " | ").alias("type"))


@query(f"SELECT count(type) AS population, count(*) FILTER (type IS NOT NULL AND coalesce(number NOT IN (1), word NOT IN ('Brand#11', 'Brand#23'))) AS violation_count FROM {_MIXED}")
def value_in_set_variant(spark, sf_dir):
    """1 and 1.0 are one value, '1' is another."""
    return _summary(c.value_in_set(_mixed(spark, sf_dir), "Thing", "mixed", [1, "1", "Brand#11", "Brand#23", True]))


@query(f"SELECT coalesce(sum(n), 0)::BIGINT AS population, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS violation_count FROM (SELECT count(*) AS n FROM {_MIXED} WHERE type IS NOT NULL GROUP BY number, word)")
def uniqueness_variant(spark, sf_dir):
    return _summary(c.uniqueness(_mixed(spark, sf_dir), "Thing", "mixed"))


_KEYS = {"customer": "c_custkey", "nation": "n_nationkey", "order": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "message": "conv_id, turn", "document": "doc_id", "event": "event_id"}


@query(" UNION ALL ".join(f"SELECT '{name}_key' AS name, sum(n)::BIGINT AS elements, coalesce(sum(n) FILTER (n > 1 OR lost), 0)::BIGINT AS broken FROM (SELECT {keys}, count(*) AS n, {' OR '.join(f'{k} IS NULL' for k in keys.split(', '))} AS lost FROM {({'order': 'orders', 'message': 'conversations', 'document': 'documents', 'event': 'events'}).get(name, name)} GROUP BY {keys})" for name, keys in _KEYS.items()))
def constraints_kept(spark, sf_dir):
    """The keys that the tables declare, and how many nodes break them."""
    graph = load_graph(spark, sf_dir)
    return catalogue.kept(graph, [x for x in catalogue.declared(graph) if x["name"].removesuffix("_key") in _KEYS])


@query("WITH a AS (SELECT s_name AS name, 'nation ' || s_nationkey AS type FROM supplier WHERE s_suppkey % 10 <> 3), b AS (SELECT s_name AS name, 'nation ' || (s_nationkey + CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END) AS type FROM supplier WHERE s_suppkey % 10 <> 7) SELECT *, 'removed' AS change FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'added' FROM (FROM b EXCEPT FROM a)")
def diff_definitions(spark, sf_dir):
    """Suppliers as definitions, of which some were dropped, some came and some changed their type."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    kind = lambda nation: F.concat(F.lit("nation "), nation.cast("string")).alias("type")
    nation = F.col("s_nationkey")
    before = rows.where("s_suppkey % 10 <> 3").select(F.col("s_name").alias("name"), kind(nation))
    return diff.definition_diff(before, rows.where("s_suppkey % 10 <> 7").select(F.col("s_name").alias("name"), kind(nation + F.when(F.col("s_acctbal") < 0, 1).otherwise(0))))


#: Metrics of a run and their values in an earlier profile.
_DRIFTS = {
    "customers": ("node_count", {"label": "Customer"}, 1_400), "orders": ("node_count", {"label": "Order"}, 15_500), "toxic": ("node_count", {"label": "Toxic"}, 50), "placed": ("relationship_count", {"type": "PLACED"}, 15_000),
    "lines": ("relationship_count", {"type": "CONTAINS"}, 60_000), "balances": ("property_coverage", {"label": "Customer", "property": "c_acctbal"}, 99.5), "segments": ("property_coverage", {"label": "Customer", "property": "c_mktsegment"}, 100.0), "judged": ("property_coverage", {"label": "Document", "property": "quality"}, 40.0),
    "discounts": ("property_coverage", {"type": "CONTAINS", "property": "l_discount"}, 0.0),
}
_CURRENT = {
    "customers": "(SELECT count(*) FROM customer)", "orders": "(SELECT count(*) FROM orders)", "toxic": f"(SELECT count(*) FROM {DOCS} WHERE toxic = 1)", "placed": "(SELECT count(*) FROM orders)", "lines": "(SELECT count(*) FROM lineitem)", "balances": "(SELECT 100.0 * count(c_acctbal) / count(*) FROM customer)",
    "segments": "(SELECT 100.0 * count(c_mktsegment) / count(*) FROM customer)", "judged": f"(SELECT 100.0 * count(quality) / count(*) FROM {DOCS})", "discounts": "(SELECT 100.0 * count(l_discount) / count(*) FROM lineitem)",
}


@query("SELECT target, current, baseline, current - baseline AS delta, CASE WHEN baseline <> 0 THEN round(100.0 * (current - baseline) / baseline, 6) END AS change_pct FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS target, {sql}::DOUBLE AS current, {_DRIFTS[k][2]}::DOUBLE AS baseline" for k, sql in _CURRENT.items()) + ")")
def drift_of_a_run(spark, sf_dir):
    """Nine metrics over a written baseline: one aggregation for each table, joined to the baseline by target."""
    written: dict = {}
    for metric, target, value in _DRIFTS.values():
        written.setdefault(metric, {})[baseline.target_key(target)] = value
    known = json.loads(json.dumps(written))
    asks = {k: (metric, target) for k, (metric, target, _) in _DRIFTS.items()}
    found = drift.against(drift.measure(load_graph(spark, sf_dir), asks), [baseline.require(known, *ask) for ask in asks.values()])
    return found.select(F.element_at(F.array(*map(F.lit, asks)), F.col("number") + 1).alias("target"), "current", "baseline", "delta", F.round("change_pct", 6).alias("change_pct"))


@query(f"SELECT 'cardinality' AS what, count(*) AS population, count(*) FILTER (degree <> 10) AS violation_count FROM {DEGREES} UNION ALL SELECT 'orphans', count(*), count(*) FILTER (degree = 0) FROM {DEGREES} UNION ALL SELECT 'hubs', count(*), count(*) FILTER (degree > (SELECT avg(degree) + 2 * stddev_pop(degree) FROM {DEGREES})) FROM {DEGREES}")
def degrees_shared(spark, sf_dir):
    """Three checks over one relationship type, read off one histogram of degrees."""
    graph = load_graph(spark, sf_dir)
    plans = {"cardinality": c.cardinality(graph, "Customer", "PLACED", "Order", "out", 10), "orphans": c.no_orphans(graph, "Customer", "PLACED", "out"), "hubs": c.hub_outlier(graph, "Customer", "PLACED", "out", 2.0)}
    found = SharedDegrees(graph, {k: p.degrees for k, p in plans.items()}).frame()
    return found.select(F.element_at(F.array(*map(F.lit, plans)), F.col("number") + 1).alias("what"), "population", "violation_count")


@query(f"SELECT 'Customer' AS label, (SELECT count(*) FROM customer) AS population, 'sampled' AS decision UNION ALL SELECT 'Order', (SELECT count(*) FROM orders), CASE WHEN (SELECT count(*) FROM orders) <= 1000 THEN 'exact' ELSE 'sampled' END UNION ALL SELECT 'Nation', (SELECT count(*) FROM nation), 'exact' UNION ALL SELECT 'Toxic', (SELECT count(*) FROM {DOCS} WHERE toxic = 1), CASE WHEN (SELECT count(*) FROM {DOCS} WHERE toxic = 1) <= 1000 THEN 'exact' ELSE 'sampled' END")
def preflight_population(spark, sf_dir):
    """Populations before a plan is chosen: of stored tables from their footers, of other labels by a count."""
    graph = load_graph(spark, sf_dir)
    found = [(x, graph.population(x), sampling.decide(graph.population(x), 100, 100 if x == "Customer" else 1_000)) for x in ("Customer", "Order", "Nation", "Toxic")]
    return spark.createDataFrame(found, "label string, population long, decision string")


_BEFORE = "SELECT c_mktsegment AS name, count(*) AS count FROM customer WHERE c_acctbal > 0 GROUP BY 1"


@query(f"WITH a AS ({_BEFORE}), b AS (SELECT c_mktsegment AS name, count(*) AS count FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) SELECT name, a.count AS n_from, b.count AS n_to, b.count - a.count AS delta, 100.0 * (b.count - a.count) / a.count AS pct, CASE WHEN a.count IS NULL THEN 'added' WHEN b.count IS NULL THEN 'removed' WHEN a.count = b.count THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b USING (name)")
def diff_counts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed("c_mktsegment", "name")
    counted = lambda x: x.groupBy("name").agg(F.count("*").alias("count"))
    return diff.count_diff(counted(rows.where("c_acctbal > 0")), counted(rows.where("name <> 'BUILDING'")))


@query(f"SELECT owner_name, property, a.coverage AS c_from, b.coverage AS c_to, b.coverage - a.coverage AS delta_pp FROM (SELECT lang AS owner_name, 'quality' AS property, 100.0 * count(quality) / count(*) AS coverage FROM {DOCS} GROUP BY 1) a FULL JOIN (SELECT lang AS owner_name, 'quality' AS property, 100.0 * count(quality) FILTER (quality = 1) / count(*) AS coverage FROM {DOCS} GROUP BY 1) b USING (owner_name, property)")
def diff_coverage(spark, sf_dir):
    rows = load_graph(spark, sf_dir).nodes("Document", ["lang", "quality"])
    cover = lambda col: rows.groupBy(F.col("lang").alias("owner_name")).agg((100.0 * F.count(col) / F.count("*")).alias("coverage")).withColumn("property", F.lit("quality"))
    return diff.coverage_diff(cover(F.col("quality")), cover(F.when(F.col("quality") == 1, 1)))


def _results(spark, sf_dir, *more: str) -> DataFrame:
    """Orders as check results: a history of one run for each market segment's customers. more: further columns of orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    verdict = F.element_at(F.array(*map(F.lit, ("pass", "pass", "fail", "warn", "errored", "skipped"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return orders.select(
        (F.col("o_custkey") % 50).cast("string").alias("run_id"), F.concat(F.lit("s"), (F.col("o_custkey") % 3).cast("string")).alias("suite_id"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("id"),
        F.when(F.col("o_orderkey") % 2 == 0, "error").otherwise("warn").alias("severity"), verdict.alias("verdict"), *more,
    )


RESULTS = "(SELECT (o_custkey % 50)::VARCHAR AS run_id, 's' || (o_custkey % 3) AS suite_id, lpad(o_orderkey::VARCHAR, 9, '0') AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'error' ELSE 'warn' END AS severity, ['pass', 'pass', 'fail', 'warn', 'errored', 'skipped'][(o_orderkey % 6 + 1)::INT] AS verdict FROM orders)"
_POINTS = f"(SELECT *, CASE WHEN verdict = 'skipped' THEN 0 WHEN severity = 'error' THEN 3 ELSE 1 END AS w, CASE WHEN verdict = 'pass' THEN CASE WHEN severity = 'error' THEN 3 ELSE 1 END ELSE 0 END AS e FROM {RESULTS})"
_EVEN = "(({a} // {b}) + CASE WHEN 2 * ({a} % {b}) > {b} OR (2 * ({a} % {b}) = {b} AND ({a} // {b}) % 2 = 1) THEN 1 ELSE 0 END)"


@query(f"SELECT suite_id, earned, possible, {_EVEN.format(a='(100 * earned)', b='possible')}::BIGINT AS score FROM (SELECT suite_id, sum(e)::BIGINT AS earned, sum(w)::BIGINT AS possible FROM {_POINTS} GROUP BY 1)")
def score_by_suite(spark, sf_dir):
    return scoring.score_frame(_results(spark, sf_dir), "suite_id").select("suite_id", "earned", "possible", "score")


@query(f"""WITH t AS (SELECT run_id, 100 - {_EVEN.format(a='(100 * sum(e))', b='sum(w)')}::BIGINT AS lost, sum(w - e)::BIGINT AS missed FROM {_POINTS} GROUP BY 1),
f AS (SELECT run_id, suite_id, id, lost, lost * w AS num, missed FROM {_POINTS} JOIN t USING (run_id) WHERE verdict NOT IN ('pass', 'skipped')),
g AS (SELECT *, num // missed AS base, rank() OVER (PARTITION BY run_id ORDER BY num % missed DESC, suite_id, id) AS turn, lost - sum(num // missed) OVER (PARTITION BY run_id) AS spare FROM f)
SELECT run_id, suite_id, id AS check_id, (base + (turn <= spare)::INT)::BIGINT AS points FROM g""")
def score_deductions(spark, sf_dir):
    return scoring.deduction_frame(_results(spark, sf_dir))


@query(f"SELECT run_id, count(*) AS checks, {', '.join(f'count(*) FILTER (verdict = {chr(39)}{v}{chr(39)}) AS \"{v}\"' for v in scoring.VERDICTS)} FROM {RESULTS} GROUP BY 1")
def totals_by_verdict(spark, sf_dir):
    return history.totals_frame(_results(spark, sf_dir), "run_id")


@query(f"SELECT run_id, suite_id AS suite, {_EVEN.format(a='(100 * earned)', b='possible')}::BIGINT AS score, selected - skipped AS evaluated, selected, pass, fail, warn, errored, skipped FROM (SELECT run_id, suite_id, sum(e)::BIGINT AS earned, sum(w)::BIGINT AS possible, count(*) AS selected, {', '.join(f'count(*) FILTER (verdict = {chr(39)}{v}{chr(39)}) AS \"{v}\"' for v in scoring.VERDICTS)} FROM {_POINTS} GROUP BY ALL)")
def suite_table(spark, sf_dir):
    """The table of suites in the report of every run."""
    return report.suite_frame(_results(spark, sf_dir))


@query("SELECT (o_custkey % 50)::VARCHAR AS run_id, 's' || (o_custkey % 3) AS suite_id, lpad(o_orderkey::VARCHAR, 9, '0') AS id, o_orderpriority AS reason, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY 's' || (o_custkey % 3), lpad(o_orderkey::VARCHAR, 9, '0')) AS place FROM orders WHERE o_orderkey % 6 = 5")
def not_evaluated(spark, sf_dir):
    """Skipped checks of every run and why; orders give their priority for a reason."""
    return report.not_evaluated_frame(_results(spark, sf_dir, F.col("o_orderpriority").alias("skip_reason")))


_DISTRIBUTION = "(SELECT c_mktsegment AS name, quantile_cont(n::DOUBLE, 0.5) AS median, quantile_cont(n::DOUBLE, 0.95) AS p95, quantile_cont(n::DOUBLE, 0.99) AS p99, max(n)::DOUBLE AS maximum FROM (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE {test}) ON o_custkey = c_custkey GROUP BY ALL) GROUP BY 1)"


@query(f"SELECT name, measure, round(a, 2) AS d_from, round(b, 2) AS d_to FROM (SELECT * FROM (UNPIVOT {_DISTRIBUTION.format(test='o_totalprice > 50000')} ON median, p95, p99, maximum INTO NAME measure VALUE a) JOIN (UNPIVOT {_DISTRIBUTION.format(test='true')} ON median, p95, p99, maximum INTO NAME measure VALUE b) USING (name, measure)) WHERE round(a, 2) <> round(b, 2)")
def diff_degrees(spark, sf_dir):
    """Degrees of the customers of each segment, over their dear orders and over all."""
    graph = load_graph(spark, sf_dir)

    def frame(orders: str) -> DataFrame:
        placed = graph.nodes("Order", ["o_totalprice"]).where(orders).select(F.col("id").alias("dst"))
        counts = graph.rels("PLACED").join(placed, "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        rows = graph.nodes("Customer", ["c_mktsegment"]).join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        found = rows.groupBy(F.col("c_mktsegment").alias("name")).agg(F.percentile("degree", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"), F.max("degree").alias("maximum"))
        return found.select("name", *[F.element_at("p", i).alias(n) for i, n in enumerate(("median", "p95", "p99"), 1)], "maximum")

    return diff.degree_diff(frame("o_totalprice > 50000"), frame("true"))


@query(f"WITH f AS ({_VALUE_HITS}), s AS (SELECT (count(c_name) + count(email) + count(phone) + count(nric) + count(a) + count(b))::BIGINT AS n FROM {CONTACTS}) SELECT pattern, property, observed, {_EVEN.format(a='(7 * n * observed)', b='n')}::BIGINT AS exposure_count FROM f, s WHERE observed > 0 UNION ALL SELECT pattern || ' of few', property, observed, {_EVEN.format(a='(n * observed)', b='(n // 2 + 1)')}::BIGINT FROM f, s WHERE observed > 0")
def pii_exposures(spark, sf_dir):
    """What the findings would mean for seven times the population, and had half of it been looked at."""
    plan = pii.pii_value_match(_contacts(spark, sf_dir), "Contact", pii.ALL)
    found = plan.findings.select("pattern", "property", "observed").crossJoin(F.broadcast(plan.summary.select("population")))  # one row
    n = F.col("population")
    more = pii.exposures(found, 7 * n, n).unionByName(pii.exposures(found.withColumn("pattern", F.concat("pattern", F.lit(" of few"))), n, F.floor(n / 2) + 1))
    return more.select("pattern", "property", "observed", "exposure_count")


# One name for each kind of personal data, with the kind that it tells.
_TELLING = {
    "ssn": "social_security", "dob": "birthday", "email": "e_mail", "phone": "msisdn", "nric": "national_registration_identity_card", "aadhaar": "uidai", "address": "residential_address", "passport": "passport_number",
    "credit_card": "payment_card", "tax_id": "taxpayer_id", "driver_license": "licence_number", "bank_account": "iban", "ip_address": "ipv6", "geolocation": "gps", "biometric": "voiceprint",
}


@query(" UNION ALL ".join(f"SELECT '{kind}' AS pattern, '{name.upper()}' AS property, count(*) AS observed FROM supplier WHERE s_suppkey % {i + 2} <> 0" for i, (kind, name) in enumerate(_TELLING.items())))
def pii_name_kinds(spark, sf_dir):
    """Suppliers with a column for each kind of personal data, each filled for another part of them."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    columns = [F.when(F.col("s_suppkey") % (i + 2) != 0, F.col("s_name")).alias(name.upper()) for i, name in enumerate(_TELLING.values())]
    graph = PropertyGraph(spark, [NodeSet(("Person",), rows.select(F.concat(F.lit("Person:"), "s_suppkey").alias("id"), "s_name", *columns))], [])
    return pii.pii_name_match(graph, "Person", pii.ALL).findings.select("pattern", "property", "observed")


_RANK = "CASE WHEN {x}.verdict = 'errored' AND {x}.severity = 'error' THEN 4 WHEN {x}.verdict = 'pass' THEN 0 WHEN {x}.verdict = 'skipped' THEN 1 WHEN {x}.verdict = 'warn' THEN 2 WHEN {x}.verdict = 'errored' THEN 3 ELSE 4 END"


_DATED = RESULTS.replace(" FROM orders)", ", o_orderdate FROM orders)")


@query(f"WITH a AS (SELECT * FROM {_DATED} WHERE o_orderdate < DATE '2001-01-01'), b AS (SELECT suite_id, id, severity, CASE WHEN verdict = 'fail' THEN 'pass' WHEN verdict = 'pass' THEN 'warn' ELSE verdict END AS verdict FROM {_DATED} WHERE o_orderdate >= DATE '1996-01-01') SELECT suite_id, id, a.verdict AS v_from, b.verdict AS v_to, CASE WHEN a.verdict IS NULL THEN 'added' WHEN b.verdict IS NULL THEN 'removed' WHEN a.verdict = b.verdict THEN 'same' WHEN {_RANK.format(x='b')} > {_RANK.format(x='a')} THEN 'regression' WHEN {_RANK.format(x='b')} < {_RANK.format(x='a')} THEN 'improvement' ELSE 'other' END AS change FROM a FULL JOIN b USING (suite_id, id)")
def run_comparison(spark, sf_dir):
    """All orders: the first year's were removed, the last year's added, all between are in both runs."""
    rows = _results(spark, sf_dir, "o_orderdate")
    moved = F.when(F.col("verdict") == "fail", "pass").when(F.col("verdict") == "pass", "warn").otherwise(F.col("verdict"))
    return history.compare_frames(rows.where("o_orderdate < DATE '2001-01-01'"), rows.where("o_orderdate >= DATE '1996-01-01'").withColumn("verdict", moved))


@query("SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 5 THEN '1-5' WHEN n <= 20 THEN '6-20' WHEN n <= 100 THEN '21-100' ELSE '101+' END AS band, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) GROUP BY 1")
def count_bands(spark, sf_dir):
    rows = c.with_degrees(load_graph(spark, sf_dir), "Customer", "PLACED", "out")
    return rows.groupBy(history.count_band(F.col("degree")).alias("band")).agg(F.count("*").alias("customers"))


@query(f"SELECT run_id, suite_id, id, verdict, row_number() OVER (PARTITION BY run_id ORDER BY {_RANK.format(x='r')} DESC, severity <> 'error', suite_id, id) AS place FROM {RESULTS} r WHERE verdict IN ('fail', 'warn', 'errored')")
def failures_report(spark, sf_dir):
    """The failures of every run in the order in which a report lists them."""
    return report.ordered_frame(_results(spark, sf_dir), report.FAILURES).select("run_id", "suite_id", "id", "verdict", "place")


@query("""WITH RECURSIVE m AS (SELECT conv_id, turn FROM conversations), p AS (SELECT conv_id, turn AS a, turn + 1 AS b, 1 AS hops FROM m WHERE EXISTS (SELECT 1 FROM m x WHERE x.conv_id = m.conv_id AND x.turn = m.turn + 1)
UNION ALL SELECT p.conv_id, a, b + 1, hops + 1 FROM p WHERE hops < 4 AND EXISTS (SELECT 1 FROM m x WHERE x.conv_id = p.conv_id AND x.turn = p.b + 1))
SELECT hops, count(*) AS paths FROM p GROUP BY 1""")
def path_1_to_4(spark, sf_dir):
    return load_graph(spark, sf_dir).paths("NEXT", 1, 4).groupBy("hops").agg(F.count("*").alias("paths"))


@query("SELECT date_trunc('hour', ts) AS window_start, count(*) AS population, count(*) FILTER (value IS NULL OR value < 0) AS violation_count FROM events GROUP BY 1")
def monitor_windows(spark, sf_dir):
    from pellucid.streaming.monitor import violation_counts

    events = load_graph(spark, sf_dir).nodes("Event", ["ts", "value"]).withColumn("ts", F.col("ts").cast("timestamp"))
    return violation_counts(events, F.col("value").isNull() | (F.col("value") < 0), "ts", "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
