"""Personal data in property names and values, by sampled occurrences."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pellucid.errors import CheckError
from pellucid.functions.checksums import luhn_ok, verhoeff_ok
from pellucid.functions.sampling import MODULUS, gate_limit, hash_coefficients, hash_rank
from pellucid.functions.types import family
from pellucid.graph import PropertyGraph
from pellucid.plans.base import CheckPlan
from pellucid.scoring import half_even_column
from pellucid.sources.metadata import metadata_counts

DEFAULT_SAMPLE = 1_000
#: The sample size that takes every occurrence, however many there are.
ALL = sys.maxsize
#: Occurrences that a task may hold while it looks for the smallest ranks.
HEAP = 100_000

#: Property names by kind of personal data, and (format, check digits or None) of string values; packs fill both.
NAME_PATTERNS: dict[str, tuple[str, ...]] = {}
VALUE_PATTERNS: dict[str, tuple[str, str | None]] = {}

#: Tests of check digits that patterns may name.
CHECK_DIGITS = {"luhn": luhn_ok, "verhoeff": verhoeff_ok}


@dataclass
class PiiPlan(CheckPlan):
    """A plan whose findings (pattern, property, labels, observed) come from the sampled occurrences."""

    findings: DataFrame | None = None


def _chosen(patterns, known: dict) -> list[str]:
    import pellucid.packs  # noqa: F401 - fills the patterns

    names = list(known) if patterns is None else list(patterns)
    if len(set(names)) != len(names) or patterns is not None and not names:
        raise CheckError("engine.invalid_check", "patterns must be a non-empty list without repeats")
    if unknown := [n for n in names if n not in known]:
        raise CheckError("packs.pii_pattern_unknown", f"unknown pattern {', '.join(unknown)}")
    return names


def _size(sample_size: int | None) -> int:
    if sample_size is None:
        return DEFAULT_SAMPLE
    if isinstance(sample_size, bool) or not isinstance(sample_size, int) or sample_size < 1:
        raise CheckError("engine.invalid_check", "sample_size must be 1 or more")
    return sample_size


def _sets(graph: PropertyGraph, label: str | None) -> list:
    return [s for s in graph.node_sets if label is None or label in s.labels or label in s.optional]


def _listed(s, strings_only: bool, properties) -> list[tuple[int, str]]:
    """Place (among all properties of the table) and name of the properties that count."""
    return [(i, p) for i, p in enumerate(sorted(s.properties)) if (properties is None or p in properties) and (not strings_only or family(s.kind(p)) == "string")]


def occurrences(graph: PropertyGraph, label: str | None, strings_only: bool, properties=None, values: bool = True) -> DataFrame:
    """id, part (number of the table), property, at (place of the property in its table) and value for each non-null property of each node.

    Labels are not among them: only hits need them, so a table that stands beside the nodes is not joined here for its labels.
    """
    parts = []
    for number, s in enumerate(_sets(graph, label)):
        listed = _listed(s, strings_only, properties)
        if not listed:
            continue
        everyone = label is None or label in s.labels
        df = s.rows([p for _, p in listed], not everyone)
        df = df if everyone else df.where(F.array_contains("labels", label))
        shown = lambda p: F.col(f"`{p}`") if strings_only and values else F.lit(None).cast("string")
        each = F.filter(F.array(*[F.when(F.col(f"`{p}`").isNotNull(), F.struct(F.lit(p).alias("property"), F.lit(i).alias("at"), shown(p).alias("value"))) for i, p in listed]), lambda x: x.isNotNull())
        parts.append(df.select("id", F.lit(number).alias("part"), F.explode(each).alias("x")).select("id", "part", "x.*"))
    if not parts:
        return graph.spark.createDataFrame([], "id string, part int, property string, at int, value string")
    return reduce(DataFrame.unionByName, parts)


def _with_labels(graph: PropertyGraph, label: str | None, hits: DataFrame) -> DataFrame:
    """Hits with the labels of their nodes: fixed ones by the number of the table, others looked up for the hits alone."""
    parts = []
    for number, s in enumerate(_sets(graph, label)):
        own = hits.where(F.col("part") == number)
        if s.optional:
            own = own.join(s.rows((), True).select("id", s.label_array().alias("labels")), "id")
        else:
            own = own.withColumn("labels", s.label_array())
        parts.append(own.select("id", "labels", "property", "patterns"))
    return reduce(DataFrame.unionByName, parts)


def _repeats(graph: PropertyGraph, label: str | None) -> int:
    """Occurrences that a node may have: the properties of the tables that can hold it."""
    return max(1, sum(len(s.properties) for s in _sets(graph, label)))


def known_population(graph: PropertyGraph, label: str | None, strings_only: bool, properties=None) -> int | None:
    """Occurrences by the metadata of stored tables, without reading a row group; None where a table does not tell."""
    total = 0
    for s in _sets(graph, label):
        names = [p for _, p in _listed(s, strings_only, properties)]
        if not names:
            continue
        if s.stored is None or label is not None and label not in s.labels or set(names) & set(s.beside_columns):
            return None
        counts = metadata_counts(graph.spark, s.stored, names)
        if counts is None:
            return None
        total += sum(counts[p] for p in names)
    return total


def _sampled(rows: DataFrame, size: int, seed: int, population: int | None) -> DataFrame:
    """The `size` occurrences of the smallest rank, or ALL. With a known population all of a smaller one are taken as they
    are, and of a larger one the gate lets about GATE_ROOM times the sample through to be ranked."""
    if size == ALL or population is not None and population <= size:
        return rows
    key = F.pmod(F.pmod(F.xxhash64("id"), F.lit(MODULUS)) * 1_103_515_245 + F.col("at"), F.lit(MODULUS))
    if population is not None and (limit := gate_limit(size, population)) < MODULUS:
        rows = rows.where(hash_rank(key, hash_coefficients(seed + 1)) < limit)
    return rows.withColumn("rank", hash_rank(key, hash_coefficients(seed))).orderBy("rank", "id", "property").limit(size)


def _plan(name: str, graph: PropertyGraph, label: str | None, rows: DataFrame, size: int, seed: int, tests: dict[str, Column], confidence: str, strings_only: bool, properties=None) -> PiiPlan:
    population = None if size == ALL else known_population(graph, label, strings_only, properties)
    if size > HEAP and size != ALL and population is None:
        population = rows.count()
    sample = _sampled(rows, size, seed, population)
    hits = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    marked = sample.withColumn("patterns", hits).withColumn("hit", F.size("patterns") > 0)
    counts = marked.agg(F.count("*").alias("sample_size"), F.count_if("hit").alias("violation_count"))
    if population is not None:
        summary = counts.select(F.lit(population).cast("long").alias("population"), "sample_size", "violation_count")
    elif size == ALL:
        summary = counts.select(F.col("sample_size").alias("population"), "sample_size", "violation_count")
    else:
        summary = rows.agg(F.count("*").alias("population")).crossJoin(counts)  # one row by one row
    found = _with_labels(graph, label, marked.where("hit").select("id", "part", "property", "patterns"))
    findings = found.select(F.explode("patterns").alias("pattern"), "property", "labels").groupBy("pattern", "property", "labels").agg(F.count("*").alias("observed"))
    evidence = found.select(F.lit("node").alias("kind"), "id", "labels", F.lit(None).cast("string").alias("type"))
    return PiiPlan(name, summary, evidence, {"confidence": confidence}, findings=findings, repeats=_repeats(graph, label))


def pii_name_match(graph: PropertyGraph, label: str | None = None, sample_size: int | None = None, patterns=None, seed: int = 0) -> PiiPlan:
    """Sampled property occurrences whose whole name is an alias of a pattern. No value leaves the plan."""
    names = _chosen(patterns, NAME_PATTERNS)
    graph.require((label,))
    rows = occurrences(graph, label, False, values=False)
    return _plan("pii_name_match", graph, label, rows, _size(sample_size), seed, {n: F.lower("property").isin(list(NAME_PATTERNS[n])) for n in names}, "name-match", False)


def value_test(col: Column, name: str) -> Column:
    """Whole match of a pattern, decimal digits of any script included, and its check digit over ASCII digits."""
    regex, checksum = VALUE_PATTERNS[name]
    test = col.rlike(rf"(?U)\A(?:{regex.removeprefix('^').removesuffix('$')})\z")
    extra = CHECK_DIGITS.get(checksum)
    return F.coalesce(test & extra(col) if extra else test, F.lit(False))


def pii_value_match(graph: PropertyGraph, label: str | None = None, sample_size: int | None = None, patterns=None, properties=None, seed: int = 0) -> PiiPlan:
    """Sampled string values that match a format and its check digit. Findings name the place, never the value."""
    names = _chosen(patterns, VALUE_PATTERNS)
    if properties is not None and (not properties or len(set(properties)) != len(properties)):
        raise CheckError("engine.invalid_check", "properties must be a non-empty list without repeats")
    graph.require((label,), (), properties or ())
    rows = occurrences(graph, label, True, properties)
    return _plan("pii_value_match", graph, label, rows, _size(sample_size), seed, {n: value_test(F.col("value"), n) for n in names}, "value-match", True, properties)


def exposures(findings: DataFrame, population: Column, sample_size: Column) -> DataFrame:
    """Findings with exposure_count: what was observed in the sample, carried over to the population, exact and with halves to even."""
    return findings.withColumn("exposure_count", half_even_column((population * F.col("observed")).cast("long"), sample_size.cast("long")))
