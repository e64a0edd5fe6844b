"""A property graph as a catalogue of node and relationship tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.errors import SchemaReferenceMissing
from pellucid.sources.metadata import metadata_counts

#: Columns of a node or relationship table that are not properties.
NODE_OWN, REL_OWN = ("id", "labels"), ("id", "src", "dst")


@dataclass(frozen=True)
class NodeSet:
    """Nodes of one table: `id` (string) and a column for each property; a null property does not exist.

    labels: those that every node has. Further labels stand in a column `labels` (array of strings), whose
    possible values `optional` lists: the catalogue knows them even where no node carries them. The table may
    be given as a function: it is then opened only when a plan needs it.

    beside: what adds the properties `beside_columns` and the column `labels` from another table; it is only called
    for plans that ask for these. stored: the path of the Parquet table whose rows are the nodes, one for one, with its
    columns as properties; counts then come from its metadata.
    """

    labels: tuple[str, ...]
    table: DataFrame | Callable[[], DataFrame]
    optional: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    beside: Callable[[DataFrame], DataFrame] | None = None
    beside_columns: tuple[str, ...] = ()
    stored: str | None = None

    @cached_property
    def own(self) -> DataFrame:
        """The table alone."""
        return self.table() if callable(self.table) else self.table

    @cached_property
    def df(self) -> DataFrame:
        """The table with all properties and labels."""
        return self.own if self.beside is None else self.beside(self.own)

    def rows(self, properties=(), labelled: bool = False) -> DataFrame:
        """The table, with what stands beside it only where it is asked for."""
        return self.df if self.optional and labelled or set(properties) & set(self.beside_columns) else self.own

    @cached_property
    def properties(self) -> list[str]:
        return [c for c in (*self.own.columns, *self.beside_columns) if c not in NODE_OWN]

    def kind(self, name: str):
        """The Spark type of a property."""
        return (self.df if name in self.beside_columns else self.own).schema[name].dataType

    def label_array(self):
        fixed = F.array(*[F.lit(x) for x in self.labels])
        return F.array_sort(F.array_union(fixed, F.col("labels"))) if self.optional else F.array_sort(fixed)


@dataclass(frozen=True)
class RelSet:
    """Relationships of one type: `id`, `src`, `dst` (strings) and a column for each property."""

    type: str
    table: DataFrame | Callable[[], DataFrame]
    stored: str | None = None

    @cached_property
    def df(self) -> DataFrame:
        return self.table() if callable(self.table) else self.table

    @cached_property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in REL_OWN]


@dataclass
class PropertyGraph:
    """Node and relationship tables by label and type; nothing runs until a plan is collected."""

    spark: SparkSession
    node_sets: list[NodeSet]
    rel_sets: list[RelSet]
    name: str = "graph"
    capabilities: dict[str, bool] = field(default_factory=lambda: {"read": True, "store_consistency": False})
    _counts: tuple[int, int] | None = None
    _populations: dict = field(default_factory=dict)

    @property
    def labels(self) -> list[str]:
        return sorted({x for s in self.node_sets for x in (*s.labels, *s.optional)})

    @property
    def types(self) -> list[str]:
        return sorted({r.type for r in self.rel_sets})

    @property
    def property_keys(self) -> list[str]:
        return sorted({p for s in (*self.node_sets, *self.rel_sets) for p in s.properties})

    def require(self, labels=(), types=(), properties=()) -> None:
        """Unknown names are an error, not an empty population; an empty graph lets them pass where allowed by the caller."""
        missing = [[x for x in asked if x is not None and x not in known] for asked, known in ((labels, self.labels), (types, self.types))]
        near = lambda s: not (set(getattr(s, "labels", ())) | set(getattr(s, "optional", ())) | {getattr(s, "type", None)}) & ({*labels, *types} - {None})
        sets = sorted((*self.node_sets, *self.rel_sets), key=near)  # tables that are asked for first: others need not be opened
        missing.append([p for p in properties if not any(p in s.properties for s in sets)])
        if any(missing):
            raise SchemaReferenceMissing(*missing)

    def nodes(self, label: str | None = None, properties: list[str] | None = None, with_labels: bool = False) -> DataFrame:
        """id, the properties asked for (null where a table lacks them) and, if wanted, all labels of the nodes."""
        parts = []
        for s in self.node_sets:
            if label is not None and label not in s.labels and label not in s.optional:
                continue
            everyone = label is None or label in s.labels
            df = s.rows(properties or (), with_labels or not everyone)
            df = df if everyone else df.where(F.array_contains("labels", label))
            types = {p: self.property_type(label, p) for p in properties or ()}
            cols = [F.col(p) if p in s.properties else F.lit(None).cast(types[p]).alias(p) for p in properties or ()]
            parts.append(df.select("id", *([s.label_array().alias("labels")] if with_labels else []), *cols))
        if not parts:
            schema = "id string" + (", labels array<string>" if with_labels else "") + "".join(f", `{p}` string" for p in properties or ())
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, parts)

    def nodes_of_any(self, *labels: str) -> DataFrame:
        """id and labels of the nodes that carry one of the labels; tables that cannot hold them are not opened."""
        own = [s for s in self.node_sets if set(labels) & {*s.labels, *s.optional}]
        rows = PropertyGraph(self.spark, own, []).nodes(with_labels=True)
        return rows.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))

    def property_type(self, label: str | None, name: str) -> str:
        """The Spark type of a property; string where no table of the label has it."""
        for s in self.node_sets:
            if (label is None or label in s.labels or label in s.optional) and name in s.properties:
                return s.kind(name).simpleString()
        return "string"

    def rels(self, type_: str | None = None, properties: list[str] | None = None) -> DataFrame:
        """id, type, src, dst and the properties asked for."""
        parts = [
            r.df.select("id", F.lit(r.type).alias("type"), "src", "dst", *[F.col(p) if p in r.properties else F.lit(None).alias(p) for p in properties or ()])
            for r in self.rel_sets if type_ is None or r.type == type_
        ]
        if not parts:
            return self.spark.createDataFrame([], "id string, type string, src string, dst string" + "".join(f", `{p}` string" for p in properties or ()))
        return reduce(DataFrame.unionByName, parts)

    def copies(self, *labels: str) -> int:
        """How often a node may come where these labels are looked up together: once for each table that can hold it."""
        return max(1, sum(bool(set(labels) & {*s.labels, *s.optional}) for s in self.node_sets))

    def population(self, label: str | None = None) -> int:
        """Nodes of a label, asked once: from the metadata of stored tables, without reading a row group; else one count."""
        if label not in self._populations:
            own = [s for s in self.node_sets if label is None or label in s.labels or label in s.optional]
            known = [metadata_counts(self.spark, s.stored) if s.stored is not None and (label is None or label in s.labels) else None for s in own]
            rest = PropertyGraph(self.spark, [s for s, k in zip(own, known) if k is None], []).nodes(label)
            self._populations[label] = sum(k["*"] for k in known if k is not None) + (rest.count() if None in known else 0)
        return self._populations[label]

    def counts(self) -> tuple[int, int]:
        """Nodes and relationships, counted once in one job without reading a column."""
        if self._counts is None:
            one = lambda n, df: df.agg(F.count("*").alias("n")).withColumn("what", F.lit(n))
            parts = [one("nodes", s.own) for s in self.node_sets] + [one("rels", r.df) for r in self.rel_sets]
            found = {"nodes": 0, "rels": 0}
            if parts:
                for row in reduce(DataFrame.unionByName, parts).collect():
                    found[row["what"]] += row["n"]
            self._counts = found["nodes"], found["rels"]
        return self._counts

    def is_empty(self) -> bool:
        return self.counts() == (0, 0)

    def fingerprint(self) -> str:
        nodes, rels = self.counts()
        shape = {"labels": self.labels, "node_count": nodes, "relationship_count": rels, "relationship_types": self.types}
        return "sha256:" + hashlib.sha256(json.dumps(shape, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def target(self) -> dict:
        nodes, rels = self.counts()
        return {
            "database": self.name, "server_version": self.spark.version, "edition": "spark", "fingerprint": self.fingerprint(),
            "capabilities": dict(self.capabilities), "nodes": nodes, "relationships": rels, "labels": self.labels, "relationship_types": self.types,
        }

    def register_views(self, query: str | None = None) -> None:
        """Temporary views node_<Label>, rel_<TYPE>, graph_nodes and graph_rels for SQL competency queries; with a
        query, only those whose names stand in it (in any case)."""
        asked = lambda name: query is None or name.lower() in query.lower()
        for label in self.labels:
            if not asked(f"node_{label}"):
                continue
            own = [s for s in self.node_sets if label in s.labels or label in s.optional]
            props = sorted({p for s in own for p in s.properties})
            self.nodes(label, props, True).withColumn("node_element_id", F.col("id")).createOrReplaceTempView(f"node_{label}")
        for r in self.rel_sets:
            if not asked(f"rel_{r.type}"):
                continue
            same = [x for x in self.rel_sets if x.type == r.type]
            self.rels(r.type, sorted({p for x in same for p in x.properties})).withColumn("rel_element_id", F.col("id")).createOrReplaceTempView(f"rel_{r.type}")
        if asked("graph_nodes"):
            self.nodes(with_labels=True).createOrReplaceTempView("graph_nodes")
        if asked("graph_rels"):
            self.rels().createOrReplaceTempView("graph_rels")

    def match(self, from_label: str, type_: str, to_label: str, from_props=(), to_props=()) -> DataFrame:
        """Node, relationship, node: columns a_id, r_id, b_id and the properties as a_<name>, b_<name>."""
        self.require((from_label, to_label), (type_,))
        side = lambda label, props, x: self.nodes(label, list(props)).select(F.col("id").alias(f"{x}_id"), *[F.col(p).alias(f"{x}_{p}") for p in props])
        rels = self.rels(type_).select(F.col("id").alias("r_id"), F.col("src").alias("a_id"), F.col("dst").alias("b_id"))
        return rels.join(side(from_label, from_props, "a"), "a_id").join(side(to_label, to_props, "b"), "b_id")

    def paths(self, type_: str, least: int = 1, most: int = 4, from_ids: DataFrame | None = None) -> DataFrame:
        """Directed paths of least..most relationships that repeat none: start, stop, rels (ids in order), hops.

        One join for each hop; from_ids (column id) restricts the starts.
        """
        rels = self.rels(type_).select("id", "src", "dst")
        step = rels if from_ids is None else rels.join(from_ids.select(F.col("id").alias("src")), "src", "left_semi")
        at = step.select(F.col("src").alias("start"), F.col("dst").alias("stop"), F.array("id").alias("rels"))
        found = [at] if least <= 1 else []
        for hop in range(2, most + 1):
            more = rels.select(F.col("id").alias("next"), F.col("src").alias("stop"), F.col("dst").alias("to"))
            at = at.join(more, "stop").where(~F.array_contains("rels", F.col("next"))).select("start", F.col("to").alias("stop"), F.concat("rels", F.array("next")).alias("rels"))
            if hop >= least:
                found.append(at)
        return reduce(DataFrame.unionByName, found).withColumn("hops", F.size("rels"))
