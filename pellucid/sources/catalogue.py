"""Declared constraints and indexes: from the tables themselves or from a catalogue file, and whether the data keep them."""

from __future__ import annotations

from functools import reduce
from pathlib import Path
from typing import Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, ValidationError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.errors import CheckError
from pellucid.graph import PropertyGraph

KEY, EXISTS, UNIQUE = "NODE_KEY", "NODE_PROPERTY_EXISTENCE", "UNIQUENESS"


class Definition(BaseModel):
    model_config = ConfigDict(extra="forbid", strict=True)
    name: str = Field(min_length=1)
    labels_or_types: list[str] = Field(min_length=1)
    properties: list[str] = []


class Constraint(Definition):
    type: Literal["NODE_KEY", "NODE_PROPERTY_EXISTENCE", "UNIQUENESS"]


class Index(Definition):
    type: str = Field(min_length=1)


class Catalogue(BaseModel):
    model_config = ConfigDict(extra="forbid", strict=True)
    constraints: list[Constraint] = []
    indexes: list[Index] = []


def read_catalogue(path: str | Path) -> tuple[list[dict], list[dict]]:
    """(constraints, indexes) of a YAML file; anything else than the model takes, or a name that stands twice, is an error."""
    try:
        found = Catalogue.model_validate(yaml.safe_load(Path(path).read_text()) or {})
    except (ValidationError, yaml.YAMLError) as e:
        raise CheckError("profile.catalogue_invalid", f"{path}: {str(e).splitlines()[0]}") from None
    for listed in (found.constraints, found.indexes):
        if len({x.name for x in listed}) < len(listed):
            raise CheckError("profile.catalogue_invalid", f"{path}: a name stands twice")
    return [x.model_dump() for x in found.constraints], [x.model_dump() for x in found.indexes]


def declared(graph: PropertyGraph) -> list[dict]:
    """What the tables declare: the keys that their ids are made of, and columns that cannot be null."""
    found = []
    for s in graph.node_sets:
        for label in s.labels:
            if s.keys:
                found.append({"name": f"{label.lower()}_key", "type": KEY, "labels_or_types": [label], "properties": sorted(s.keys)})
            found += [{"name": f"{label.lower()}_{f.name}_exists", "type": EXISTS, "labels_or_types": [label], "properties": [f.name]} for f in s.own.schema.fields if not f.nullable and f.name in s.properties]
    return sorted({x["name"]: x for x in found}.values(), key=lambda x: x["name"])


def kept(graph: PropertyGraph, constraints: list[dict]) -> DataFrame:
    """name, elements, broken: the nodes of each constraint's labels, and those of them that break it.

    A key is broken by a missing property and by every node that shares its values; uniqueness by the latter alone (nodes
    without one of the properties are free), existence by the former. Keys travel as digests.
    """
    parts = []
    for c in constraints:
        graph.require(c["labels_or_types"], (), c["properties"])
        cols = [F.col(f"`{p}`") for p in c["properties"]]
        rows = reduce(DataFrame.unionByName, [graph.nodes(x, c["properties"]) for x in c["labels_or_types"]])
        missing = reduce(lambda a, b: a | b, [x.isNull() for x in cols])
        if c["type"] == EXISTS:
            counts = rows.agg(F.count("*").alias("elements"), F.count_if(missing).alias("broken"))
        else:
            value = F.when(~missing, F.unhex(F.sha2(F.to_json(F.struct(*cols)).cast("binary"), 256)))
            groups = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
            lost = F.col("value").isNull() if c["type"] == KEY else F.lit(False)
            counts = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("elements"), F.coalesce(F.sum(F.when(lost | F.col("value").isNotNull() & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("broken"))
        parts.append(counts.select(F.lit(c["name"]).alias("name"), "elements", "broken"))
    return reduce(DataFrame.unionByName, parts) if parts else graph.spark.createDataFrame([], "name string, elements long, broken long")
