"""The sample tables as a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.graph import NodeSet, PropertyGraph, RelSet


def _id(label: str, *keys: str):
    return F.concat(F.lit(f"{label}:"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))


def _nodes(label: str, table, *keys: str, **more) -> NodeSet:
    return NodeSet((label,), lambda: table().withColumn("id", _id(label, *keys)), keys=keys, **more)


def _rels(type_: str, table, columns: tuple[str, ...], src, dst, id_=None) -> RelSet:
    """columns: the table's columns that the relationship needs or keeps as properties (none: all)."""

    def load():
        kept = (table().select(*columns) if columns else table()).withColumns({"src": src, "dst": dst})
        return kept.withColumn("id", F.concat_ws(">", F.lit(type_), "src", "dst") if id_ is None else id_)

    return RelSet(type_, load)


def load_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nodes Region, Nation, Customer, Supplier, Part, Order, LineItem, User, Event, Document (Quality, Toxic), Page,
    Conversation, Message; relationships IN_REGION, IN_NATION, PLACED, CONTAINS, PERFORMED, NEXT. A table is
    opened when the first plan needs it."""
    opened: dict[str, DataFrame] = {}

    def t(name):
        def read():
            if name not in opened:
                opened[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return opened[name]

        return read

    def at(name):
        return f"{sf_dir}/{name}.parquet"

    region, nation, customer, supplier, part, orders, lineitem, events, pages, conv = map(t, "region nation customer supplier part orders lineitem events pages conversations".split())

    def judged(docs):
        rows = docs.join(t("labels")(), "doc_id", "left")
        return rows.withColumn("labels", F.filter(F.array(F.when(F.col("quality") == 1, F.lit("Quality")), F.when(F.col("toxic") == 1, F.lit("Toxic"))), lambda x: x.isNotNull()))

    def items():
        return lineitem().join(orders().select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")

    def following():
        here = conv().select("conv_id", "turn")
        before = here.select("conv_id", (F.col("turn") - 1).alias("turn")).distinct()
        ends = here.join(before, ["conv_id", "turn"], "left_semi").select(_id("Message", "conv_id", "turn").alias("src"), F.concat(F.lit("Message:"), F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") + 1).cast("string")).alias("dst"))
        return ends.withColumn("id", F.concat_ws(">", F.lit("NEXT"), "src", "dst"))

    line_keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    nodes = [
        _nodes("Region", region, "r_regionkey", stored=at("region")), _nodes("Nation", nation, "n_nationkey", stored=at("nation")), _nodes("Customer", customer, "c_custkey", stored=at("customer")), _nodes("Supplier", supplier, "s_suppkey", stored=at("supplier")), _nodes("Part", part, "p_partkey", stored=at("part")),
        _nodes("Order", orders, "o_orderkey", stored=at("orders")), _nodes("LineItem", items, *line_keys), _nodes("User", lambda: events().select("user_id").distinct(), "user_id"), _nodes("Event", events, "event_id", stored=at("events")),
        _nodes("Document", t("documents"), "doc_id", optional=("Quality", "Toxic"), beside=judged, beside_columns=("quality", "toxic"), stored=at("documents")), _nodes("Page", pages, "page_id", stored=at("pages")), _nodes("Conversation", lambda: conv().select("conv_id").distinct(), "conv_id"), _nodes("Message", conv, "conv_id", "turn", stored=at("conversations")),
    ]
    rels = [
        _rels("IN_REGION", nation, ("n_nationkey", "n_regionkey"), _id("Nation", "n_nationkey"), _id("Region", "n_regionkey")),
        _rels("IN_NATION", customer, ("c_custkey", "c_nationkey"), _id("Customer", "c_custkey"), _id("Nation", "c_nationkey")),
        _rels("IN_NATION", supplier, ("s_suppkey", "s_nationkey"), _id("Supplier", "s_suppkey"), _id("Nation", "s_nationkey")),
        _rels("PLACED", orders, ("o_orderkey", "o_custkey"), _id("Customer", "o_custkey"), _id("Order", "o_orderkey")),
        _rels("CONTAINS", lineitem, (), _id("Order", "l_orderkey"), _id("Part", "l_partkey"), _id("CONTAINS", *line_keys)),
        _rels("PERFORMED", events, ("event_id", "user_id"), _id("User", "user_id"), _id("Event", "event_id")),
        RelSet("NEXT", following),
    ]
    return PropertyGraph(spark, nodes, rels, name="tables")
