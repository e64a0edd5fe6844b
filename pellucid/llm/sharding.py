"""K-d tree sharding of documents by bytes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pellucid.llm._common import Stored, pick

#: Cells into which a dimension is cut when a median is looked for, and how often the cell that holds it is cut again.
CELLS, ROUNDS = 1024, 3


def _units(rows: DataFrame) -> DataFrame:
    """A row for each group of equal texts, or for each part of a heavy group.

    Columns: h1, h2 (digest of the text), part, weight and the metadata m0.. with a spread in [0, 1) for ties.
    """
    units = rows.groupBy("h1", "h2", "part").agg(F.sum("size").alias("weight"), F.min("size").alias("doc_size"), F.min("n_chars").alias("n_chars"), F.min("n_lines").alias("n_lines"))
    # ties in a dimension are settled by the digest, so that every weighted median can be hit
    spread = (F.pmod(F.xxhash64("h1", "h2", "part"), F.lit(1 << 20)) / float(1 << 20)).alias("spread")
    return units.select("h1", "h2", "part", F.col("weight").cast("double").alias("weight"), F.log2(F.col("doc_size") + 1.0).alias("m0"), (F.col("n_chars") / F.greatest(F.col("doc_size"), F.lit(1))).alias("m1"), F.log2(F.col("n_lines") + 1.0).alias("m2"), spread)


def kd_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, parts_of_a_leaf: int = 16) -> DataFrame:
    """Puts every row into one of n_shards shards of nearly equal bytes.

    A k-d tree over document metadata (bytes, characters a byte, lines): a node that stands for k shards is
    split at the weighted (k // 2) / k quantile along the dimension that is widest in it, until a leaf stands
    for one shard, so leaves reach total / n_shards bytes. Medians come from histograms of a fixed number of
    cells for each node, refined where the median lies; ties are settled by the text's digest. Only the
    tree (n_shards - 1 splits) and those histograms come to the driver; neither grows with the input.

    Equal texts go together; a group heavier than 1 / parts_of_a_leaf of a leaf is dealt in parts of at most
    that size by id. Returns doc_id, size (UTF-8 bytes of the text plus overhead; null text: overhead alone),
    text_crc32, shard, slot (gapless from 0 in each shard). Null ids and repeated rows are rows like any
    other; null and empty texts are one group of the smallest size; a text larger than a leaf takes a shard by
    itself. Ties in a dimension are settled by the digest, ties in id by the text's checksum. Other columns,
    whatever their names, are not looked at; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"),
        F.char_length(text).cast("long").alias("n_chars"), (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
    )
    stored = Stored(rows, "shard-rows")
    rows = stored.df
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    most = max(1.0, total / n_shards / parts_of_a_leaf)
    # a heavy group has more than 1 / (n_shards * parts_of_a_leaf) of all bytes: there are no more of them than that
    heavy = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > most).select("h1", "h2", F.ceil(F.col("bytes") / most).alias("parts"))
    rows = rows.join(F.broadcast(heavy), ["h1", "h2"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts")), F.lit(0)).cast("int"))
    units = Stored(_scaled(_units(rows)), "shard-units")
    tree = _grow(units.df, n_shards)
    placed = units.df.select("h1", "h2", "part", _place(tree, 0, n_shards).alias("shard"))
    blocks = count // (n_shards * 50_000) + 1
    dealt = rows.join(placed, ["h1", "h2", "part"]).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(blocks)).cast("int").alias("block"))
    return _slots(dealt)


def _scaled(units: DataFrame) -> DataFrame:
    """Dimensions scaled to [0, 1) over the whole table, with the digest below the last place."""
    ends = units.agg(*[f(f"m{i}").alias(f"{n}{i}") for i in range(3) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = units
    for i in range(3):
        lo, width = ends[f"lo{i}"] or 0.0, (ends[f"hi{i}"] or 0.0) - (ends[f"lo{i}"] or 0.0)
        grain = 1e-4  # values closer than this count as tied
        at = F.floor((F.col(f"m{i}") - lo) / (width or 1.0) / grain) * grain
        out = out.withColumn(f"d{i}", (at + F.col("spread") * grain) / (1 + grain))
    return out.select("h1", "h2", "part", "weight", "d0", "d1", "d2")


def _grow(units: DataFrame, n_shards: int) -> dict:
    """Splits by node: {(first shard, shards): (dimension, value, shards on the left)}; level by level."""
    tree: dict = {}
    level = [(0, n_shards)]
    while level := [x for x in level if x[1] > 1]:
        node = _place(tree, 0, n_shards).alias("node")
        at = units.select(node, "weight", "d0", "d1", "d2")
        found = {r["node"]: r for r in at.groupBy("node").agg(F.sum("weight").alias("weight"), *[f(f"d{i}").alias(f"{n}{i}") for i in range(3) for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        open_ = {}
        for first, k in level:
            r = found.get(first)
            if r is None:  # no rows: any cut will do
                tree[first, k] = (0, 0.5, k // 2)
                continue
            dim = max(range(3), key=lambda i: r[f"hi{i}"] - r[f"lo{i}"])
            open_[first] = [k, dim, r[f"lo{dim}"], r[f"hi{dim}"] + 1e-12, r["weight"] * (k // 2) / k, 0.0]
        for _ in range(ROUNDS):
            if not open_:
                break
            cell = F.lit(None)
            for first, (_k, dim, lo, hi, _w, _c) in open_.items():
                cell = F.when(F.col("node") == first, F.floor((F.col(f"d{dim}") - lo) / ((hi - lo) or 1.0) * CELLS)).otherwise(cell)
            sums: dict = {}
            for r in at.select("node", "weight", cell.cast("long").alias("cell")).where((F.col("cell") >= 0) & (F.col("cell") < CELLS)).groupBy("node", "cell").agg(F.sum("weight").alias("w")).collect():
                sums.setdefault(r["node"], []).append((r["cell"], r["w"]))
            for first, x in open_.items():
                step, below = (x[3] - x[2]) / CELLS, 0.0
                for c, w in sorted(sums.get(first, [])):
                    if below + w >= x[4]:
                        break
                    below += w
                x[4] -= below
                x[5] = w
                x[2], x[3] = x[2] + c * step, x[2] + (c + 1) * step
        for first, (k, dim, lo, hi, w, last) in open_.items():
            # what lies in the last cell goes to the side that it leaves nearer to its share
            tree[first, k] = (dim, lo if w < last / 2 else hi, k // 2)
        level = [y for first, k in level for y in ((first, k // 2), (first + k // 2, k - k // 2))]
    return tree


def _place(tree: dict, first: int, k: int):
    """The first shard of the node in which a unit lies, as far as the tree has grown."""
    if (first, k) not in tree:
        return F.lit(first)
    dim, value, left = tree[first, k]
    return F.when(F.col(f"d{dim}") < value, _place(tree, first, left)).otherwise(_place(tree, first + left, k - left))


def _slots(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each shard from 0: within blocks of a shard, then moved by the blocks before."""
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")) - 1
    return rows.withColumn("own", own).join(before, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"))
