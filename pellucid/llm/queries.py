"""Contract queries: each applies its operator to a whole table of sf_dir."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.llm._common import crc_of_id


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pellucid.llm.toxicity import score_toxicity, train

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_of_id() % 5 != 0))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pellucid.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = """
WITH lines AS (
  SELECT d.doc_id, g.pos, string_split(coalesce(d.text, ''), chr(10))[g.pos] AS line
  FROM documents d, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(d.text, ''), chr(10))) + 1)) AS pos) g
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT keyed.doc_id, pos, line, coalesce(keyed.doc_id <> keeper, false) AS lost FROM keyed LEFT JOIN shared ON keyed.k = shared.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pellucid.llm.byte_bpe import roundtrip

    return roundtrip(_table(spark, sf_dir, "documents"))


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pellucid.llm.mpeg_audio import encode_media, feature, read_streams

    found = read_streams(encode_media(_table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature().alias("feature"), "duration_num", "duration_den", "n_frames",
    )


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pellucid.llm.sharding import kd_shards

    placed = kd_shards(_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pellucid.llm.quality import score_quality, train

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_of_id() % 4 != 2))
    return score_quality(docs, model).select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pellucid.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pellucid.llm.suffix_dedup import remove_repeats

    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pellucid.llm.lm_scoring import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pellucid.llm.ngram_join import ngram_components

    return ngram_components(_table(spark, sf_dir, "documents"), 4, 0.85)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pellucid.llm.vector_codes import compress

    coded, books = compress(_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _vector_codes_sql(rounds: int = 4, entries: int = 256, parts: int = 4) -> str:
    """Each round is two common table expressions: a (assignments by the codebooks before it), b (the codebooks after it)."""
    nearest = "SELECT vec_id, p, min(struct_pack(d := d, e := e)) AS best FROM (SELECT vec_id, x.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts x JOIN b{r} b ON x.p = b.p) GROUP BY vec_id, p"
    moved = "SELECT p, best.e AS e, j, sum(x[j]) AS s, count(*) AS n FROM a{r} JOIN parts USING (vec_id, p), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) GROUP BY ALL"
    means = f"SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM ({moved}) GROUP BY p, e"
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts QUALIFY e < {entries})",
    ]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(r=r)})")
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN ({means.format(r=r)}) m USING (p, e))")
    steps.append(f"a{rounds} AS MATERIALIZED ({nearest.format(r=rounds)})")
    steps.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    sha = f"(SELECT sha256(string_agg(v, ',' ORDER BY p, e, j)) FROM (SELECT p, e, unnest(c)::VARCHAR AS v, unnest(range(len(c))) AS j FROM b{rounds}))"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {sha} AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"


def op12_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pellucid.llm.window_dedup import remove_windows

    found = remove_windows(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = """
WITH words AS MATERIALIZED (
  SELECT doc_id, i, w[i] AS word, count(*) OVER (PARTITION BY doc_id) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)
), starts AS MATERIALIZED (
  SELECT doc_id, i, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS w FROM words QUALIFY i + 34 <= n
), repeated AS (
  SELECT doc_id, i FROM starts WHERE w IN (SELECT w FROM starts GROUP BY w HAVING count(*) > 1)
), marked AS (
  SELECT doc_id, words.i, word, max(r.i) OVER (PARTITION BY doc_id ORDER BY words.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS lost
  FROM words LEFT JOIN repeated r USING (doc_id, i)
)
SELECT doc_id, count(word) AS n_words, count(*) FILTER (lost) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM documents LEFT JOIN marked USING (doc_id) GROUP BY doc_id
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pellucid.llm.prefix_trie import rebuilt, sequences, trie

    return trie(rebuilt(sequences(_table(spark, sf_dir, "conversations"))))


#: crc32 of a number's digits, bit after bit.
_CRC32 = "xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"
OP13_SQL = f"""
WITH convs AS MATERIALIZED (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns, {_CRC32} % 4 AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, turns[1:d] AS path, d, len(turns) = d AS is_end FROM rebuilt, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)
), nodes AS MATERIALIZED (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].x, '[^\\x20\\x09-\\x0D]+')) END AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends FROM prefixes GROUP BY path, d
), children AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), whole AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.path = c.path
), below AS (
  SELECT path[1:d] AS path, sum(own)::BIGINT AS saved, count(*) FILTER (n_children = 0) AS leaves FROM whole, LATERAL (SELECT unnest(range(depth + 1)) AS d) GROUP BY 1
)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n AS n_convs, w.n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN below b ON w.path = b.path LEFT JOIN nodes p ON w.depth > 0 AND p.path = w.path[1:w.depth - 1]
"""


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_byte_bpe, op4_decontaminate, op5_mpeg_audio, op6_suffix_dedup, op7_kd_sharding, op8_lm_scoring, op9_quality, op10_ngram_join, op11_vector_codes, op12_window_dedup, op13_prefix_trie)}
SQL = {"op2_line_dedup": OP2_SQL, "op11_vector_codes": _vector_codes_sql(), "op12_window_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL}
