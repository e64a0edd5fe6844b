"""Registered queries and stages against plain versions, with awkward rows and columns that clash."""

import random

import numpy as np
import pytest

import corpus_pipeline
from pellucid.llm import decontaminate, mpeg_audio, quality, queries
from pellucid.llm.line_dedup import dedup_lines
from tests.llm.test_operators import prose


def test_quality_votes_as_plain_cosines_do(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(5, 60)) if i % 3 else f"{prose(rng, 9).upper()}!!! {i}") for i in range(150)] + [(500, ""), (501, None), (502, prose(rng, 4000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int"))
    assert model.vectors.shape == (120, quality.DIMS) and np.allclose(np.linalg.norm(model.vectors, axis=1), 1, atol=1e-4)
    found = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    for i, text in rows:
        dense = np.zeros(quality.TERMS)
        at, w = quality.terms(text or "")
        dense[at] = w
        v = (dense * model.idf) @ model.projection.astype(np.float64)
        v = v / max(np.linalg.norm(v), 1e-9)
        sims = sorted(((float(v @ x), k) for k, x in enumerate(model.vectors.astype(np.float64))), reverse=True)[: quality.NEIGHBOURS]
        weights = [max(s, 1e-6) ** quality.SHARPNESS for s, _ in sims]
        assert found[i] == pytest.approx(sum(w * model.labels[k] for w, (_, k) in zip(weights, sims)) / sum(weights), abs=2e-3), i


def test_op4_equals_full_alignment(spark, tmp_path):
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randint(2, 25))) for i in range(12)] + [(50, None), (51, "")]
    rows = []
    for i in range(60):
        words = prose(rng, rng.randint(0, 60)).split()
        if i % 3 == 0:
            copy = rng.choice(items[:12])[1].split()
            for _ in range(rng.randint(0, len(copy) // 3)):
                copy[rng.randrange(len(copy))] = "changed"
            words[5:5] = copy
        rows.append((i, " ".join(words)))
    rows += [(900, None), (901, ""), (3, rows[3][1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"], round(r["share"], 6)) for r in queries.op4_decontaminate(spark, str(tmp_path)).collect()}
    want = set()
    for d, text in rows:
        for i, item in items:
            own, words = decontaminate.words_of(text or ""), decontaminate.words_of(item or "")
            number = {w: k for k, w in enumerate(sorted({*own, *words}))}
            if len(words) < 3 or not own:
                continue
            score = decontaminate.smith_waterman(np.array([number[w] for w in words]), np.array([number[w] for w in own]))[0]
            if score >= max(np.ceil(0.5 * len(words)), min(5, len(words))):
                want.add((d, i, round(score / len(words), 6)))
    assert found == want and len(want) > 15


def test_op5_feature_follows_the_stream(spark, tmp_path):
    rows = [(1, "x" * 500), (2, "x" * 500), (3, "y" * 500), (4, ""), (5, None), (6, "z" * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op5_mpeg_audio(spark, str(tmp_path)).collect()}
    assert found[1]["feature"] == found[2]["feature"] and found[4]["feature"] == found[5]["feature"] and len({r["feature"] for r in found.values()}) >= 3
    streams = {r["doc_id"]: r for r in mpeg_audio.read_streams(mpeg_audio.encode_media(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, r in found.items():
        s = streams[i]
        assert r["n_frames"] == len(s["offsets"]) and (r["duration_num"], r["duration_den"]) == (s["duration_num"], s["duration_den"])


def test_columns_may_have_the_operators_own_names(spark):
    rng = random.Random(3)
    line = prose(rng, 12)
    rows = [(i, f"{line}\n{prose(rng, 9)}", i, "h", "k", ["x"], {"a": 1}) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, did long, th string, pos string, lines array<string>, row map<string,int>")
    plain = docs.select("doc_id", "text")
    show = lambda df: sorted((r["doc_id"], r["kept"], r["n_dropped"]) for r in df.collect())
    assert show(dedup_lines(docs)) == show(dedup_lines(plain)) and sum(n for *_, n in show(dedup_lines(plain))) == 7


@pytest.fixture
def labelled(spark, tmp_path):
    rng = random.Random(4)
    texts = [prose(rng, 40) for _ in range(30)]
    rows = [(i, t if i % 2 else t.upper() + "!!!", "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_the_pipeline_takes_repeated_rows_together(spark, labelled):
    top, rows = labelled
    spark.createDataFrame([*rows, rows[1], rows[1], rows[2], (None, rows[3][1], None, None, None)], SCHEMA).write.parquet(f"{top}/documents.parquet")
    found = [r["doc_id"] for r in corpus_pipeline.run(spark, top).collect()]
    assert found.count(1) in (0, 3) and found.count(1) == 3 * found.count(5) and found.count(2) in (0, 2)


def test_the_pipeline_of_no_documents_is_empty(spark, labelled):
    top, _ = labelled
    spark.createDataFrame([], SCHEMA).write.parquet(f"{top}/documents.parquet")
    found = corpus_pipeline.run(spark, top)
    assert found.collect() == [] and found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
