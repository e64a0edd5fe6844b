"""The whole pipeline against a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pellucid.llm import decontaminate, quality
from pellucid.llm.byte_bpe import default_codec
from tests.llm.test_operators import plain_components, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(3), [], []
    items = [(i, prose(rng, 25)) for i in range(5)]
    shared = prose(rng, 14)
    base = [prose(rng, rng.randint(20, 90)) for _ in range(60)]
    for i in range(260):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(base).split()[0]
        text = " ".join(words)
        good = rng.random() < 0.8
        if not good:
            text = " ".join(f"{w.upper()}!!" for w in words)
        elif i % 7 == 0:
            text = f"{text}\n{shared}\n{prose(rng, 20)}"
        elif i % 11 == 0:
            text = f"{text} {rng.choice(items)[1]}"
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(900, "", "en", "s", 0), (901, None, None, None, None)]
    top = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, rows, items


def test_pipeline_equals_a_plain_version(spark, folder):
    top, rows, items = folder
    model = quality.train(spark.read.parquet(f"{top}/documents.parquet"), spark.read.parquet(f"{top}/labels.parquet"))
    docs = {i: t for i, t, *_ in rows}
    docs = {i: t for i, t in docs.items() if model.score([t or ""])[0] >= 0.7}
    holders = Counter(k for t in docs.values() for k in {x.strip().lower() for x in (t or "").split("\n") if len(x.strip()) >= 40})
    last = {k: max(i for i, t in docs.items() if k in [x.strip().lower() for x in (t or "").split("\n")]) for k, n in holders.items() if n >= 5}
    assert last
    docs = {i: t if t is None else "\n".join(x for x in t.split("\n") if last.get(x.strip().lower(), i) == i) for i, t in docs.items()}
    found = plain_components(list(docs.items()), 5, 80, 100)
    docs = {i: t for i, t in docs.items() if found[i][1] == i}

    def leaks(text):
        own = decontaminate.words_of(text or "")
        number = {w: k for k, w in enumerate(sorted({*own, *(w for _, t in items for w in decontaminate.words_of(t))}))}
        at = lambda ws: np.array([number[w] for w in ws], np.int64)
        return any(decontaminate.smith_waterman(at(decontaminate.words_of(t)), at(own))[0] >= 0.5 * len(decontaminate.words_of(t)) for _, t in items) if own else False

    docs = {i: t for i, t in docs.items() if not leaks(t)}
    codec = default_codec()
    want = {i: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs.items() for ids in [codec.encode(t or "")]}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, top).collect()}
    assert got == want and 10 < len(got) < len(rows)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder[0])
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where("n_chars <> char_length(text)").count() == 0


def test_each_stage_reads_what_the_last_one_wrote(spark, folder, monkeypatch):
    seen = []
    stages = [(name, lambda s, docs, d, f=stage: seen.append(docs.inputFiles()) or f(s, docs, d)) for name, stage in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    out = corpus_pipeline.run(spark, folder[0])
    assert all(f.startswith(f"file://{folder[0]}/documents") for f in seen[0])
    for (name, _), files in zip(stages, [*seen[1:], out.inputFiles()]):
        assert files and all(f"/pipeline-{name}-" in f for f in files), name
    assert out.count() > 10
