"""The registered queries of the training-data operators, on small tables with awkward rows."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import pytest

from pellucid.llm import queries, toxicity
from pellucid.llm.byte_bpe import default_codec
from tests.llm.test_operators import plain_components, plain_repeats, prose

COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"], "op2_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"], "op3_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_mpeg_audio": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], "op6_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_kd_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op8_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op9_quality": ["doc_id", "held_out", "score", "predicted"], "op10_ngram_join": ["doc_id", "n_shingles", "component_id"],
}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, rows, labels = random.Random(6), [], []
    line = prose(rng, 12)
    base = [prose(rng, rng.randint(10, 80)) for _ in range(50)]
    for i in range(200):
        words, toxic, good = rng.choice(base).split(), rng.random() < 0.3, rng.random() < 0.7
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(base).split()[0]
        if toxic:
            words[2:2] = ["zorgulo", "zorgane"]
        text = " ".join(words) if good else " ".join(f"{w.upper()}!!" for w in words)
        rows.append((i, f"{text}\n{line}" if i % 9 == 0 else text))
        labels.append((i, int(good), int(toxic)))
    rows += [(900, None), (901, ""), (902, "x"), (903, "\n\n"), (904, "long " * 30_000)]
    top = str(tmp_path_factory.mktemp("queries"))
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top, dict(rows), {i: (q, t) for i, q, t in labels}


def found(spark, name, top):
    frame = queries.QUERIES[name](spark, top)
    assert frame.columns[: len(COLUMNS[name])] == COLUMNS[name]
    rows = {r["doc_id"]: r for r in frame.collect()}
    return rows


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def test_op1_and_op9(spark, corpus):
    top, docs, labels = corpus
    for name, mod, rest, least, label in (("op1_toxicity", 5, 0, 0.5, 1), ("op9_quality", 4, 2, 0.7, 0)):
        rows = found(spark, name, top)
        assert rows.keys() == docs.keys()
        for i, r in rows.items():
            assert (r["held_out"], r["predicted"]) == (held(i, mod, rest), int(r["score"] >= least)) and 0 <= r["score"] <= 1
        own = [i for i in labels if held(i, mod, rest)]
        assert sum(rows[i]["predicted"] == labels[i][label] for i in own) >= 0.9 * len(own) > 20


def test_op1_scores_as_a_plain_matcher_does(spark, corpus):
    top, docs, labels = corpus
    learnt = spark.read.parquet(f"{top}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    model = toxicity.train(spark.read.parquet(f"{top}/documents.parquet"), learnt)
    phrases = [toxicity.fold(x) for x in model.exceptions]
    for i, r in found(spark, "op1_toxicity", top).items():
        text = toxicity.fold(docs[i] or "")
        spared = {k for x in phrases for a in range(len(text)) if text.startswith(x, a) for k in range(a, a + len(x) - 1 + (len(x) == 1))} if len(text) < 5000 else set()
        best = {}
        for pattern, weight in model.entries.items():
            at = text.find(pattern)
            while at >= 0:
                best[at] = max(best.get(at, 0), weight)
                at = text.find(pattern, at + 1)
        total, (a, b, c) = sum(w for at, w in best.items() if at not in spared), model.fit
        x = a + b * math.log1p(total) + c * math.log1p(100 * total / max(1, text.count(" ") - 1))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-x))), i


def test_op2_op3_op5_op6(spark, corpus):
    top, docs, _ = corpus
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = {}
    for i, t in docs.items():
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, r in found(spark, "op2_line_dedup", top).items():
        lines = (docs[i] or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        assert (r["n_lines"], r["n_dropped"], r["kept_sha256"]) == (len(lines), len(lines) - len(stay), sha("\n".join(stay).encode()))
    codec = default_codec()
    for i, r in found(spark, "op3_byte_bpe", top).items():
        ids = codec.encode(docs[i] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, sha(ids), sha((docs[i] or "").encode()))
    for i, r in found(spark, "op5_mpeg_audio", top).items():
        raw = (docs[i] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:])) and r["media_bytes"] > len(payload) and r["feature"]
    want = plain_repeats(docs)
    for i, r in found(spark, "op6_suffix_dedup", top).items():
        kept, spans = want[i]
        n = len((docs[i] or "").encode())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, n - len(kept), spans, sha(kept))


def test_op7(spark, corpus):
    top, docs, _ = corpus
    rows = found(spark, "op7_kd_sharding", top)
    assert rows.keys() == docs.keys() and {r["law"] for r in rows.values()} == {"bytes"} and {r["grown_shard"] for r in rows.values()} == {None}
    slots = {}
    for i, r in rows.items():
        raw = (docs[i] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw)) and 0 <= r["shard"] < 40
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op8(spark, corpus):
    top, docs, _ = corpus
    words = {i: (t or "").encode().lower().split() + [b""] for i, t in docs.items()}
    c = Counter(w for i, ws in words.items() if not held(i, 10, 0) for w in ws)
    total, v = sum(c.values()), len(c)
    for i, r in found(spark, "op8_lm_scoring", top).items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i, 10, 0), len(words[i]), sum(c[w] > 0 for w in words[i]), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in words[i])) and r["score"] < 0 and math.isfinite(r["score"])


def test_op10(spark, corpus):
    top, docs, _ = corpus
    want = plain_components(list(docs.items()), 4, 85, 100)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found(spark, "op10_ngram_join", top).items()} == want


def test_op4(spark, corpus):
    top, docs, _ = corpus
    items = {1: docs[3], 2: docs[5], 3: "not a word of it anywhere at all"}
    spark.createDataFrame([(i, " ".join((t or "").split()[:25])) for i, t in items.items()], "item_id long, text string").write.mode("overwrite").parquet(f"{top}/benchmark.parquet")
    rows = queries.op4_decontaminate(spark, top).collect()
    assert {1, 2} <= {r["item_id"] for r in rows} and {(3, 1), (5, 2)} <= {(r["doc_id"], r["item_id"]) for r in rows} and all(0.5 <= r["share"] <= 1 for r in rows)


def test_ids_are_little_endian():
    assert struct.pack("<I", 1) == b"\x01\x00\x00\x00"  # what ids_sha256 is taken over
    assert default_codec().encode("a")[1:] == b"\x00\x00\x00"
