"""Repeated word windows against a plain version."""

import random

import numpy as np
import pytest

from pellucid.llm import window_dedup
from tests.llm.test_operators import frame, prose


def plain_windows(rows, width):
    """rows: (doc_id, text), each a document of its own. n_words, kept of each, in the order of the rows."""
    words = [(t or "").encode().split() for _, t in rows]
    seen = {}
    for d, ws in enumerate(words):
        for i in range(len(ws) - width + 1):
            seen.setdefault(tuple(ws[i : i + width]), []).append((d, i))
    lost = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                lost[d].update(range(i, i + width))
    return [(len(ws), b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()) for ws, gone in zip(words, lost)]


def corpus(seed):
    rng = random.Random(seed)
    passage, other = prose(rng, 60), prose(rng, 36)
    rows = [(i, prose(rng, rng.randint(1, 200))) for i in range(60)]
    rows += [(100 + i, f"{prose(rng, rng.randint(0, 50))} {passage}\n\n{prose(rng, rng.randint(0, 50))}") for i in range(40)]
    rows += [(200 + i, f"{prose(rng, 20)}\t{' '.join(other.split()[: 34 + i])} {prose(rng, 20)}") for i in range(3)]
    rows += [(300, rows[3][1]), (301, rows[3][1].replace(" ", "\v")), (302, "la " * 50), (303, "la " * 34), (304, "Und " * 35), (305, "UND " * 36), (306, "a b " * 40), (307, prose(rng, 9000)), (308, None), (308, ""), (None, prose(rng, 50)), (None, " \n "), (309, "ein Wort\x1fmit Zeichen  " * 10)]
    rows += [(400, rows[5][1]), (400, rows[5][1]), (401, prose(rng, 80)), (401, prose(rng, 90)), (402, passage[3:])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,width,gram,bits", [(1, 35, 12, 30), (2, 35, 35, 1), (3, 7, 1, 17), (4, 1, 1, 30)])
def test_windows_equal_a_plain_version(spark, seed, width, gram, bits):
    rows = corpus(seed)
    data = frame(spark, rows).withColumnsRenamed({"n": "did", "h": "marks"}).repartition(5)
    found = window_dedup.remove_windows(data, width=width, gram=gram, most_bits=bits).collect()
    want = sorted((str(i), n, kept) for (i, _), (n, kept) in zip(rows, plain_windows(rows, width)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["kept"]) for r in found) == want
    for r in found:
        assert r["n_removed"] == r["n_words"] - len(r["kept"].split(" ") if r["kept"] else []) == sum(s["behind"] - s["first"] for s in r["spans"])
        assert all(a["behind"] < b["first"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_slices_and_batches_lose_nothing(spark, monkeypatch):
    rows = corpus(9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = window_dedup.remove_windows(frame(spark, rows).repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((str(r["doc_id"]), r["n_words"], r["kept"]) for r in found) == sorted((str(i), n, kept) for (i, _), (n, kept) in zip(rows, plain_windows(rows, 35)))


def test_no_documents(spark):
    assert window_dedup.remove_windows(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        window_dedup.remove_windows(frame(spark, []), width=3, gram=4)


def test_the_sketch_never_underestimates(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 100)) for i in range(30)] + [(50, prose(random.Random(4), 100))]
    words = window_dedup._Words()
    anchors = [window_dedup.windows(*words.digests(t.encode().split())) for _, t in rows]
    places = [g[np.r_[True, at[1:] != at[:-1]]] for at, g, _ in anchors]
    counts = np.unique(np.concatenate(places), return_counts=True)
    sketch = window_dedup.count_min(frame(spark, rows).repartition(4), 15)
    seen = window_dedup._estimated_repeated(sketch, 15, counts[0])
    assert seen[counts[1] > 1].all() and (counts[1] > 1).any() and not seen[counts[1] == 1].all()
    assert window_dedup.sketch_bits(0) == 15 and window_dedup.sketch_bits(1 << 50) == 29


def test_rolled_digests_follow_the_words():
    words = window_dedup._Words()
    one, two = words.digests([b"a", b"b", b"c", b"a", b"b", b"c", b"b"])
    for h in (window_dedup.rolled(one, 3, window_dedup._B1), window_dedup.rolled(two, 3, window_dedup._B2)):
        assert h[0] == h[3] and len(set(h.tolist())) == 4
    assert window_dedup._leftmost_least(np.array([3, 1, 1, 2, 0], np.uint64), 3).tolist() == [1, 1, 4]
