"""Vector codes and the conversation trie against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from pellucid.llm import prefix_trie, queries, vector_codes


def plain_codes(rows, entries=256, rounds=4):
    """rows: (vec_id, label, vector). What the contract says, entry by entry."""
    kept = sorted((r for r in rows if r[2] and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [(i, lab, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, lab, v in kept if len(v) == len(kept[0][2])]
    w = len(kept[0][2]) // 4
    parts = [[v[p * w : (p + 1) * w] for _, _, v in kept] for p in range(4)]
    books = [part[:entries] for part in parts]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            at = [near(x, books[p])[1] for x in parts[p]]
            groups = [[x for x, e in zip(parts[p], at) if e == k] for k in range(len(books[p]))]
            books[p] = [[sum(c) // len(g) for c in zip(*g)] if g else old for g, old in zip(groups, books[p])]
    found = [[near(parts[p][i], books[p]) for p in range(4)] for i in range(len(kept))]
    out = [(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), lab) for (i, lab, _), f in zip(kept, found)]
    totals = {}
    for _, _, d, lab in out:
        totals[lab] = totals.get(lab, 0) + d
    return sorted((str(i), c, d, totals[lab]) for i, c, d, lab in out), hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def test_codes_equal_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 1, 1, 2]), [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(700)]
    rows += [(700 + i, 3, list(rows[i][2])) for i in range(40)] + [(5, 9, rows[7][2]), (5, 9, rows[7][2]), (None, None, rows[8][2]), (-4, 1, [0.0] * 12)]
    odd = [(2000, 1, None), (2001, 1, []), (2002, 1, [0.1] * 11), (2003, 1, [0.1] * 11 + [None]), (2004, 1, [0.1] * 11 + [math.nan]), (2005, 1, [math.inf] + [0.1] * 11), (2006, 1, [-math.inf] * 12)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, lab, v, "x", [1]) for i, lab, v in rows + odd], "vec_id long, label int, embedding array<float>, code string, part array<int>").repartition(5)
    coded, books = vector_codes.compress(frame)
    want, sha = plain_codes(rows)
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in coded.collect()) == want
    assert books.sha256() == sha and [len(b) for b in books.parts] == [256] * 4
    codes = np.array([list(bytes.fromhex(c)) for _, c, _, _ in want])
    assert books.decode(codes).shape == (len(want), 12)


def test_few_huge_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [1e300, -1e300, 0.0, 2.0, 5.0]), (2, [1e300, 0.0, 0.0, 2.0, 5.0]), (3, [0.5, 0.0, 0.0, 2.0, 5.0])]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, schema))
    found = {r["vec_id"]: r for r in coded.collect()}
    assert books.width == 2 and len(books.parts[0]) == 3 and found.keys() == {1, 2, 3}
    assert all(r["error"] == 0 and r["label_error"] == 0 for r in found.values())
    coded, books = vector_codes.compress(spark.createDataFrame([(1, None), (2, [math.nan])], schema))
    assert coded.collect() == [] and books.sha256() == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("reach", [3, 1 << 31])
def test_partial_distances_find_the_nearest(reach):
    rng = np.random.default_rng(reach)
    for dims in (1, 4, 5, 16):
        book, x = rng.integers(-reach, reach, (40, dims)), rng.integers(-reach, reach, (300, dims))
        at, far = vector_codes.nearest(x, book)
        full = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in book] for v in x]
        assert at.tolist() == [d.index(min(d)) for d in full] and [int(d) for d in far] == [min(d) for d in full]
    assert sorted(vector_codes.search_order(np.array([[0, 5, 1], [0, -5, 2]])).tolist()) == [0, 1, 2] and vector_codes.search_order(np.array([[0, 5, 1], [0, -5, 2]]))[0] == 1


def plain_trie(rows):
    """rows: (conv_id, turn, role, text). All prefixes, one by one."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + ts[h:]
    members, ends = {}, {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
        ends.setdefault(tuple(ts), []).append(c)
    saved = {p: (len(m) - 1) * (len(p[-1][1].encode().split()) if p else 0) for p, m in members.items()}
    children = {}
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    total, leaves = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        for d in range(len(p) + 1):
            total[p[:d]] += saved[p]
            leaves[p[:d]] += p not in children
    return sorted((min(m), len(p), -1 if not p else min(members[p[:-1]]), len(m), children.get(p, 0), leaves[p], total[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items())


def found_trie(frame):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    rows = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(frame))).collect()
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_trie_equals_all_prefixes(spark, seed):
    rng, rows = random.Random(seed), []
    say = lambda k: (rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d\te  f"][: 1 + k]))
    for c in rng.sample(range(-60, 400), 120):
        kind = rng.random()
        turns = [("user", "hello there"), ("assistant", "x y z"), ("user", None)][: rng.randint(0, 3)] if kind < 0.7 else []
        turns = turns + [say(seed) for _ in range(rng.randint(0, 6))]
        if kind > 0.97:
            turns = [("user", "again")] * 60
        rows += [(c, t if t else None, *x) for t, x in enumerate(turns)]
    rows += [(None, 1, "user", "nobody's"), (7000, 2, "user", "twice"), (7000, 2, "user", "twice"), (7001, 1, None, None)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str((1, 4, 7, 13)[seed]))
        frame = spark.createDataFrame([(*r, "x", 1, b"k") for r in rows], "conv_id long, turn long, role string, text string, words string, n int, key binary")
        assert found_trie(frame) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_without_conversations(spark):
    assert found_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == []
    alone = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert found_trie(alone) == plain_trie([(1, 1, "user", "x")])


def test_queries_equal_their_sql(spark):
    import duckdb

    from tests.test_entry import DATA, TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name in ("op11_vector_codes", "op12_window_dedup", "op13_prefix_trie"):
        assert rows(queries.QUERIES[name](spark, str(DATA)).toPandas()) == rows(con.sql(queries.SQL[name]).df()), name
