"""The training-data operators against plain versions, at small size."""

import hashlib
import itertools
import json
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from pellucid.llm import byte_bpe, decontaminate, lm_scoring, mpeg_audio, ngram_join, sharding, suffix_dedup, toxicity
from pellucid.llm.line_dedup import dedup_lines
from pellucid.llm.quality import keep_quality, score_quality
from pellucid.llm.quality import train as train_quality
from pellucid.llm.sharding import kd_shards

WORDS = [f"{a}{b}{c}" for a in ("th", "an", "er", "ó", "lo") for b in ("a", "e", "in", "ß") for c in ("", "s", "t", "ng")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    """Documents with columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "x", 1, [1]) for i, t in rows], "doc_id long, text string, kept string, n long, h array<int>")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    line, rows = prose(rng, 12), []
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    for i in range(160):
        t = rng.choice(base)
        kind = rng.random()
        if kind < 0.3:
            words = t.split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            t = " ".join(words)
        elif kind < 0.5:
            t = f"{prose(rng, 8)}\n{line}\n{prose(rng, 20)}"
        elif kind < 0.6:
            t = "Und " * rng.randint(1, 90)
        rows.append((i * 3, t))
    rng.shuffle(rows)
    return [*rows, (1, None), (2, ""), (4, "x"), (5, " \n\t\n "), (7, prose(rng, 9000)), (8, line), (8, line), (None, line), (11, "the the the")]


def test_line_dedup(spark, corpus):
    got = dedup_lines(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in corpus:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(-1 if i is None else i)
    for r in got:
        lines = (r["text"] or "").split("\n")
        me = -1 if r["doc_id"] is None else r["doc_id"]
        stay = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == me]
        assert (r["n_lines"], r["n_dropped"], r["kept"]) == (len(lines), len(lines) - len(stay), "\n".join(stay))
    assert any(r["n_dropped"] for r in got)


def test_kd_shards(spark, corpus):
    rows = kd_shards(frame(spark, corpus * 4), 6).collect()
    assert len(rows) == 4 * len(corpus)
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) <= set(range(6)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 16 for _, t in corpus) * 4
    assert {r["text_crc32"] for r in rows} == {zlib.crc32((t or "").encode()) for _, t in corpus}


def test_kd_shards_are_even_and_split_heavy_groups(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(20, 200))) for i in range(3000)] + [(10_000 + i, "same text " * 60) for i in range(1500)]
    sizes = Counter()
    for r in kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect():
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_kd_tree_equals_a_plain_one(spark):
    """The tree grown from refined histograms against recursion over sorted lists."""
    rng = random.Random(14)
    units = [(i, i, 0, float(rng.choice((16, 40, 300, 5000))), rng.random(), rng.random() ** 3, rng.random() * 0.9) for i in range(400)]
    n_shards = 11

    def plain(rows, first, k):
        if k == 1 or not rows:
            return dict.fromkeys((r[0] for r in rows), first)
        dim = max(range(3), key=lambda i: max(r[4 + i] for r in rows) - min(r[4 + i] for r in rows))
        rows = sorted(rows, key=lambda r: r[4 + dim])
        target, at = sum(r[3] for r in rows) * (k // 2) / k, 0
        while at < len(rows) - 1 and rows[at][3] < target:
            target -= rows[at][3]
            at += 1
        at += target >= rows[at][3] / 2  # the row over which the share runs out goes where it fits better
        return plain(rows[:at], first, k // 2) | plain(rows[at:], first + k // 2, k - k // 2)

    frame_ = spark.createDataFrame(units, "h1 long, h2 long, part int, weight double, d0 double, d1 double, d2 double")
    tree = sharding._grow(frame_, n_shards)
    got = {r["h1"]: r["shard"] for r in frame_.select("h1", sharding._place(tree, 0, n_shards).alias("shard")).collect()}
    assert got == plain(units, 0, n_shards)


def test_mpeg_round_trip():
    for text in ("", "a", "é" * 1000, "\x00\xff\xfb" * 300, "x" * 192):
        n, media = mpeg_audio.media_of(text)
        s = mpeg_audio.read_mpeg(media)
        raw = text.encode()
        assert n == len(raw) and s.payload == raw + b" " * (-len(raw) % 192 if raw else 192)
        assert s.bad_checksums == s.skipped == 0 and s.duration == (s.frames * 1152 // math.gcd(s.frames * 1152, 48000), 48000 // math.gcd(s.frames * 1152, 48000))
        assert s.xing["frames"] == s.frames and all(mpeg_audio.parse_header(media[o : o + 4]) for o in s.offsets)


def test_mpeg_damage():
    _, media = mpeg_audio.media_of("hello " * 400)
    whole = mpeg_audio.read_mpeg(media)
    at = whole.offsets[3]
    junk = mpeg_audio.read_mpeg(media[:at] + b"\xff\x00junk\xff\xfb" + media[at:])
    assert junk.frames == whole.frames and junk.payload == whole.payload and junk.skipped == 8
    bad = bytearray(media)
    bad[at + 4] ^= 1
    assert mpeg_audio.read_mpeg(bytes(bad)).bad_checksums == 1
    cut = mpeg_audio.read_mpeg(media[: whole.offsets[-1] + 10])
    assert cut.frames == whole.frames - 1 and whole.seek(0) == whole.offsets[0]
    assert mpeg_audio.read_mpeg(b"").frames == mpeg_audio.read_mpeg(b"\xff" * 999).frames == 0
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7  # the published check value of this CRC


def plain_crc(bits):
    crc = 0xFFFF
    for b in bits:
        top = crc >> 15 ^ int(b)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return crc


def protected(header, body, covered):
    """A frame whose checksum covers the first bits of its body."""
    bits = "".join(f"{b:08b}" for b in header[2:4] + body)[: 16 + covered]
    size = mpeg_audio.parse_header(header).size
    return (header + plain_crc(bits).to_bytes(2, "big") + body).ljust(size, b"\x55")


@pytest.mark.parametrize("header, body, covered", [
    (b"\xff\xfe\x90\xc0", "1" * 128, 128),  # Layer I, mono
    (b"\xff\xfe\x90\x00", "10" * 128, 256),  # Layer I, stereo
    (b"\xff\xfe\x90\x50", "10" * 80, 160),  # Layer I, joint from subband 8
    (b"\xff\xfc\x90\xc0", "0001" + "1111" + "0" * 86 + "0110", 98),  # Layer II, mono, 160 kbit/s at 44.1 kHz: 30 subbands
    (b"\xff\xfc\x20\xc0", "0001" + "0" * 22 + "01", 28),  # mono, 48 kbit/s at 44.1 kHz: 8 subbands
    (b"\xff\xfc\xa4\x00", "0" * 4 + "1" * 4 + "0" * 168 + "11", 178),  # stereo, 192 kbit/s at 48 kHz: 27 subbands
    (b"\xff\xfc\xa4\x40", "0" * 32 + "0001" + "0" * 68 + "0011", 108),  # joint from subband 4: both channels' scfsi
    (b"\xff\xf4\x80\xc0", "0" * 75 + "", 75),  # MPEG-2 Layer II, mono
])
def test_mpeg_checksums_of_all_layers(header, body, covered):
    bits = body + "01" * 40
    body = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
    sound = protected(header, body, covered)
    read = lambda at: mpeg_audio.read_mpeg(sound + bytes(b ^ (1 << 7 - at % 8 if i == 6 + at // 8 else 0) for i, b in enumerate(sound)) + sound)
    assert mpeg_audio.read_mpeg(sound * 3).bad_checksums == 0 and read(covered).bad_checksums == 0
    for at in range(covered):
        assert (read(at).bad_checksums, read(at).bad_frames, read(at).frames) == (1, [1], 3), at


def test_mpeg_vbri(spark):
    frame_of = lambda body: b"\xff\xfb\x90\x00" + body.ljust(413, b"\x00")
    table = bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4 * 417, 3, 2, 10, 2, 2) + struct.pack(">HH", 83, 42)
    media = frame_of(table) + frame_of(b"") * 3
    s = mpeg_audio.read_mpeg(media)
    assert (s.frames, s.samples, s.offsets, s.xing) == (3, 3 * 1152, [417, 834, 1251], None)
    assert s.vbri == {"frames": 3, "bytes": 1668, "frames_each": 2, "stretches": [830, 420]}
    row = mpeg_audio.read_media(spark.createDataFrame([(1, 0, media)], "doc_id long, n_bytes long, media binary")).first()
    assert row["vbri"].asDict() == s.vbri and json.loads(row["feature"])["vbr_frames"] == 3 and row["bad_frames"] == []


def test_mpeg_headers_of_other_kinds():
    sizes = {b"\xff\xfb\x90\x00": (417, 1152), b"\xff\xfd\x90\x00": (522, 1152), b"\xff\xff\x90\x00": (312, 384), b"\xff\xf3\x80\x00": (208, 576)}
    for raw, (size, samples) in sizes.items():
        h = mpeg_audio.parse_header(raw)
        assert (h.size, h.samples) == (size, samples), raw


def test_media_columns(spark, corpus):
    rows = mpeg_audio.read_media(mpeg_audio.encode_media(frame(spark, corpus))).collect()
    want = Counter((i, len((t or "").encode()), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-16:])) for i, t in corpus for x in [(t or "").encode() + b" " * (-len((t or "").encode()) % 192 if t else 192)])
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert all(json.loads(r["feature"])["frames"] == r["n_frames"] == r["payload_bytes"] // 192 for r in rows)


def test_media_keeps_what_the_reader_finds(spark, corpus):
    made = {(r["doc_id"], r["media"]) for r in mpeg_audio.encode_media(frame(spark, corpus)).collect()}
    rows = mpeg_audio.read_media(mpeg_audio.encode_media(frame(spark, corpus))).collect()
    assert any(len(r["offsets"]) > 4 for r in rows) and {(r["doc_id"], r["media"]) for r in rows} == made
    for r in rows:
        s = mpeg_audio.read_mpeg(bytes(r["media"]))
        assert (r["offsets"], r["tags"], bytes(r["payload"]), r["kbps"]) == (s.offsets, s.tags, s.payload, s.kbps)
        assert all(mpeg_audio.parse_header(bytes(r["media"][o : o + 4])) for o in r["offsets"])
        assert (r["duration_num"], r["duration_den"]) == s.duration and r["xing"].asDict() == s.xing
        f = json.loads(r["feature"])
        assert f["seek"] == [s.offsets[len(s.offsets) * i // 4] for i in range(4)] and f["kbps"] == {str(k): v for k, v in s.kbps.items()}
        assert f["offsets_md5"] == hashlib.md5(b"".join(o.to_bytes(8, "little") for o in s.offsets)).hexdigest()
    empty = mpeg_audio.read_media(spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")).first()
    assert (empty["offsets"], empty["xing"], empty["media_bytes"], json.loads(empty["feature"])["seek"]) == ([], None, 0, [])


@pytest.fixture(scope="module")
def reference_encoder():
    import public_tokenizers
    import tiktoken

    codec = byte_bpe.default_codec()
    return codec, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.vocabulary.ranks, special_tokens={})


def test_byte_bpe_equals_tiktoken(reference_encoder):
    codec, other = reference_encoder
    rng = random.Random(1)
    alphabet = ["a", "e", "th", "ing", " ", "  ", "\n", "'s", "0", "19", "é", "日本", "ω", "!", "\x1c", " ", "́", "😀", "<|endoftext|>"]
    for text in ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "z" * 5000, " " * 300]:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_byte_bpe_appends_and_edits(reference_encoder):
    codec, _ = reference_encoder
    rng, v = random.Random(4), reference_encoder[0].vocabulary
    buffer = byte_bpe.PieceBuffer(v)
    for _ in range(300):
        more = bytes(rng.choice(b"abethinos ") for _ in range(rng.randint(0, 4)))
        if rng.random() < 0.6:
            buffer.append(more)
        else:
            a = rng.randint(0, len(buffer.piece))
            buffer.splice(a, min(len(buffer.piece), a + rng.randint(0, 5)), more)
        assert buffer.ids == v.encode_piece(buffer.piece)
        assert buffer.piece in v.ranks or buffer.ids == byte_bpe.merge(buffer.piece, v.ranks)


def test_byte_bpe_frames(spark, corpus):
    docs = frame(spark, corpus)
    rows = byte_bpe.roundtrip(docs).collect()
    want = Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in corpus)
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in rows) == want
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(docs)).collect()
    assert Counter((r["doc_id"], hashlib.sha256(r["data"]).hexdigest()) for r in back) == want


def plain_components(corpus, n, low, high):
    sets = {}
    for i, t in corpus:
        if i is not None:
            w = (t or "").encode().lower().split()
            k = min(n, len(w))
            sets.setdefault(i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if sets[i]]
    for a in ids:
        for b in ids:
            if a < b and high * len(sets[a] & sets[b]) >= low * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "share", "low", "small"), [(4, 0.85, 85, False), (5, 0.8, 80, True)])
def test_ngram_components(spark, corpus, n, share, low, small, monkeypatch):
    if small:  # groups of a document or two, each asked in several tasks; classes apart from two members on
        for name, value in (("GROUP_TOKENS", 100), ("ASKING", 2), ("CLASS", 2), ("REMEMBERED", 3)):
            monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(n)
    family = [(5000 + i, t) for i, t in enumerate(drift_family(rng))] + [(6000 + i, t) for i, t in enumerate(cloud(rng))]
    rows = ngram_join.ngram_components(frame(spark, corpus + family), n, share).collect()
    want = plain_components(corpus + family, n, low, 100)
    assert len(rows) == len(corpus) + len(family)
    for r in rows:
        assert r["doc_id"] is None and r["component_id"] is None or (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    kept = ngram_join.keep_one(frame(spark, corpus).withColumn("copy", ngram_join.F.lit(1)), n, share).collect()
    plain = plain_components(corpus, n, low, 100)
    assert sorted(repr(r["doc_id"]) for r in kept) == sorted(repr(i) for i, _ in corpus if i is None or plain[i][1] == i)


def test_ngram_rows_of_one_id_link_by_their_own_texts(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z"), (2, "u v w x y z"), (4, "a b")]
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(frame(spark, rows), 4, 0.85).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (2, 2), (3, 2), (4, 4)]
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(frame(spark, rows), 4, 0.85).collect()) == [1, 2, 2, 2, 4]


def cloud(rng):
    """Documents that share a long passage, some of which link and some of which do not."""
    passage = prose(rng, 80)
    for _ in range(50):
        yield f"{passage} {prose(rng, rng.randint(1, 25))}"


def drift_family(rng):
    """A chain of copies, each edited from the last: neighbours link, ends do not; and copies that stay under the bound."""
    words = prose(rng, 150).split()
    for _ in range(60):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + rng.choice(WORDS)
        yield " ".join(words)


def test_first_places_bring_every_link_together():
    rng = np.random.default_rng(3)
    share, crowds = ngram_join.Fraction(85, 100), rng.integers(0, 5, ngram_join.BUCKETS)
    linked = 0
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[int(len(a) * rng.uniform(0, 0.16)) :], rng.integers(0, 2**63, int(n * rng.uniform(0, 0.1))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 85 * (len(a) + len(b) - common):
            linked += 1
            assert np.intersect1d(ngram_join.first_places(a, crowds, share), ngram_join.first_places(b, crowds, share)).size >= 1
    assert linked > 50


def plain_repeats(docs):
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - 99):
            if b[a : a + 100] in seen:
                gone[a : a + 100] = b"\x01" * 100
            seen.add(b[a : a + 100])
        out[i] = bytes(x for x, g in zip(b, gone) if not g), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_remove_repeats(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_UNITS", hot)
    docs = dict((i, t) for i, t in corpus if i is not None) | {900: "ab" * 400, 901: "x" * 99, 902: "x" * 100, 903: "x" * 101, 904: "abcde" * 25}
    rows = suffix_dedup.remove_repeats(frame(spark, list(docs.items()) + [(900, "ab" * 400)])).collect()
    want = plain_repeats(docs)
    assert len(rows) == len(docs) + 1
    for r in rows:
        kept, spans = want[r["doc_id"]]
        assert (bytes(r["kept"]), len(r["spans"])) == (kept, spans), r["doc_id"]


def test_remove_repeats_of_rows_that_share_an_id(spark):
    rng = random.Random(12)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(300))
    a, b, c = text(), text(), text()
    rows = [(7, a), (7, b + a), (7, a), (None, c), (9, c), (9, "x")]
    got = Counter((r["doc_id"], bytes(r["kept"]), r["n_bytes"]) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect())
    one = {(7, a.encode(), 300): 2, (7, b.encode(), 600): 1}  # whichever of the two texts of id 7 comes first
    other = {(7, b"", 300): 2, (7, (b + a).encode(), 600): 1}
    rest = {(None, c.encode(), 300): 1, (9, b"", 300): 1, (9, b"x", 1): 1}
    assert got in (Counter(one | rest), Counter(other | rest))


def test_suffix_ranks():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randint(1, rng.choice((1, 2, 200))) for _ in range(rng.randint(0, 50))]
        order = sorted(range(len(s)), key=lambda i: s[i:])
        assert np.argsort(suffix_dedup.suffix_ranks(np.array(s, np.int64))).tolist() == order
        bounded = np.argsort(suffix_dedup.suffix_ranks(np.array(s, np.int64), 9))
        assert [s[i : i + 9] for i in bounded] == [s[i : i + 9] for i in order]


def test_smith_waterman():
    a = lambda x: np.array([ord(c) for c in x])
    assert decontaminate.smith_waterman(a("abcdef"), a("zzabcdefzz")) == (6, 2, 8)
    assert decontaminate.smith_waterman(a("abcdef"), a("abcxdef"))[0] == 5
    assert decontaminate.smith_waterman(a("abcdef"), a("abdef"))[0] == 4
    assert decontaminate.smith_waterman(a("abc"), a("xyz"))[0] == 0


def test_leaks_are_found_and_clean_documents_left(spark):
    rng = random.Random(9)
    unique = lambda n: [f"{rng.choice(WORDS)}{rng.choice(WORDS)}{rng.randint(0, 99)}" for _ in range(n)]
    items = [(i, unique(30)) for i in range(12)] + [(99, unique(2))]
    rows, want = [], set()
    for k in range(120):
        body, item = unique(200), rng.choice(items[:12])
        if k % 3 == 0:
            copy = list(item[1])
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = "edited"
            body[50:50] = copy
            want.add((k, item[0]))
        elif k % 3 == 1:
            body[20:20] = item[1][:6]
        rows.append((k, "  ".join(w.upper() if rng.random() < 0.1 else w for w in body) + "."))
    rows += [(500, None), (501, ""), (502, " ".join(items[0][1])), (502, " ".join(items[0][1]))]
    want.add((502, 0))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(100, None), (None, "")], "item_id long, text string")
    docs = frame(spark, rows)
    found = decontaminate.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert all(0.5 <= r["share"] <= 1 and r["start_char"] < r["end_char"] for r in found)
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in rows if i not in {d for d, _ in want})


def test_decontaminate_edited_copies_of_common_items(spark):
    """Items whose own copies make all their words common: edited copies are found as the full alignment finds them."""
    rng = random.Random(9)
    items = {i: [f"w{i}x{k}" for k in range(17)] for i in range(2)}
    rows = [(n, " ".join(items[n % 2])) for n in range(60)]
    rows += [(100, " ".join("zz" if k == 2 else w for k, w in enumerate(items[0])))]
    rows += [(101, " ".join(w if k % 2 else f"{w} zz" if k else w for k, w in enumerate(items[0])))]
    rows += [(102, " ".join(x for k, w in enumerate(items[1]) for x in ([w, "zz"] if k % 2 else [w])))]  # inserted after each two words
    for n in range(150):
        own, out = items[n % 2], []
        for w in own:
            out += {0: [], 1: ["zz"], 2: [w, "zz"]}.get(rng.randrange(7), [w])
        rows.append((200 + n, " ".join(["zz"] * rng.randrange(9) + out)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id long, text string")
    number = {w: k for k, w in enumerate(sorted({w for _, t in rows for w in t.split()}))}
    at = lambda ws: np.array([number[w] for w in ws], np.int64)
    scores = {(n, i): decontaminate.smith_waterman(at(ws), at(t.split()))[0] for n, t in rows for i, ws in items.items()}
    want = {k: s / 17 for k, s in scores.items() if s >= 8.5}
    got = {(r["doc_id"], r["item_id"]): r["share"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == want and {(100, 0), (102, 1)} <= got.keys() and 60 < len(got) < len(rows)



def test_lm_scores(spark, corpus, monkeypatch):
    """Scores against sums over all segmentations, kinds and documents, with fixed weights of the pieces."""
    found, _ = lm_scoring.pieces("piece_bpe_32k.model")
    p = np.random.default_rng(2).random((2, len(found))) ** 8
    p, weights = p / p.sum(1, keepdims=True), np.log([0.3, 0.7])
    monkeypatch.setattr(lm_scoring, "_estimate", lambda words, path, kinds: (p, weights))
    rows = [(i, t) for i, t in corpus if i is not None and i != 8 and len(t or "") < 3000] + [(70_000, "same text ß"), (70_000, "same text ß"), (70_001, "x" * 40)]
    got = {}
    for r in lm_scoring.score_texts(frame(spark, rows), kinds=2).collect():
        got.setdefault(r["doc_id"], []).append(r)
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    words = [(i, (t or "").encode().lower().split()) for i, t in rows]
    c = Counter(w for i, ws in words if not held[i] for w in [*ws, b""])
    total, v = sum(c.values()), len(c)
    share, at = [dict(zip(found, q)) for q in p], {}

    def inner(word):
        if word not in at:
            at[word] = [sum_long(q, b" " + word) for q in share]
        return at[word]

    once, twice = sum(n == 1 for w, n in c.items() if w), sum(n == 2 for w, n in c.items() if w)
    discount, end = once / (once + 2 * twice), c[b""] / total
    split = {w: [math.exp(weights[k]) * x / sum(math.exp(weights[m]) * y for m, y in enumerate(inner(w))) for k, x in enumerate(inner(w))] for w in c if w}
    n_of = [sum(c[w] * r[k] for w, r in split.items()) for k in (0, 1)]
    r_of = [sum(r[k] for r in split.values()) for k in (0, 1)]

    def word(w, k):
        whole = (c[w] - discount) * split[w][k] / n_of[k] if w in split else 0.0
        return (1 - end) * (whole + discount * r_of[k] / n_of[k] * inner(w)[k])

    for i, ws in words:
        assert len(got[i]) == (2 if i == 70_000 else 1)
        for r in got[i]:
            base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (v + 1))) for w in [*ws, b""])
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws) + 1, sum(c[w] > 0 for w in [*ws, b""]), total)
            logs = [math.log(n_of[k] + 1) - math.log(sum(n_of) + 2) + math.log(end) + sum(math.log(word(w, k)) for w in ws) for k in (0, 1)]
            assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(np.logaddexp(*logs) / math.log(10), rel=1e-5), i
            assert r["piece_score"] < 0 and r["cached_score"] < 0


def test_lm_words_are_a_distribution():
    """All words over two letters: their probabilities approach one, known words and new ones together."""
    found, p = (b" ", b" a", b"a", b"b", b"ab"), np.array([[0.2, 0.3, 0.2, 0.2, 0.1], [0.3, 0.2, 0.1, 0.3, 0.1]])
    words = [bytes(x) for n in range(13) for x in itertools.product(b"ab", repeat=n)]
    weights = np.log([0.4, 0.6])
    inner = lm_scoring.Lattice(found, p).score(words)
    assert np.all(np.exp(inner).sum(0) <= 1 + 1e-9) and np.all(np.exp(inner).sum(0) > 0.95)
    c = np.zeros(len(words))
    c[[1, 2, 5, 40]] = 7, 1, 2, 1
    own = np.exp(lm_scoring._normal(inner + weights))
    model = lm_scoring.Mixture(13, 5, 2, 0.6, weights, (c[:, None] * own).sum(0), own[c > 0].sum(0))
    chance = np.exp(model.words(c, inner, np.zeros(len(words), bool)))
    assert np.all(chance.sum(0) + model.end <= 1 + 1e-9) and np.all(chance.sum(0) + model.end > 0.97)
    assert np.exp(model.kinds).sum() == pytest.approx(1)


def test_lattice_sums_all_segmentations():
    found = (b"a", b"b", b"ab", b"ba", b" ", b" a", b"bab")
    p = np.stack([np.arange(1, 8) / 28, np.arange(7, 0, -1) / 28])
    lattice = lm_scoring.Lattice(found, p)

    def plain(prob, word):
        return 1.0 if not word else sum(prob[x] * plain(prob, word[len(x) :]) for x in found if word.startswith(x))

    words = [b"a", b"ab", b"abab", b"bbbb", b"babab", b"ab" * 40, b"b" * 200]
    weights, counts, shares = np.log([0.5, 0.5]), np.zeros(p.shape), np.zeros(2)
    got = lattice.score(words[:5], weights, counts, shares)
    want = np.array([[plain(dict(zip(found, q)), b" " + w) for q in p] for w in words[:5]])
    assert np.exp(got) == pytest.approx(want) and shares == pytest.approx((want / want.sum(1, keepdims=True)).sum(0))
    assert sum(len(x) * n for x, n in zip(found, counts.sum(0))) == pytest.approx(sum(len(w) + 1 for w in words[:5]))
    for w in words[5:]:
        assert np.exp(lattice.score([w])[0]) == pytest.approx([sum_long(dict(zip(found, q)), b" " + w) for q in p])


def test_lm_learns_kinds_and_beats_the_base(spark):
    rng = random.Random(3)
    tongues = [[a + b for a in x for b in y] for x, y in (("bdg", "aeo"), ("klm", "iuy"), ("prs", "äöü"))]
    rows = [(i, " ".join("".join(rng.choice(rng_t) for _ in range(rng.randint(1, 3))) for _ in range(60))) for i in range(500) for rng_t in [tongues[i % 3]]]
    found = [r for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert len(found) > 30 and sum(r["score"] for r in found) > 0.95 * sum(r["base_score"] for r in found) and all(r["score"] > r["piece_score"] for r in found)


def test_lm_kinds_are_drawn_apart_on_all_training_words(spark, monkeypatch):
    """The rounds go through disjoint shares that hold every training word; then all words together."""
    monkeypatch.setattr(lm_scoring, "SHARE_WORDS", 10)
    taken = []

    def expected(words, path, p, weights):
        taken.append([bytes(r["word"]) for r in words.collect()])
        return np.ones(p.shape), np.ones(len(p))

    monkeypatch.setattr(lm_scoring, "_expected", expected)
    rows = [(f"w{i}".encode(), 1) for i in range(400)] + [(b"held", 0), (b"", 9)]
    p, weights = lm_scoring._estimate(spark.createDataFrame(rows, "word binary, c long"), "piece_bpe_32k.model", 4)
    every = sorted(w for w, c in rows if c and w)
    assert len(taken) == lm_scoring.START_ROUNDS + 1 and sorted(taken[-1]) == every
    assert sorted(w for share in taken[:-1] for w in share) == every and all(taken)
    assert p.sum(1) == pytest.approx(np.ones(4)) and np.exp(weights).sum() == pytest.approx(1)
    taken.clear()
    lm_scoring._estimate(spark.createDataFrame(rows[:15], "word binary, c long"), "piece_bpe_32k.model", 4)
    assert all(len(share) == 15 for share in taken)


def test_lattice_keeps_chances_below_a_double():
    found, p = (b" ", b"a", b"b"), np.array([[0.5, 1e-10, 0.5], [0.2, 0.4, 0.4]])
    lattice, words = lm_scoring.Lattice(found, p), [b"a" * 40, b"b" * 40, b"a" * 20 + b"b" * 20]
    weights, counts, shares = np.log([0.5, 0.5]), np.zeros(p.shape), np.zeros(2)
    got = lattice.score(words, weights, counts, shares)
    want = np.array([[math.log(q[0]) + w.count(b"a") * math.log(q[1]) + w.count(b"b") * math.log(q[2]) for q in p] for w in words])
    own = np.exp(lm_scoring._normal(want + weights))
    assert got == pytest.approx(want) and shares == pytest.approx(own.sum(0))
    assert counts == pytest.approx(np.stack([own.T @ [x.count(b) for x in (b" " + w for w in words)] for b in found], axis=1))


def sum_long(prob, word):
    longest = max(map(len, prob))
    a = [1.0] + [0.0] * len(word)
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + longest) + 1):
            if word[i:j] in prob:
                a[j] += a[i] * prob[word[i:j]]
    return a[-1]


def test_compound_is_a_distribution():
    logp, total = np.log([0.5, 0.3, 0.2]), 0.0
    for i in range(3):
        for j in range(3):
            tf = np.bincount([i, j], minlength=3)
            total += math.exp(lm_scoring.compound(logp[tf > 0], tf[tf > 0], 4.0))
    assert total == pytest.approx(1.0)
    long = lm_scoring.compound(logp, np.array([40, 2, 1]), 4.0)
    assert long == pytest.approx(sum(math.lgamma(4 * q + n) - math.lgamma(4 * q) for q, n in ((0.5, 40), (0.3, 2), (0.2, 1))) - math.lgamma(47) + math.lgamma(4))


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T!") == " idiot " == toxicity.fold("ïdіоt")
    model = toxicity.Model({" idiot ": 3.0, " vequ": 2.0}, ("idiot proof",), toxicity.DEFAULT_FIT)
    m = model.matcher()
    assert m.measure("You 1d10t, vequoir")[:2] == (5.0, 2) and m.measure("it is idiot-proof")[:2] == (0, 0) and m.measure("idiotic")[:2] == (0, 0)
    assert m.measure("")[2] == 0 and 0 <= m.score(0, 0) < m.score(5, 10) <= 1


def test_learnt_scores(spark):
    rng = random.Random(8)
    docs, toxic, quality = [], [], []
    for i in range(600):
        bad, junk = rng.random() < 0.3, rng.random() < 0.3
        words = prose(rng, rng.randint(15, 60)).split()
        for _ in range(3 if bad else 0):
            words[rng.randrange(len(words))] = "zorg" + rng.choice(["ulo", "ane", "ix", "opt", "um"])
        text = " ".join(f"{w.upper()}!!" for w in words) if junk else ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, len(words), 9)) + "."
        docs.append((i, text)), toxic.append((i, int(bad))), quality.append((i, int(not junk)))
    table = frame(spark, [*docs, (None, None), (601, "")])
    labels = spark.createDataFrame([(a, b, c) for (a, b), (_, c) in zip(toxic, quality)] + [(None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    tox = toxicity.score_toxicity(table, toxicity.train(table, labels.where("doc_id % 5 <> 0"))).collect()
    held = [(r["score"] >= 0.5, dict(toxic)[r["doc_id"]]) for r in tox if r["doc_id"] is not None and r["doc_id"] % 5 == 0 and r["doc_id"] < 600]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and len(tox) == 602
    model = train_quality(table, labels.where("doc_id % 5 <> 0"))
    scores = {r["doc_id"]: r["score"] for r in score_quality(table, model).collect()}
    assert sum((scores[i] >= 0.7) == y for i, y in quality if i % 5 == 0) >= 0.95 * 120
    kept = keep_quality(table, model)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.7}
    again = labels.crossJoin(spark.range(3)).drop("id")  # an id that stands often is one row of the sample all the same
    assert len(train_quality(table.union(table), again, sample_rows=7).labels) == 7
    twice = toxicity.train(table.union(table), again.where("doc_id % 5 <> 0"))
    assert twice.entries == toxicity.train(table, labels.where("doc_id % 5 <> 0")).entries
    none = labels.limit(0)
    assert toxicity.train(table, none).fit == toxicity.DEFAULT_FIT and score_quality(table, train_quality(table, none)).first()["score"] == 0.5


def test_empty_tables(spark):
    empty = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for out in (
        dedup_lines(empty), kd_shards(empty, 4), byte_bpe.roundtrip(empty), mpeg_audio.encode_media(empty), suffix_dedup.remove_repeats(empty), ngram_join.ngram_components(empty), lm_scoring.score_texts(empty),
        decontaminate.find_leaks(empty, bench), toxicity.score_toxicity(empty, toxicity.train(empty, labels)), score_quality(empty, train_quality(empty, labels)),
    ):
        assert out.count() == 0


def test_decontamination_takes_items_of_any_size(spark):
    rng = random.Random(8)
    giant = " ".join(f"w{i}" for i in range(2_200_000))
    many = [(i, prose(rng, rng.randint(3, 9))) for i in range(10, 3_010)]
    leak = prose(rng, 30)
    docs = spark.createDataFrame([(1, "w1 w2 w3 w4 and nothing more of it"), (2, f"{prose(rng, 20)} {leak} {prose(rng, 5)}"), (3, None), (4, " ".join(f"w{i}" for i in range(500, 900)))], "doc_id long, text string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame([(1, giant), (2, leak)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(2, 2)}
    some = decontaminate.find_leaks(docs, spark.createDataFrame([*many, (2, leak)], "item_id long, text string")).collect()
    assert (2, 2) in {(r["doc_id"], r["item_id"]) for r in some}
    words = np.array([0, 1, 2, 0, 1, 2, -1, 2**22, 5])
    keys = decontaminate.seed_keys(words)
    assert keys[0] == keys[3] != keys[1] and (keys[4:7] == -1).all() and len(decontaminate.seed_keys(words, 2)) == 8


def test_a_word_start_needs_several_toxic_words(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("bdfgklmnprt") + rng.choice("aeiou") for _ in range(3)) for _ in range(4_000)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    stems = [f"zorg{a}{b}" for a in "aeiou" for b in ("n", "lo", "st", "rim")]
    rows = [(i, f"{say(30)} {'pathetic' if i % 4 == 1 else rng.choice(stems) if i % 4 == 0 else ''} {say(20)}", int(i % 4 in (0, 1))) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    starts = [k for k in model.entries if not k.endswith(" ")]
    assert starts and all(k.startswith(" zorg") for k in starts) and " pathetic " in model.entries
    said = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame([(1, "We walked along the path through the wood."), (2, "worthwhile work for everyone"), (3, f"{say(9)} zorgaximon {say(9)}"), (4, f"{say(9)} p4thetic")], "doc_id long, text string"), model).collect()}
    assert said[1] < 0.5 and said[2] < 0.5 and said[3] >= 0.5 and said[4] >= 0.5
    # the learnt weights, from plain counts of one document for each text
    t, n = sum(y for _, x, y in rows if "pathetic" in x), sum("pathetic" in x for _, x, _ in rows)
    toxic = sum(y for *_, y in rows)
    assert model.entries[" pathetic "] == pytest.approx(math.log((t + 0.5) / (n - t + 0.5) * (len(rows) - toxic) / toxic), rel=0.2)


@pytest.mark.parametrize("rounds", [0, 1])
def test_a_string_in_many_surroundings_is_settled_in_a_stream(spark, monkeypatch, rounds):
    rng = random.Random(rounds)
    common = prose(rng, 30)
    rows = [(i, f"{prose(rng, 25)} {common[rng.randint(0, 9) :]} {prose(rng, 25)}") for i in range(120)] + [(500, "ab" * 150), (501, common), (502, None)]
    monkeypatch.setattr(suffix_dedup, "HOT_UNITS", 8)
    monkeypatch.setattr(suffix_dedup, "ROUNDS", rounds)
    want = plain_repeats(dict(rows))
    found = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert {r["doc_id"]: (bytes(r["kept"]), len(r["spans"])) for r in found} == want
    assert sum(len(r["spans"]) for r in found) >= 120
