"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm._common import pick, slices, texts, to_batch

#: Starting lexicon: words that count as abusive before anything is learnt.
SEEDS = ("idiot", "moron", "imbecile", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "dumbass", "asshole", "bitch", "bastard", "retard")
#: Phrases in which a lexicon word means no abuse.
EXCEPTIONS = ("trash can", "trash bin", "sore loser rule", "clown fish", "rodeo clown", "class clown", "idiot proof", "stupid question", "pathetic fallacy", "flame retard")
SEED_WEIGHT, DEFAULT_FIT = 4.0, (-3.0, 2.0, 0.2)
#: Learning: rows at most, least evidence (log-likelihood ratio in nats), least share of toxic documents.
SAMPLE_ROWS, LEAST_EVIDENCE, LEAST_RATE = 16_000, 14.0, 0.5
#: Letters of a word start that is learnt, and different toxic words that it must have: one word alone says nothing of its relatives.
PREFIXES, KINDRED = range(5, 9), 3

# Look-alikes: Cyrillic and Greek letters by the Latin letter that they resemble, digits and signs by the letter they stand for.
_LOOKS = {
    "a": "аα4@", "b": "вβ8", "c": "сϲ", "d": "ԁ", "e": "еєε3", "g": "ɡ9", "h": "һн", "i": "іιɩї1l|", "j": "ј", "k": "кκ", "m": "м", "n": "п", "o": "оοσ0", "p": "рρ", "q": "ԛ",
    "s": "ѕ5$", "t": "тτ7", "u": "υ", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ʐ2",
}


@lru_cache(1)
def _table() -> dict:
    table = {ord(x): a for a, xs in _LOOKS.items() for x in xs if x not in "@$|"}
    for ranges in ((0xC0, 0x250), (0x1E00, 0x1F00), (0xFF21, 0xFF5B)):  # accents and full-width letters, by their decomposition
        for code in range(*ranges):
            base = unicodedata.normalize("NFKD", chr(code))[0].lower()
            if base.isascii() and base.isalpha():
                table[code] = "i" if base == "l" else base
    for code in (*range(0x300, 0x370), 0xAD, *range(0x200B, 0x2010), 0xFEFF):  # combining marks and invisible characters
        table[code] = None
    return table


_SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
_INSIDE = re.compile(r"(?<=\w)[@$!|](?=\w)")
_GAPS = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Words of folded letters, one space between and around them."""
    text = text.lower()
    if any(x in text for x in _SIGNS):
        text = _INSIDE.sub(lambda m: _SIGNS[m[0]], text)
    words = _GAPS.sub(" ", text.translate(_table())).strip()
    return f" {words} " if words else " "


@dataclass(frozen=True)
class Model:
    """entries: pattern to weight (' word ' is a whole word, ' pref' the start of one); exceptions: phrases."""

    entries: dict
    exceptions: tuple
    fit: tuple

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, model: Model):
        self.fit, self.auto = model.fit, ahocorasick.Automaton()
        for phrase in model.exceptions:
            self.auto.add_word(fold(phrase), (len(fold(phrase)), None))
        for pattern, weight in model.entries.items():
            self.auto.add_word(pattern, (len(pattern), weight))
        self.any = len(self.auto) > 0
        if self.any:
            self.auto.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Weight by the place of the word hit, without what lies in an exception phrase."""
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if self.any:
            for end, (size, weight) in self.auto.iter(folded):
                start = end - size + 1
                if weight is None:
                    spared.append((start, end))
                elif weight > found.get(start, 0.0):
                    found[start] = weight
        for a, b in spared:
            for at in [x for x in found if a <= x < b]:
                del found[at]
        return found

    def measure(self, text: str) -> tuple[float, int, int]:
        """Sum of weights, hits, words."""
        folded = fold(text)
        found = self.hits(folded)
        return sum(found.values()), len(found), folded.count(" ") - 1

    def score(self, total: float, words: int) -> float:
        a, b, c = self.fit
        x = a + b * math.log1p(total) + c * math.log1p(100 * total / max(1, words))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def sample_of(labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most `most` labelled ids, those of the smallest hash; a row for each id (doc_id, y)."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    return rows.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, y: one row for each chosen id, however often documents has it (the smallest of its texts).

    chosen: doc_id, y, of a fixed number of rows. Repeated rows are folded before anything is shuffled.
    """
    found = pick(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def _families(batches):
    """Two smallest word digests of each document: near copies share them, so that a group of copies counts about once."""
    schema = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())])
    for part in slices(batches):
        found = []
        for text in texts(part):
            words = [w.encode() for w in set(fold(text).split())]
            found.append([min((xxhash.xxh3_64_intdigest(w, seed) for w in words), default=0) - (1 << 63) for seed in (1, 2)])
        yield to_batch(schema, {"doc_id": part.column(0), "f1": [a for a, _ in found], "f2": [b for _, b in found]})


def _patterns(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIXES if n < len(w))
    return out


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", seeds=SEEDS, exceptions=EXCEPTIONS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns weights from at most sample_rows labelled documents (a fixed bound; smallest id hashes).

    Near copies count once: else a word of one toxic text that was copied often would look toxic itself.
    Words of any length, and word starts that several different words of toxic texts have, are counted by toxic
    and other documents where the texts lie; all entries whose evidence passes the threshold come to the driver. Each of them stands in several toxic rows
    of the sample, so the sample's bound is theirs too, however large the corpus. Phrases around hits in
    documents that are not toxic become exceptions. The score's curve over the length-normalised sum is
    fitted by logistic regression on the sample. Without labels the seeds and a fixed curve hold.

    Null ids and labels teach nothing; of several labels of one id the larger counts, and of several texts the
    smallest, so an id is one row of the sample however often it is repeated. Null texts count as empty.
    Columns of any other name are not looked at.
    """
    spark = docs.sparkSession
    chosen = sample_of(labels, label_col, sample_rows)
    sampled = texts_of(docs, chosen, id_col, text_col)
    once = sampled.mapInArrow(_families, "doc_id long, f1 long, f2 long").groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    rows = sampled.join(F.broadcast(once), "doc_id", "left_semi").select("text", "y")  # sample_rows ids at most
    n, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    seeded = {f" {fold(w).strip()} ": SEED_WEIGHT for w in seeds}
    if not n or not toxic or toxic == n:
        return Model(seeded, tuple(exceptions), DEFAULT_FIT)
    base = toxic / n

    def count(batches):
        tox, all_ = Counter(), Counter()
        schema = pa.schema([("pattern", pa.string()), ("t", pa.int64()), ("n", pa.int64())])
        flush = lambda: to_batch(schema, {"pattern": list(all_), "t": [tox[k] for k in all_], "n": list(all_.values())})
        for part in slices(batches):
            for text, y in zip(texts(part), part.column(1).to_pylist()):
                found = _patterns(fold(text))
                all_.update(found)
                if y:
                    tox.update(found)
            if len(all_) > 400_000:
                yield flush()
                tox, all_ = Counter(), Counter()
        yield flush()

    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("t") / F.col("n")))
    evidence = F.col("t") * F.log(p / base) + (F.col("n") - F.col("t")) * F.log((1 - p) / (1 - base))
    counted = rows.mapInArrow(count, "pattern string, t long, n long").groupBy("pattern").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    # a start counts if several different words of toxic texts have it: one word alone says nothing of others
    whole = F.col("pattern").endswith(" ")
    each = F.array(*[F.when(F.char_length("pattern") > size + 2, F.substring("pattern", 1, size + 1)) for size in PREFIXES])
    kindred = counted.where(whole & (F.col("t") > 0)).select(F.explode(F.array_compact(each)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("words"))
    found = (
        counted.join(kindred, "pattern", "left").where(whole | (F.col("words") >= KINDRED)).where(F.col("t") / F.col("n") >= LEAST_RATE).withColumn("evidence", evidence).where(F.col("evidence") >= LEAST_EVIDENCE).collect()
    )
    odds = (n - toxic) / toxic
    learnt = {r["pattern"]: math.log((r["t"] + 0.5) / (r["n"] - r["t"] + 0.5) * odds) for r in found}
    starts = {k: w for k, w in learnt.items() if not k.endswith(" ")}
    entries = {k: w for k, w in (seeded | learnt).items() if w > 0 and not any(k[:m] in starts and k[:m] != k and starts[k[:m]] >= w - 0.5 for m in range(5, len(k)))}
    model = Model(entries, tuple(exceptions), DEFAULT_FIT)
    sent = spark.sparkContext.broadcast(model)

    def examine(batches):
        matcher = sent.value.matcher()
        schema = pa.schema([("y", pa.int32()), ("total", pa.float64()), ("words", pa.int64()), ("near", pa.list_(pa.string()))])
        for part in slices(batches):
            out = []
            for text, y in zip(texts(part), part.column(1).to_pylist()):
                folded = fold(text)
                hits = matcher.hits(folded)
                near = set()
                for at in hits:
                    before = folded[:at].rpartition(" ")[2] if at else ""
                    word, _, rest = folded[at + 1 :].partition(" ")
                    near |= {f"{before} {word}"} if before else set()
                    near |= {f"{word} {rest.partition(' ')[0]}"} if rest.strip() else set()
                out.append((y, sum(hits.values()), folded.count(" ") - 1, sorted(near)))
            yield to_batch(schema, {k: [x[i] for x in out] for i, k in enumerate(schema.names)})

    seen = rows.mapInArrow(examine, "y int, total double, words long, near array<string>")
    near = seen.select("y", F.explode("near").alias("phrase")).groupBy("phrase").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    learnt_exceptions = [r["phrase"] for r in near.where("n >= 4 and t <= n / 10").orderBy("phrase").collect()]
    points = seen.select("y", "total", "words").toPandas()  # sample_rows rows of three numbers at most
    return Model(entries, (*exceptions, *learnt_exceptions), _logistic(points))


def _logistic(points) -> tuple:
    total, y = points["total"].to_numpy(), points["y"].to_numpy().astype(float)
    x = np.stack([np.ones(len(y)), np.log1p(total), np.log1p(100 * total / np.maximum(1, points["words"].to_numpy()))], 1)
    w, ridge = np.array(DEFAULT_FIT), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ (w - np.array(DEFAULT_FIT)))
        w = w + np.clip(step, -2, 2)
    return tuple(float(v) for v in w)


RESULT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("weight", pa.float64()), ("n_hits", pa.int64()), ("n_words", pa.int64())])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), weight, n_hits, n_words of every row; no shuffle.

    Null or empty text: no hits, the score of a document without any. Repeated rows get equal results,
    null ids stay null, very long texts are matched whole, of several hits at one place the heaviest counts,
    other columns of any name are not looked at, an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # entries and exceptions of a sample of fixed size

    def run(batches):
        matcher = sent.value.matcher()
        for part in slices(batches):
            found = [matcher.measure(x) for x in texts(part)]
            yield to_batch(RESULT, {"doc_id": part.column(0), "score": [matcher.score(t, w) for t, _, w in found], "weight": [t for t, _, _ in found], "n_hits": [n for _, n, _ in found], "n_words": [w for _, _, w in found]})

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, weight double, n_hits long, n_words long")
