"""Quality classifier: nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm._common import pick, ship, slices, texts, to_batch
from pellucid.llm.toxicity import sample_of, texts_of

#: Labelled rows at most (a fixed bound of the training and of what is broadcast), latent dimensions, neighbours.
SAMPLE_ROWS, DIMS, NEIGHBOURS = 4_000, 64, 15
#: The vote's weight is similarity to this power.
SHARPNESS = 8
#: Terms: triples of character classes, then binned figures of the words and lines.
CLASSES, BINS = 16, 12
FIGURES = ("distinct", "top", "length", "lines", "upper", "short", "pair")
TERMS = CLASSES**3 + len(FIGURES) * BINS
FIGURE_WEIGHT = 6.0


def _classes() -> np.ndarray:
    table = np.full(256, 13, np.int32)  # other signs
    for i, group in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"AEIOU", b"BCDFGHJKLMNPQRSTVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".", b",;:", b"!?", b"#$%&*@", b"|", b"'\"()-")):
        table[list(group)] = i
    table[0xC0:] = 14
    table[0x80:0xC0] = 15
    return table


_TABLE = _classes()


def _bin(x: float) -> int:
    return min(BINS - 1, int(x * BINS))


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and weights of a text's terms; an empty text has only figures."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    c = _TABLE[raw]
    counts = np.bincount(c[:-2] * 256 + c[1:-1] * 16 + c[2:], minlength=CLASSES**3) if len(c) > 2 else np.zeros(CLASSES**3)
    at = np.flatnonzero(counts)
    words = text.split()
    n = max(1, len(words))
    lines = text.split("\n")
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    figures = (
        len(seen) / n ** 0.9 if n > 1 else 1.0, max(seen.values(), default=0) / n, np.log10(len(raw) + 1) / 7, len(set(lines)) / len(lines),
        float(np.count_nonzero((c == 2) | (c == 3))) / max(1, len(c)), sum(len(w) < 4 for w in words) / n, pairs,
    )
    own = [CLASSES**3 + i * BINS + _bin(float(x)) for i, x in enumerate(figures)]
    tf = np.log1p(counts[at]) / (np.log1p(len(raw)) or 1.0)
    return np.concatenate([at, own]).astype(np.int32), np.concatenate([tf, np.full(len(own), FIGURE_WEIGHT / len(own))]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """idf by term, projection (TERMS x DIMS), unit vectors of the labelled rows and their labels."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, texts_: list[str]) -> np.ndarray:
        dense = np.zeros((len(texts_), TERMS), np.float32)
        for i, t in enumerate(texts_):
            at, w = terms(t)
            dense[i, at] = w
        return _unit((dense * self.idf) @ self.projection)

    def score(self, texts_: list[str], block: int = 256) -> np.ndarray:
        """Exact cosine products with every labelled vector, block by block; the vote of the nearest."""
        out = np.full(len(texts_), 0.5)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(texts_), block):
            sims = self.embed(texts_[a : a + block]) @ self.vectors.T
            best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(sims, best, 1).astype(np.float64), 1e-6) ** SHARPNESS
            out[a : a + block] = (w * self.labels[best]).sum(1) / w.sum(1)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _svd(x: np.ndarray, dims: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    q = np.random.default_rng(7).standard_normal((x.shape[1], dims + 10)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :dims].astype(np.float32)


SPARSE = pa.schema([("y", pa.int32()), ("at", pa.list_(pa.int32())), ("w", pa.list_(pa.float32()))])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Latent-semantic vectors of at most sample_rows labelled documents (a fixed bound; smallest id hashes).

    Terms are made where the texts lie; their sparse weights come to the driver, where idf and the truncated
    singular value decomposition are computed. Without labels every score is one half. An id is one row of the
    sample however often it is repeated (the larger of its labels, the smallest of its texts); null ids and
    labels teach nothing; null texts count as empty, very long ones are read whole; other columns are not looked at.
    """
    rows = texts_of(docs, sample_of(labels, label_col, sample_rows), id_col, text_col).select("text", "y", "doc_id")

    def run(batches):
        for part in slices(batches):
            found = [terms(x) for x in texts(part)]
            yield to_batch(SPARSE, {"y": part.column(1), "at": [a for a, _ in found], "w": [w for _, w in found]})

    found = rows.orderBy("doc_id").mapInArrow(run, "y int, at array<int>, w array<float>").collect()  # sample_rows rows at most
    dense = np.zeros((len(found), TERMS), np.float32)
    for i, r in enumerate(found):
        dense[i, r["at"]] = r["w"]
    idf = np.log((1 + len(found)) / (1 + np.count_nonzero(dense, axis=0))).astype(np.float32) + 1
    y = np.array([r["y"] for r in found], np.float64)
    if not len(found):
        return Model(idf, np.zeros((TERMS, DIMS), np.float32), np.zeros((0, DIMS), np.float32), y)
    dense *= idf
    projection = _svd(dense, DIMS)
    return Model(idf, projection, _unit(dense @ projection), y)


RESULT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; no shuffle.

    Null text counts as empty; an empty text is scored from its figures. Repeated rows get equal results,
    null ids stay null, other columns are not looked at, an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed by SAMPLE_ROWS, TERMS and DIMS

    def run(batches):
        for part in slices(batches):
            yield to_batch(RESULT, {"doc_id": part.column(0), "score": sent.value.score(texts(part))})

    return pick(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: Model, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows that score at least `least`, with all their columns of whatever names; nothing is shuffled.

    Null and empty texts are scored like others (from their figures); repeated rows stay or go together; very
    long texts are scored whole; ties with `least` stay. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in slices(batches, text_col):
            yield part.filter(pa.array(sent.value.score(texts(part, text_col)) >= least))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
