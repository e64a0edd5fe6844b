"""Seeds, hash ranks and intervals of samples."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 2_147_483_647
Z95 = 1.959963984540054
_DOMAIN = b"pellucid.sample.v1"


def _framed(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "big") + p for p in parts)


def check_seed(seed: int | str, graph_fingerprint: str, suite_sha: str, check_id: str) -> int:
    """One seed for each check: any change of seed (or its type), graph, suite or check gives another."""
    named = (graph_fingerprint, suite_sha, check_id)
    if isinstance(seed, bool) or not isinstance(seed, (int, str)) or not all(isinstance(x, str) and x.strip() for x in named):
        raise ValueError("a seed is an int or a string; fingerprint, suite and check are named")
    tagged = f"{type(seed).__name__}:{seed}"
    return int.from_bytes(hashlib.sha256(_DOMAIN + _framed(*(x.encode() for x in (tagged, *named)))).digest(), "big")


def sample_indices(population: int, size: int, seed: int) -> tuple[int, ...]:
    """A uniform subset of range(population), sorted; memory and draws follow the sample, not the population."""
    if size > population or size < 0:
        raise ValueError("a sample is a part of its population")
    chosen: set[int] = set()
    for draw, top in enumerate(range(population - size, population)):
        at = _below(seed, draw, top + 1)
        chosen.add(top if at in chosen else at)
    return tuple(sorted(chosen))


def _below(seed: int, draw: int, limit: int) -> int:
    """A draw under the limit without bias: 256-bit words that would tilt it are passed over."""
    for attempt in range(1 << 20):
        word = int.from_bytes(hashlib.sha256(_framed(str(seed).encode(), f"{draw}.{attempt}".encode())).digest(), "big")
        if word < (1 << 256) - (1 << 256) % limit:
            return word % limit
    raise OverflowError("no draw")


def hash_coefficients(seed: int) -> tuple[int, int, int, int]:
    """Coefficients of a cubic polynomial over the field of MODULUS."""
    raw = hashlib.sha256(_DOMAIN + b".cubic" + _framed(str(seed).encode())).digest()
    return tuple(int.from_bytes(raw[i : i + 8], "big") % MODULUS for i in (0, 8, 16, 24))


def hash_rank(value: Column, coefficients: tuple[int, ...]) -> Column:
    """The polynomial at value by Horner's rule; every product stays under MODULUS squared, inside a BIGINT."""
    x = F.pmod(value.cast("long"), F.lit(MODULUS))
    out = F.lit(coefficients[0]).cast("long")
    for c in coefficients[1:]:
        out = (out * x + F.lit(c)) % F.lit(MODULUS)
    return out


def hash_rank_of(value: int, coefficients: tuple[int, ...]) -> int:
    x, out = value % MODULUS, coefficients[0]
    for c in coefficients[1:]:
        out = (out * x + c) % MODULUS
    return out


#: Rows that a gate lets through on average, for each one that is wanted.
GATE_ROOM = 32


def gate_limit(k: int, population: int) -> int:
    """Hash values below this pass a gate before k of a population are picked; the whole range where they are few."""
    return min(MODULUS, -(-MODULUS * k * GATE_ROOM // max(1, population)))


def decide(population: int, sample_size: int, exhaustive_limit: int) -> str:
    """exact where all are looked at anyway, else sampled."""
    return "exact" if population <= max(exhaustive_limit, sample_size) else "sampled"


def bottom_k(df: DataFrame, key: Column, k: int, seed: int, order: str = "id", population: int | None = None) -> DataFrame:
    """The k rows of the smallest hash rank: a bounded heap in each partition, one merge.

    With the population's size, a second hash (seed + 1) lets about GATE_ROOM * k rows through first, so that only
    those are ranked; the choice is then among them.
    """
    if population is not None and (limit := gate_limit(k, population)) < MODULUS:
        df = df.where(hash_rank(key, hash_coefficients(seed + 1)) < limit)
    return df.withColumn("__rank", hash_rank(key, hash_coefficients(seed))).orderBy("__rank", order).limit(k).drop("__rank")


def wilson(positive: int, size: int, population: int) -> dict:
    """Two-sided 95 % interval of a share that was seen in a strict part of the population."""
    if not 0 <= positive <= size or size < 1 or size >= population:
        raise ValueError("an interval needs a sample smaller than its population")
    share, z2 = positive / size, Z95 * Z95
    middle = (share + z2 / (2 * size)) / (1 + z2 / size)
    half = Z95 * math.sqrt((share * (1 - share) + z2 / (4 * size)) / size) / (1 + z2 / size)
    low = 0.0 if positive == 0 else max(0.0, middle - half)
    high = 1.0 if positive == size else min(1.0, middle + half)
    return {"sample_size": size, "population": population, "confidence": 0.95, "ci": [low, high]}


def half_even(numerator: int, denominator: int) -> int:
    """Exact integer quotient, halves to even."""
    q, r = divmod(numerator, denominator)
    return q + (1 if 2 * r > denominator or 2 * r == denominator and q % 2 else 0)
