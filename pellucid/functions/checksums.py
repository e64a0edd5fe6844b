"""Check digits as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the Verhoeff scheme: the multiplication of the dihedral group of order 10 and the first row of its permutations.
_FLIP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _product(a: int, b: int) -> int:
    """Multiplication in the dihedral group of order 10."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def _permutation(times: int) -> list[int]:
    return [reduce(lambda x, _: _FLIP[x], range(times), d) for d in range(10)]


PRODUCTS = [_product(a, b) for a in range(10) for b in range(10)]
PERMUTATIONS = [d for i in range(8) for d in _permutation(i)]


def verhoeff_ok(value: Column) -> Column:
    """Digits only, and the Verhoeff sum is zero."""
    products, permutations = F.array(*map(F.lit, PRODUCTS)), F.array(*map(F.lit, PERMUTATIONS))
    digits = F.transform(F.split(F.reverse(value), ""), lambda d, i: F.element_at(permutations, ((i % 8) * 10 + d.cast("int") + 1).cast("int")))
    total = F.aggregate(digits, F.lit(0), lambda a, d: F.element_at(products, (a * 10 + d + 1).cast("int")))
    return F.when(value.rlike(r"\A[0-9]+\z"), total == 0).otherwise(F.lit(False))


def luhn_ok(value: Column) -> Column:
    """Digits, spaces and hyphens with two digits at least, and the Luhn sum is a multiple of ten."""
    digits = F.regexp_replace(value, "[ -]", "")
    return F.when(digits.rlike(r"\A[0-9]{2,}\z"), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
