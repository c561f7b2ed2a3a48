"""Weight of a context word by its distance, and exact integer forms of it."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weighting codes and their names.
WEIGHTINGS = {
    0: "none",  # 1
    1: "inverse",  # 1 / d
    2: "half_shift",  # 2 / (1 + d)
    3: "third_shift",  # 3 / (2 + d)
    4: "inv_sqrt",  # 1 / sqrt(d)
}

# Largest common denominator that leaves a BIGINT room for 9e12 pairs per cell.
_MAX_DENOMINATOR = 1_000_000
# Decimals of a weight that has no small denominator.
FIXED_DIGITS = 18


def weighting_code(weighting: int | str) -> int:
    """Normalise a weighting given by code or by name."""
    for code, name in WEIGHTINGS.items():
        if weighting == name or (weighting == code and not isinstance(weighting, bool)):
            return code
    raise ValueError(f"unknown distance weighting {weighting!r}; use one of {WEIGHTINGS}")


def _fraction(code: int, d: int) -> Fraction | None:
    if code == 0:
        return Fraction(1)
    if code in (1, 2, 3):
        return Fraction(code, d + code - 1)
    return None


def weight(code: int, d: int) -> float:
    """Weight of a context word ``d`` words away."""
    exact = _fraction(code, d)
    return 1.0 / math.sqrt(d) if exact is None else float(exact)


def weight_column(weighting: int | str, distance: Column) -> Column:
    """The same as a column expression over a distance column."""
    code = weighting_code(weighting)
    d = distance.cast("double")
    if code == 0:
        return F.lit(1.0)
    if code == 4:
        return F.lit(1.0) / F.sqrt(d)
    return F.lit(float(code)) / (d + F.lit(float(code - 1)))


def fixed_weights(weighting: int | str, window: int) -> tuple[Decimal, ...]:
    """Weights at distance 1..window, rounded to `FIXED_DIGITS` decimals."""
    code = weighting_code(weighting)
    with localcontext() as context:
        context.prec = 2 * FIXED_DIGITS + 10
        found = []
        for d in range(1, window + 1):
            exact = _fraction(code, d)
            value = 1 / Decimal(d).sqrt() if exact is None else Decimal(exact.numerator) / exact.denominator
            found.append(value.quantize(Decimal(1).scaleb(-FIXED_DIGITS)))
        return tuple(found)


@dataclass(frozen=True)
class Units:
    """Weights at distance 1..window as integers over one denominator."""

    per_distance: tuple[int, ...]
    denominator: int


def exact_units(weighting: int | str, window: int) -> Units | None:
    """Integer weights, or None if the weights are irrational or need too large a denominator (see `fixed_weights`).

    Integer sums do not depend on the order of the shuffle, so counts stay
    identical from run to run and after the loss of an executor.
    """
    code = weighting_code(weighting)
    exact = [_fraction(code, d) for d in range(1, window + 1)]
    if None in exact:
        return None
    denominator = math.lcm(*(f.denominator for f in exact))
    if denominator > _MAX_DENOMINATOR:
        return None
    return Units(tuple(int(f * denominator) for f in exact), denominator)
