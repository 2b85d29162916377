"""Normal tail probabilities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximations of erf and erfc (Cody 1969, Math. Comp. 23:631).
NEAR_TOP = [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3]
NEAR_BOTTOM = [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3]
MIDDLE_TOP = [
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
]
MIDDLE_BOTTOM = [
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
]
FAR_TOP = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
FAR_BOTTOM = [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]


def polynomial(x: Column, factors: list[float]) -> Column:
    """Highest power first."""
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + F.lit(f)
    return out


def upper_tail(size: Column) -> Column:
    """erfc of a number that is not negative."""
    square = size * size
    near = 1 - size * polynomial(square, NEAR_TOP) / polynomial(square, NEAR_BOTTOM)
    middle = F.exp(-square) * polynomial(size, MIDDLE_TOP) / polynomial(size, MIDDLE_BOTTOM)
    inverse = 1 / square
    far = F.exp(-square) / size * (1 / math.sqrt(math.pi) - inverse * polynomial(inverse, FAR_TOP) / polynomial(inverse, FAR_BOTTOM))
    return F.when(F.isnan(size), size).when(size <= 0.46875, near).when(size <= 4, middle).otherwise(far)


def erfc(x: Column) -> Column:
    """Complementary error function, to about 1e-13 of its value; NULL and NaN stay."""
    # the number is bound once; written out it would stand in the plan some fifty times
    return F.get(F.transform(F.array(x.cast("double")), lambda v: F.when(v < 0, 2 - upper_tail(-v)).otherwise(upper_tail(v))), 0)


def two_sided(z: Column) -> Column:
    """Probability of a standard normal value at least as far from zero."""
    return F.get(F.transform(F.array(F.abs(z.cast("double")) / math.sqrt(2)), upper_tail), 0)
