"""The normal distribution as column expressions and as SQL, from the same rational approximations.

The distribution function is Hart's rational approximation (double precision); its inverse is Acklam's, with one step of
Halley's method on top. Both stay in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients, highest power first.
HART_NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
ACKLAM_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
ACKLAM_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
ACKLAM_TAIL = 0.02425
ROOT = math.sqrt(2 * math.pi)


def _sql_polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    out = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _cdf(x: Column) -> Column:
    z = F.abs(x)
    near = F.exp(-z * z / 2) * _polynomial(z, HART_NUMERATOR) / _polynomial(z, HART_DENOMINATOR)
    far = F.exp(-z * z / 2) / (ROOT * (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))))
    return let(F.when(z < 7.07106781186547, near).otherwise(far), lambda tail: F.when(x > 0, 1 - tail).otherwise(tail))


def cdf(x: Column) -> Column:
    return let(x, _cdf)


def _first_inverse(p: Column) -> Column:
    def outer(low: Column) -> Column:
        return _polynomial(low, ACKLAM_C) / _polynomial(low, ACKLAM_D)

    def inner(q: Column) -> Column:
        return _polynomial(q * q, ACKLAM_A) * q / _polynomial(q * q, ACKLAM_B)

    low = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    return F.when(p < ACKLAM_TAIL, let(low, outer)).when(p > 1 - ACKLAM_TAIL, -let(low, outer)).otherwise(let(p - 0.5, inner))


def inverse(p: Column) -> Column:
    """Null outside (0, 1)."""
    def refine(v: Column) -> Column:
        x, share = v["x"], v["p"]
        return let((_cdf(x) - share) * ROOT * F.exp(x * x / 2), lambda u: x - u / (1 + x * u / 2))

    inside = F.when((p > 0) & (p < 1), p)
    return let(inside, lambda q: let(F.struct(_first_inverse(q).alias("x"), q.alias("p")), refine))


def sql_cdf(x: str) -> str:
    """``x`` is repeated, so it should be a column."""
    z = f"abs({x})"
    e = f"exp(-{z} * {z} / 2)"
    tail = f"(CASE WHEN {z} < 7.07106781186547 THEN {e} * {_sql_polynomial(z, HART_NUMERATOR)} / {_sql_polynomial(z, HART_DENOMINATOR)}" \
        f" ELSE {e} / ({ROOT!r} * ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65)))))) END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def sql_first_inverse(p: str) -> str:
    """The approximation before its refinement."""
    low = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    outer = f"({_sql_polynomial(low, ACKLAM_C)} / {_sql_polynomial(low, ACKLAM_D)})"
    q = f"({p} - 0.5)"
    inner = f"({_sql_polynomial(f'({q} * {q})', ACKLAM_A)} * {q} / {_sql_polynomial(f'({q} * {q})', ACKLAM_B)})"
    return f"(CASE WHEN {p} < {ACKLAM_TAIL} THEN {outer} WHEN {p} > {1 - ACKLAM_TAIL!r} THEN -{outer} ELSE {inner} END)"


def sql_refined(x: str, p: str) -> str:
    """The refinement of a first inverse ``x`` of ``p``; both columns."""
    u = f"(({sql_cdf(x)} - {p}) * {ROOT!r} * exp({x} * {x} / 2))"
    return f"({x} - {u} / (1 + {x} * {u} / 2))"
