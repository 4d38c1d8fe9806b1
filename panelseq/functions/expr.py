"""Column expressions: numeric guards, labels, keyed draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelseq import EPS

PLUS, MINUS, ZERO = "+", "−", "0"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.least(col(c), F.lit(float(high))), F.lit(float(low)))


def nonfinite(c: str | Column) -> Column:
    """True for null, NaN and both infinities."""
    x = col(c)
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def squash(c: str | Column, scale: float | Column) -> Column:
    """1 - exp(-max(x, 0) / scale)."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return 1.0 - F.exp(-F.greatest(col(c), F.lit(0.0)) / s)


def softmax(scores: list[Column], temperature: float) -> list[Column]:
    scaled = [s / F.lit(float(temperature)) for s in scores]
    top = F.greatest(*scaled)
    parts = [F.exp(s - top) for s in scaled]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return [p / total for p in parts]


def corr(x: str | Column, y: str | Column, over=None) -> Column:
    """Correlation of the pairs without a null, also over a window; NaN where a side does not vary, which the built-in one raises for."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    made = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    cov, p, q = made if over is None else [c.over(over) for c in made]
    return F.when(p * q > 0, F.try_divide(cov, p * q)).when(p.isNotNull(), F.lit(float("nan")))


def sign_code(c: str | Column, eps: float = EPS) -> Column:
    x = col(c)
    return F.when(x > eps, 1).when(x < -eps, -1).otherwise(0)


def sign_mark(c: str | Column, eps: float = EPS) -> Column:
    x = col(c)
    return F.when(x > eps, PLUS).when(x < -eps, MINUS).otherwise(ZERO)


def direction(c: str | Column, eps: float = EPS) -> Column:
    x = col(c)
    return F.when(x > eps, "POSITIVE").when(x < -eps, "NEGATIVE").otherwise("ZERO")


def support(low: str | Column, high: str | Column) -> Column:
    """positive / negative / includes_zero for an interval."""
    return F.when(col(low) > 0, "positive").when(col(high) < 0, "negative").otherwise("includes_zero")


def support_category(low: str | Column, high: str | Column) -> Column:
    """Claim-table form of the support label; both limits null means no interval."""
    lo, hi = col(low), col(high)
    return (
        F.when(lo.isNull() & hi.isNull(), "NO_INTERVAL_DEFINED")
        .when(lo > 0, "POSITIVE_SUPPORTED")
        .when(hi < 0, "NEGATIVE_SUPPORTED")
        .otherwise("SPANS_ZERO")
    )


def verdict(low: str | Column, high: str | Column) -> Column:
    return F.when((col(low) > 0) | (col(high) < 0), "SUPPORTED").otherwise("NOT_SUPPORTED")


def majority(pos: str | Column, neg: str | Column, zero: str | Column) -> Column:
    p, n, z = col(pos), col(neg), col(zero)
    return (
        F.when((n + z == 0) & (p > 0), "ALL_POSITIVE")
        .when((p + z == 0) & (n > 0), "ALL_NEGATIVE")
        .when(p > n, "POSITIVE_MAJORITY")
        .when(n > p, "NEGATIVE_MAJORITY")
        .otherwise("TIED_MAJORITY")
    )


def polarity(category: str | Column) -> Column:
    c = col(category)
    return (
        F.when(c.isin("ALL_POSITIVE", "POSITIVE_MAJORITY"), 1)
        .when(c.isin("ALL_NEGATIVE", "NEGATIVE_MAJORITY"), -1)
        .otherwise(0)
    )


def digest(*parts: str | int | Column) -> Column:
    """md5 of the parts joined by ':'; integers and strings are literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def draw_index(n: str | Column, *parts: str | int | Column) -> Column:
    """Draw from 0..n-1 keyed by the parts: the same under any partitioning."""
    head = F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, col(n).cast("bigint"))


def ratio(num: str | Column, den: str | Column, default: float | None = 0.0) -> Column:
    """num/den, ``default`` where the denominator is 0."""
    q = F.try_divide(col(num), col(den))
    return q if default is None else F.coalesce(q, F.lit(float(default)))
