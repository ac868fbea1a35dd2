"""Money and percentage columns that round identically on every engine.

Plain ``round(double, 2)`` differs between engines on half-cent values (one
rounds the decimal text, another the binary fraction). Snapping the double to
ten decimals first and rounding that half away from zero gives one answer
everywhere. Per-row amounts are rounded in double/long arithmetic (the
decimal path costs about a microsecond per row); sums of money are sums of
whole cents, exact and independent of the order partitions are added.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SNAP = "decimal(38,10)"
# Below this magnitude x * 1e10 is an integer-valued double (< 2**53), so the
# ten-decimal snap and the half-cent test are exact in double/long arithmetic.
_FAST_LIMIT = 9.0e5


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_round(c: Column | str, scale: int = 2) -> Column:
    """ROUND(x, scale) as a double, half away from zero on the decimal value.

    Decimal arithmetic: meant for aggregated values (a few rows per report).
    """
    return F.round(_col(c).cast(_SNAP), scale).cast("double")


def cents(c: Column | str) -> Column:
    """ROUND(x, 2) * 100 as a long, same rule as ``money_round`` (snap to ten
    decimals, then half away from zero), in double/long arithmetic for the
    per-row hot path; magnitudes beyond the exact range take the decimal path."""
    x = _col(c)
    k = F.rint(x * F.lit(1e10))
    fast = (F.signum(x) * F.floor((F.abs(k) + F.lit(5e7)) / F.lit(1e8))).cast("long")
    exact = (F.round(x.cast(_SNAP), 2) * 100).cast("long")
    return F.when(F.abs(x) < _FAST_LIMIT, fast).otherwise(exact).cast("long")


def money(c: Column | str) -> Column:
    """Per-row ROUND(x, 2) as a double holding a whole number of cents."""
    return cents(c) / F.lit(100.0)


def money_sql(x: str) -> Column:
    """``money`` for an amount given as SQL text: the same rule, parsed once
    on the JVM instead of assembled call by call from the driver.

    A filter on the amount is pushed below the projection that names it, so the
    text is repeated in every comparison. The rule names ``x`` as rarely as it can:
    the JVM does not compile a generated method of more than 8,000 bytes."""
    x = f"({x})"
    k = f"rint({x} * 1e10)"
    fast = f"CAST(signum({x}) * floor((abs({k}) + 5e7) / 1e8) AS BIGINT)"
    exact = f"CAST(round(CAST({x} AS DECIMAL(38,10)), 2) * 100 AS BIGINT)"
    return F.expr(f"CAST(CASE WHEN abs({x}) < 9e5 THEN {fast} ELSE {exact} END AS BIGINT) / 100.0D")


# Prices are summed as whole cents and a rest in units of 1e-8, both longs, so a
# sum does not depend on the order of its rows. 9 * 10**12 rests fit a long.
REST_UNITS = 1_000_000


def price_parts(c: Column | str) -> tuple[Column, Column]:
    """(whole cents, rest in 1e-8) of an amount snapped to eight decimals."""
    k = F.rint(_col(c) * F.lit(1e8))
    whole = F.floor(k / F.lit(float(REST_UNITS)))
    return whole.cast("long"), (k - whole * F.lit(float(REST_UNITS))).cast("long")


def from_parts(whole: Column | str, rest: Column | str) -> Column:
    """The amount as a double, from (sums of) its two parts."""
    return _col(whole) / F.lit(100.0) + _col(rest) / F.lit(1e8)


def cent_sum(c: Column | str) -> Column:
    """SUM of a cent-rounded money column as whole cents (long): exact and
    independent of the order in which partitions are added."""
    return F.sum(F.rint(_col(c) * F.lit(100.0)).cast("long"))


def money_sum(c: Column | str) -> Column:
    """SUM over a cent-rounded money column, returned as a double."""
    return cent_sum(c) / F.lit(100.0)


def mean(c: Column | str) -> Column:
    """ROUND(AVG(x), 2)."""
    return money_round(F.avg(_col(c)))


def low(c: Column | str) -> Column:
    """ROUND(MIN(x), 2)."""
    return money_round(F.min(_col(c)))


def high(c: Column | str) -> Column:
    """ROUND(MAX(x), 2)."""
    return money_round(F.max(_col(c)))


def rows() -> Column:
    """COUNT(*)."""
    return F.count(F.lit(1))


def pct(part: Column | str, whole: Column | str) -> Column:
    """ROUND(100 * part / whole, 2) computed in double precision; NULL when
    ``whole`` is 0 (SQL engines without ANSI errors return NULL there)."""
    return money_round(raw_pct(part, whole))


def raw_pct(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole without rounding (for threshold tests)."""
    return F.try_divide(F.lit(100.0) * _col(part), _col(whole).cast("double"))
