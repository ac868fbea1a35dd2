"""Report measures as finishers over decomposable partial aggregates.

Every grouped report asks for named measures (order count, mean price,
revenue, ...). Each measure is a function of a few partial aggregates --
count, price sum as whole cents and a rest, min / max, sum of squared
deviations (M2), revenue in whole cents, quantity sum, counts below /
at-or-above a price -- that merge (``merged``): over finer groups, over batches,
in any order. Price and revenue sums are longs, so means do not depend on how
rows were partitioned. A report grouped on its own computes only the partials it
needs; a suite of reports computes them for all key sets in one GROUPING
SETS pass and every report finishes from its own set. Both paths run the
same finishers, so they give the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from bandwise.functions.money import cent_sum, from_parts, money_round, price_parts

PRICE, QUANTITY, REVENUE = "price", "quantity", "line_revenue"

_FIXED_PARTIALS: dict[str, Callable[[], Column]] = {
    "_n": lambda: F.count(F.lit(1)),
    "_sc": lambda: F.sum(price_parts(PRICE)[0]),
    "_sr": lambda: F.sum(price_parts(PRICE)[1]),
    "_mn": lambda: F.min(PRICE),
    "_mx": lambda: F.max(PRICE),
    "_m2": lambda: F.var_pop(PRICE) * F.count(F.lit(1)),
    "_rc": lambda: cent_sum(REVENUE),
    "_q": lambda: F.sum(QUANTITY),
}


def partial(name: str) -> Column:
    """The aggregate behind a partial name; ``_lt<t>`` / ``_ge<t>`` count rows
    priced below / at or above ``t``."""
    if name in _FIXED_PARTIALS:
        return _FIXED_PARTIALS[name]().alias(name)
    if name.startswith("_lt"):
        return F.count_if(F.col(PRICE) < float(name[3:])).alias(name)
    if name.startswith("_ge"):
        return F.count_if(F.col(PRICE) >= float(name[3:])).alias(name)
    raise KeyError(name)


def merged(name: str) -> Column:
    """The aggregate that merges a partial of finer groups into coarser ones."""
    if name in ("_mn", "_mx"):
        return (F.min if name == "_mn" else F.max)(name).alias(name)
    if name == "_m2":
        total, part = from_parts(F.sum("_sc"), F.sum("_sr")), from_parts("_sc", "_sr")
        between = F.sum(part * part / F.col("_n")) - total * total / F.sum("_n")
        return (F.sum("_m2") + F.greatest(between, F.lit(0.0))).alias(name)
    return F.sum(name).alias(name)


def _c(name: str) -> Column:
    return F.col(name)


def _mean_price() -> Column:
    return from_parts("_sc", "_sr") / _c("_n")


# name -> (partials needed, finisher over those partials)
MEASURES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "count": (("_n",), lambda: _c("_n")),
    "mean_price": (("_sc", "_sr", "_n"), lambda: money_round(_mean_price())),
    "price_cents": (("_sc",), lambda: _c("_sc")),
    "price_rest": (("_sr",), lambda: _c("_sr")),
    "min_price": (("_mn",), lambda: money_round("_mn")),
    "max_price": (("_mx",), lambda: money_round("_mx")),
    "revenue": (("_rc",), lambda: _c("_rc") / F.lit(100.0)),
    "units": (("_q",), lambda: _c("_q")),
    "units_total": (("_q",), lambda: _c("_q").cast("double")),
    "mean_units": (("_q", "_n"), lambda: money_round(_c("_q") / _c("_n"))),
    "revenue_per_order": (("_rc", "_n"), lambda: money_round(_c("_rc") / F.lit(100.0) / _c("_n"))),
    "raw_revenue_per_order": (("_rc", "_n"), lambda: _c("_rc") / F.lit(100.0) / _c("_n")),
    "variance_pct": (("_m2", "_sc", "_sr", "_n"), lambda: money_round(
        F.try_divide(F.lit(100.0) * (_c("_m2") / _c("_n")), _mean_price() * _mean_price()))),
}


def threshold_measures(threshold: float) -> dict[str, tuple[tuple[str, ...], Callable[[], Column]]]:
    """Counts below / at or above ``threshold`` and the share at or above."""
    t = f"{threshold:g}"
    lt, ge = f"_lt{t}", f"_ge{t}"
    return {
        f"below_{t}": ((lt,), lambda: _c(lt)),
        f"at_or_above_{t}": ((ge,), lambda: _c(ge)),
        f"share_at_or_above_{t}": ((ge, "_n"), lambda: money_round(
            F.try_divide(F.lit(100.0) * _c(ge), _c("_n").cast("double")))),
    }


def lookup(name: str) -> tuple[tuple[str, ...], Callable[[], Column]]:
    if name in MEASURES:
        return MEASURES[name]
    for prefix in ("below_", "at_or_above_", "share_at_or_above_"):
        if name.startswith(prefix):
            return threshold_measures(float(name[len(prefix):]))[name]
    raise KeyError(name)


def partials_for(measures: Iterable[str]) -> list[str]:
    return sorted({p for m in measures for p in lookup(m)[0]})


def finish(measures: dict[str, str]) -> list[Column]:
    """Output columns: ``{output name: measure name}`` over partial columns."""
    return [lookup(m)[1]().alias(out) for out, m in measures.items()]
