"""Column expressions: no shuffle, no Python at run time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.params import DEFAULTS, Params, Resource


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_between(later, earlier) -> Column:
    """Elapsed seconds, exact to the microsecond (the difference is taken in whole numbers)."""
    return (F.unix_micros(as_col(later)) - F.unix_micros(as_col(earlier))) / F.lit(1e6)


def clamp(x, low: float | None, high: float | None) -> Column:
    """Limit to [low, high]. Nulls stay null: greatest/least alone would turn them into a bound."""
    x = as_col(x)
    out = x
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    return F.when(x.isNotNull(), out)


def regime_label(x, bounds=DEFAULTS.regime_bounds, unknown: str = DEFAULTS.unknown_label) -> Column:
    """Name of the first band [low, high) holding x, else `unknown`."""
    x = as_col(x)
    names = [F.when((x >= low) & (x < high), F.lit(name)) for name, low, high in bounds]
    return F.coalesce(*names, F.lit(unknown))


def headroom(x) -> Column:
    return F.lit(100.0) - as_col(x)


def ewma_depth(span: int) -> int:
    """Rows after which an old sample weighs less than a double can resolve."""
    return math.ceil(60 * math.log(2) / -math.log(1 - 2.0 / (span + 1)))


def ewma_step(x, gap, span: int) -> tuple[Column, Column]:
    """(factor, offset) by which a known value changes the mean: y -> factor * y + offset, `gap` rows after the last known value.

    a = 2/(span+1). Rows without a value keep the mean but age it, so the value
    behind them weighs more. Without a gap the value itself starts the mean.
    """
    a, keep, x, gap = F.lit(2.0 / (span + 1)), F.lit(1.0 - 2.0 / (span + 1)), as_col(x).cast("double"), as_col(gap)
    aged = F.pow(keep, gap)
    factor = F.when(x.isNotNull(), F.coalesce(aged / (aged + a), F.lit(0.0)))
    offset = F.when(x.isNotNull(), F.coalesce(a * x / (aged + a), x))
    return factor, offset


def sorted_percentile(values: Column, p: float) -> Column:
    """Linear percentile of an ascending array without nulls; null when empty."""
    spot = F.lit(float(p)) * (F.size(values) - 1)
    lo = F.get(values, F.floor(spot).cast("int"))
    hi = F.get(values, F.ceil(spot).cast("int"))
    return F.when(F.size(values) > 0, lo + (hi - lo) * (spot - F.floor(spot)))


def present(values: Column) -> Column:
    return F.array_sort(F.filter(values, lambda v: v.isNotNull()))


def breach_rate(breaches, samples) -> Column:
    samples = as_col(samples)
    return F.when(samples > 0, F.round(F.lit(100.0) * as_col(breaches) / samples, 3)).otherwise(F.lit(0.0))


def array_breaches(values: Column, level: Column) -> Column:
    return F.size(F.filter(values, lambda v: v > level))


def safety_floor(candidate, recent, params: Params = DEFAULTS) -> Column:
    """Lowest level candidate, candidate+step, ... whose breach rate on `recent` is allowed.

    A level L is allowed when at most k of the n values exceed it, that is when
    L is not below the (k+1)-th largest value. So one sort replaces the search
    over levels. Rates count as rounded to 3 decimals; n is a bounded window.
    """
    c, step = as_col(candidate).cast("double"), F.lit(float(params.sweep_step))
    vals = present(as_col(recent))
    n = F.size(vals)
    allowed = F.floor(n * F.lit((params.max_breach_rate + 0.0005) / 100.0)).cast("int")
    need = F.get(vals, n - 1 - allowed)
    guess = F.greatest(F.ceil((need - c) / step), F.lit(0))
    # the grid is c + i*step in floating point; settle the neighbour on the right side
    level = (
        F.when((guess > 0) & (c + (guess - 1) * step >= need), c + (guess - 1) * step)
        .when(c + guess * step >= need, c + guess * step)
        .otherwise(c + (guess + 1) * step)
    )
    level = F.when((n == 0) | (allowed >= n), c).otherwise(level)
    return F.when(n == 0, F.round(c, 2)).otherwise(F.round(F.least(level, F.lit(100.0)), 2))


def units(percent, resource: Resource) -> Column:
    return as_col(percent) / 100.0 * F.lit(float(resource.capacity))


def raw_cost(percent, resource: Resource, params: Params = DEFAULTS) -> Column:
    hours = float(params.hours_per_month) if resource.hourly else 1.0
    return units(percent, resource) * F.lit(resource.rate) * F.lit(hours)


def by_target(target, make, params: Params = DEFAULTS) -> Column:
    """Dispatch `make(resource)` on the value of a target column; unknown targets give null."""
    target = as_col(target)
    return F.coalesce(*[F.when(target == r.target, make(r)) for r in params.resources])


def monthly_cost(target, percent, params: Params = DEFAULTS) -> Column:
    """Dollars per month of one resource at an allocation percentage."""
    return F.round(by_target(target, lambda r: raw_cost(percent, r, params), params), 2)


def severity(psi) -> Column:
    psi = as_col(psi)
    return (
        F.when(psi.isNull(), "unknown").when(psi < 0.1, "stable").when(psi < 0.25, "moderate").otherwise("major")
    )


def bin_of(x, edges: Column) -> Column:
    """Number of interior edges at or below x."""
    x = as_col(x)
    return F.size(F.filter(edges, lambda e: x >= e))


def psi_term(reference, current, floor: float = DEFAULTS.psi_floor) -> Column:
    r = F.greatest(as_col(reference), F.lit(floor))
    c = F.greatest(as_col(current), F.lit(floor))
    return (c - r) * F.ln(c / r)


def short_hash(*parts) -> Column:
    """First 12 hex digits of the SHA-256 of the parts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *[as_col(p) for p in parts]), 256), 1, 12)


def sorted_json(pairs: Column) -> Column:
    """JSON object of an array of (key, value) structs, keys sorted."""
    return F.to_json(F.map_from_entries(F.array_sort(pairs)))


def parse_ts(text) -> Column:
    """Timestamp from text in the accepted layouts, null when none fits."""
    text = as_col(text).cast("string")
    return F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX")),
        F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm:ss")),
    )


def any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out
