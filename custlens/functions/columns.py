"""Column expressions whose results must not depend on engine or partition order."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

MICROS_PER_DAY = 86_400_000_000.0
WHITESPACE = " \t\n\r\x0b\x0c"

# Dekker's constant, 2^27 + 1: splits a double into two 26-bit halves.
_SPLIT = 134217729.0


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.btrim(col(x), F.lit(WHITESPACE))


def round_even(x: Column | str, digits: int) -> Column:
    """Half-even rounding of the scaled double, as array libraries do it.

    ``bround`` works on the decimal text instead, so it differs on values such
    as 1.015 whose scaled double is not a tie. Adding 0.0 turns -0.0 into 0.0.
    """
    scale = float(10**digits)
    return F.rint(col(x).cast("double") * scale) / scale + F.lit(0.0)


def round_exact(x: Column | str, digits: int) -> Column:
    """Half-even rounding of the exact binary value of ``x``.

    ``x * scale`` can land on a tie through its own rounding error. The error
    is recovered exactly by splitting ``x`` and decides such ties; everything
    stays in generated code. ``x`` is used many times over: for long
    expressions use :func:`rounded_exact`.
    """
    x = col(x).cast("double")
    scale = float(10**digits)
    product = x * scale
    high = x * _SPLIT - (x * _SPLIT - x)
    error = (high * scale - product) + (x - high) * scale
    down = F.floor(product).cast("double")
    on_tie = (product - down) == 0.5
    rounded = (
        F.when(on_tie & (error > 0), down + 1.0)
        .when(on_tie & (error < 0), down)
        .otherwise(F.rint(product))
    )
    return rounded / scale + F.lit(0.0)


def rounded_exact(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Rounds columns of ``df`` in place, like :func:`round_exact`, on computed values."""
    def text(x: str, n: int) -> str:
        scale = f"{10**n}.0D"
        high = f"({x} * {_SPLIT}D - ({x} * {_SPLIT}D - {x}))"
        error = f"(({high} * {scale} - {x} * {scale}) + ({x} - {high}) * {scale})"
        down = f"double(floor({x} * {scale}))"
        tie = f"({x} * {scale} - {down} = 0.5D)"
        return (
            f"CASE WHEN {tie} AND {error} > 0D THEN {down} + 1D WHEN {tie} AND {error} < 0D THEN {down} "
            f"ELSE rint({x} * {scale}) END / {scale} + 0D"
        )

    return df.withColumns({c: F.expr(text(f"`{c}`", n)) for c, n in digits.items()})


def cents(amount: Column | str) -> Column:
    """A money amount with two decimals as a whole number, so that sums are exact."""
    return F.rint(col(amount) * 100.0).cast("bigint")


def money(whole_cents: Column | str) -> Column:
    return col(whole_cents).cast("double") / 100.0


def exact_mean(x: Column | str) -> Column:
    """Mean from a decimal sum with six digits, so that row order cannot change it."""
    total = F.sum(col(x).cast("decimal(28,6)")).cast("double")
    return F.when(F.count(col(x)) > 0, total / F.count(col(x)))


def _micros_of_day(x: Column) -> Column:
    seconds = F.hour(x) * 3600 + F.minute(x) * 60
    return seconds.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), x) * 1_000_000).cast("bigint")


def days_between(start: Column | str, end: Column | str) -> Column:
    """Fractional days between zone-free timestamps.

    ``timestampdiff`` would read them in the session zone, where a day may have 23 hours.
    """
    start, end = col(start), col(end)
    days = F.datediff(F.to_date(end), F.to_date(start)).cast("bigint") * 86_400_000_000
    return (days + _micros_of_day(end) - _micros_of_day(start)).cast("double") / MICROS_PER_DAY


def timestamp(value: datetime | Column) -> Column:
    """A zone-free timestamp literal that reaches the scan as a pushed filter."""
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return value


def days_before(value: datetime, days: float) -> datetime:
    return value - timedelta(days=days)


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num / den`` with nulls and a zero denominator mapped to ``default``."""
    out = F.when(den != 0, num / den)
    return out if default is None else F.coalesce(out, F.lit(default))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds ``x``; a null stays null (``greatest``/``least`` alone skip nulls)."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(low))
    if high is not None:
        y = F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)
