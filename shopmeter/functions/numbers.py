"""Rounding, order-independent sums and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sums are decimals of so many places, far more than any amount carries. Of 27 digits of
# a value 17 stay before the point, of a sum's 38 digits 28: no total is cut.
PLACES = 10


def round_even(column: Column, places: int = 2) -> Column:
    """Half-to-even rounding on the scaled value (``F.round`` is half-up)."""
    scale = float(10**places)
    return F.rint(column * scale) / scale


def exact(column: Column, digits: int = 38 - 10 - 1) -> Column:
    """A double as the decimal it shows; NaN counts as missing.

    With the default digits a product with a whole number keeps every place.
    """
    known = F.nullif(column.cast("double"), F.lit(float("nan")))
    return known.cast(f"decimal({digits},{PLACES})")


def exact_sum(column: Column) -> Column:
    """Sum that does not depend on row order; missing values count as nothing.

    Doubles added in another order differ in the last bits, so a retried task
    could change a published figure. Decimal sums do not.
    """
    return F.coalesce(F.sum(exact(column)), F.lit(0)).cast("double")


# Amounts below this that have no more than two places are summed as whole cents.
MOST_IN_CENTS = 1e8


def cents(column: Column) -> Column:
    """An amount in whole cents, null for one that has more than two places, or is large or missing."""
    value = column.cast("double")
    whole = F.rint(value * 100)
    return F.when((F.abs(value) < MOST_IN_CENTS) & (whole / 100 == value), whole.cast("long"))


def beside_cents(column: Column) -> Column:
    """The amounts that :func:`cents` leaves out, as decimals; null for the others."""
    return F.when(cents(column).isNull(), exact(column))


def from_cents(whole: Column, rest: Column) -> Column:
    """The decimal total of a sum of cents and one of the amounts beside them; 0 without any."""
    kind = f"decimal(38,{PLACES})"
    hundredths = (F.coalesce(whole, F.lit(0)).cast("decimal(20,0)") / F.lit(100)).cast(kind)
    return hundredths + F.coalesce(rest.cast(kind), F.lit(0))


def money_sum(column: Column) -> Column:
    """Like :func:`exact_sum`, quicker where most amounts are whole cents: those are summed as longs."""
    return from_cents(F.sum(cents(column)), F.sum(beside_cents(column))).cast("double")


def exact_mean(column: Column) -> Column:
    """Mean over an order-independent sum; null when there is no value."""
    total = F.sum(exact(column)).cast("double")
    return ratio(total, F.count(F.nullif(column.cast("double"), F.lit(float("nan")))))


def zero_sum(column: Column) -> Column:
    """Sum of whole numbers in which no value at all counts as 0."""
    return F.coalesce(F.sum(column.cast("long")), F.lit(0).cast("long"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is null, not an error or infinity, on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
