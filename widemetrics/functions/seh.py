"""Sparse exponential histograms: a map from upper bound to count.

Bounds carry two significant digits in half steps, at most eighteen to a
decade, so a histogram stays small whatever it counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _positive_bucket(value: Column) -> Column:
    # Doubling after the division is exact and cannot overflow.
    decade = F.nullif(F.pow(F.lit(10.0), F.floor(F.log10(value))), F.lit(0.0))
    return F.ceil(value / decade * 2) / 2 * decade


def bucket(col: Column | str, negative: str = "raise", invalid: str = "raise") -> Column:
    """Upper bound of the bucket that holds a number.

    ``negative`` is ``raise`` or ``mirror`` (the bound of the magnitude, with
    the sign kept); ``invalid`` says what NaN and infinities do: ``raise``, or
    ``skip`` to give NULL.
    """
    value = _col(col).cast("double")
    infinity = F.lit(float("inf"))
    magnitude = F.abs(value) if negative == "mirror" else value
    # NaN sorts above infinity, so this keeps finite positive numbers only.
    usable = F.when((magnitude > 0) & (magnitude < infinity), magnitude)
    bound = _positive_bucket(usable)
    if negative == "mirror":
        bound = F.when(value < 0, -bound).otherwise(bound)
    unusable = F.lit(None).cast("double")
    if invalid == "raise":
        unusable = F.raise_error(F.lit("NaN and infinity have no bucket")).cast("double")
    below = F.raise_error(F.lit("a negative number has no bucket")).cast("double")
    rest = (
        F.when(value.isNull(), F.lit(None).cast("double"))
        .when(value == 0, F.lit(0.0))
        .when(F.isnan(value) | (F.abs(value) == infinity), unusable)
        .when(value < 0, value if negative == "mirror" else below)
        # A magnitude too small for its decade to be a double is its own bound.
        .otherwise(value)
    )
    # The usual case stands first: its parts are then shared by generated code.
    return F.coalesce(bound, rest)


def combine(left: Column | str, right: Column | str) -> Column:
    """Key-wise sum of two histograms."""
    return F.map_zip_with(
        _col(left),
        _col(right),
        lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)),
    )


def subtract(left: Column | str, right: Column | str) -> Column:
    """Key-wise difference; buckets that reach zero go away."""
    difference = F.map_zip_with(
        _col(left),
        _col(right),
        lambda _, x, y: F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)),
    )
    return F.map_filter(difference, lambda _, n: n != 0)


def count(col: Column | str) -> Column:
    """Number of samples in a histogram."""
    values = F.map_values(_col(col))
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, n: acc + n)


def from_pairs(pairs: Column) -> Column:
    """A histogram with its bounds in order, from an array of (bucket, count)."""
    return F.map_from_entries(F.sort_array(pairs))


def to_json(col: Column | str, bounds: str = "bigint") -> Column:
    """A JSON object with the bounds as keys, in order."""
    from widemetrics.functions.text import plain_number

    entries = F.sort_array(F.map_entries(_col(col)))

    def member(e: Column) -> Column:
        key = plain_number(e["key"]) if bounds == "double" else e["key"].cast("string")
        return F.concat(F.lit('"'), key, F.lit('":'), e["value"].cast("string"))

    return F.concat(F.lit("{"), F.array_join(F.transform(entries, member), ","), F.lit("}"))


def from_json(text: Column) -> Column:
    """Read a JSON object of counts; NULL where a key or count is not whole."""
    parsed = F.from_json(text, "map<string,bigint>")
    keys = F.transform(F.map_keys(parsed), lambda k: k.try_cast("bigint"))
    whole = F.forall(keys, lambda k: k.isNotNull()) & F.forall(
        F.map_values(parsed), lambda n: n.isNotNull()
    )
    whole = whole & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(whole, F.map_from_arrays(keys, F.map_values(parsed)))
