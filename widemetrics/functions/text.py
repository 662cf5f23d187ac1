"""Text renderings of numbers and the parsing of them back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from widemetrics.functions.bind import let

_FLOAT = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))$"


def plain_number(col: Column) -> Column:
    """Shortest decimal digits of a float or double, never in exponent form.

    ``1.0`` is ``1``, ``1.5E-5`` is ``0.000015``, infinities are ``inf``.
    """
    text = col.cast("string")
    special = (
        F.when(F.isnan(col), F.lit("NaN"))
        .when(col == F.lit(float("inf")), F.lit("inf"))
        .when(col == F.lit(float("-inf")), F.lit("-inf"))
    )
    usual = F.when(~text.contains("E"), F.regexp_replace(text, r"\.0$", ""))
    return F.coalesce(special, usual, let(text, _without_exponent))


def _without_exponent(text: Column) -> Column:
    """``-1.25E7`` as ``-12500000``."""
    parts = F.struct(
        F.regexp_extract(text, "^-", 0).alias("sign"),
        F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$|[-.]", "").alias("digits"),
        F.substring_index(text, "E", -1).try_cast("int").alias("exponent"),
    )

    def shifted(p: Column) -> Column:
        digits, exponent = p["digits"], p["exponent"]
        whole = F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, "0")
        fraction = F.substring(digits, exponent + 2, F.length(digits))
        large = F.when(fraction == "", whole).otherwise(F.concat(whole, F.lit("."), fraction))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        return F.concat(p["sign"], F.when(exponent >= 0, large).otherwise(small))

    return let(parts, shifted)


def parse_float(text: Column) -> Column:
    """A double, or NULL where the text is not a plain number, inf or NaN."""
    return F.when(text.rlike(_FLOAT), text.try_cast("double"))


def parse_boolean(text: Column) -> Column:
    """Any spelling a database boolean column takes; NULL for others."""
    word = F.lower(F.trim(text))
    return F.when(word.rlike("^(t|tr|tru|true|y|ye|yes|on|1)$"), F.lit(True)).when(
        word.rlike("^(f|fa|fal|fals|false|n|no|of|off|0)$"), F.lit(False)
    )
