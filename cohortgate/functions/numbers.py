"""Numbers as text, the same form at every magnitude."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _placed(digits: Column, exponent: Column) -> Column:
    """Digits (no point, no trailing zero) with the point after place ``exponent``, unpadded."""
    e = exponent.cast("int")
    size = F.length(digits)
    return (
        F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits))
        .when(e >= size - 1, F.concat(digits, F.repeat(F.lit("0"), e - size + 1)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, size)))
    )


def _scientific(digits: Column, exponent: Column) -> Column:
    mantissa = F.when(F.length(digits) == 1, digits).otherwise(
        F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))
    )
    sign = F.when(exponent < 0, "e-").otherwise("e+")
    pad = F.when(F.abs(exponent) < 10, "0").otherwise("")
    return F.concat(mantissa, sign, pad, F.abs(exponent).cast("string"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row, and not again wherever ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _stripped(digits: Column) -> Column:
    short = F.rtrim(digits, F.lit("0"))
    return F.when(short == "", "0").otherwise(short)


def decimal_text(number: Column) -> Column:
    """Shortest text that reads back as the same double: decimals from 0.0001 up to 1e16, beyond
    that one digit, the rest and an exponent of at least two digits. Null stays null."""
    plain = number.cast("double").cast("string")

    def moved(parts: Column) -> Column:
        e, digits = parts["e"], parts["digits"]
        whole = F.when(e >= F.length(digits) - 1, ".0").otherwise("")
        text = F.when((e < -4) | (e >= 16), _scientific(digits, e)).otherwise(F.concat(_placed(digits, e), whole))
        return F.concat(F.when(parts["minus"], "-").otherwise(""), text)

    def taken_apart(text: Column) -> Column:
        digits = F.replace(F.split_part(F.ltrim(text, F.lit("-")), F.lit("E"), F.lit(1)), F.lit("."), F.lit(""))
        return F.struct(
            F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int").alias("e"), _stripped(digits).alias("digits"),
            text.startswith("-").alias("minus"),
        )

    return F.when(~plain.contains("E"), plain).otherwise(_once(_once(plain, taken_apart), moved))


def significant(number: Column, digits: int = 6) -> Column:
    """Text at ``digits`` significant digits without trailing zeros, with an exponent below 0.0001
    and from 10 ** digits on. Null and NaN give null. A number whose shortest decimal form ends in
    a 5 just behind the last kept digit is rounded up, whatever its binary form."""

    def taken_apart(rounded: Column) -> Column:
        kept = _stripped(F.replace(F.split_part(rounded, F.lit("e"), F.lit(1)), F.lit("."), F.lit("")))
        return F.struct(F.split_part(rounded, F.lit("e"), F.lit(2)).try_cast("int").alias("e"), kept.alias("kept"))

    def shown(parts: Column) -> Column:
        e, kept = parts["e"], parts["kept"]
        return F.when((e < -4) | (e >= digits), _scientific(kept, e)).otherwise(_placed(kept, e))

    rounded = F.format_string(f"%.{digits - 1}e", F.abs(number.cast("double")))
    text = _once(_once(rounded, taken_apart), shown)
    sign = F.when(number < 0, "-").otherwise("")
    return F.when(number.isNotNull() & ~F.isnan(number.cast("double")), F.concat(sign, text))
