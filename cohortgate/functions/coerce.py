"""Booleans and numbers from text, and predicates that never become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortgate.fixed_values import FALSE_WORDS, TRUE_WORDS


def holds(predicate: Column) -> Column:
    """A gate: null (missing evidence) counts as not passed."""
    return F.coalesce(predicate, F.lit(False))


def number(column: Column) -> Column:
    """NaN becomes null, so that comparisons treat it as missing evidence."""
    return F.nanvl(column, F.lit(None).cast("double"))


def _word(column: Column) -> Column:
    return F.upper(F.trim(column.cast("string")))


def strict_bool(column: Column) -> Column:
    """Boolean words; anything else is null. Pair with :func:`unrecognised_bool`."""
    return F.when(_word(column).isin(TRUE_WORDS), True).when(_word(column).isin(FALSE_WORDS), False)


def unrecognised_bool(column: Column) -> Column:
    return strict_bool(column).isNull()


def strict_bool_or_fail(column: Column, name: str) -> Column:
    """Boolean words; any other value stops the job."""
    message = F.concat(F.lit(f"{name}: boolean value not recognised: "), F.coalesce(column, F.lit("null")))
    return F.coalesce(strict_bool(column), F.raise_error(message).cast("boolean"))


def qc_bool(column: Column, default: bool) -> Column:
    """Sample-QC flags: only true/false/1/0 are read, the rest takes the fail-closed default."""
    word = F.lower(F.trim(column.cast("string")))
    return F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False).otherwise(default)


def projection_bool(column: Column, fallback: Column | bool) -> Column:
    """Null takes the fallback; unknown words become false."""
    spare = fallback if isinstance(fallback, Column) else F.lit(fallback)
    filled = F.coalesce(column.cast("string"), spare.cast("string"))
    return F.coalesce(strict_bool(filled), F.lit(False))


def manifest_flag(column: Column) -> Column:
    """Normalised TRUE/FALSE text as a boolean; missing is false."""
    return holds(_word(column) == "TRUE")


def optional_number(column: Column) -> Column:
    """Null, blank, ``NA`` and NaN become null; any other text that is no number stops the job."""
    text = F.trim(column.cast("string"))
    given = F.when(~text.isin("", "NA"), text)
    value = given.try_cast("double")
    junk = F.raise_error(F.concat(F.lit("not a number: "), given)).cast("double")
    return number(F.when(given.isNotNull() & value.isNull(), junk).otherwise(value))
