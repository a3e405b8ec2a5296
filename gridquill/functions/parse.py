"""Reading typed values from text written in the usual ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Usual spellings of truth values.
TRUE_WORDS = ("true", "t", "yes", "y", "on", "1")
FALSE_WORDS = ("false", "f", "no", "n", "off", "0")

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_GROUPED = r"^[+-]?[0-9]{1,3}(?:([,_'   ])[0-9]{3})(?:\1[0-9]{3})*(?:\.[0-9]*)?$"
_UNDERSCORED = r"^[+-]?[0-9]+(?:_[0-9]+)+(?:\.[0-9]*)?$"
_INSTANT = (r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})"
            r"(?:[Tt ]+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?)?"
            r"\s*([Zz]|UTC|GMT|[+-][0-9]{2}(?::?[0-9]{2})?)?$")
#: Instants of the years 1 to 9999, the ones that can be written; ms.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999
#: Bare numbers from here on are epoch milliseconds, below it seconds.
_MILLIS_FROM = 100_000_000_000


def stripped(text: Column) -> Column:
    """Text without surrounding white space of any kind; null if nothing is left."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(bare != "", bare)


def number_text(text: Column) -> Column:
    """The number's plain spelling without group separators, or null if it is none."""
    t = stripped(text)
    ungrouped = F.regexp_replace(t, r"[,_'   ]", "")
    return F.when(t.rlike(_NUMBER), t).when(t.rlike(_GROUPED) | t.rlike(_UNDERSCORED), ungrouped)


def to_double(text: Column) -> Column:
    """A finite double, or null."""
    x = number_text(text).try_cast("double")
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def to_bigint(text: Column) -> Column:
    """A whole number in range, or null; ``12.0`` and ``12e1`` are whole."""
    plain = number_text(text)
    exact = plain.try_cast("decimal(38,9)")
    whole = F.when(exact == F.floor(exact), exact).try_cast("bigint")
    return F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.try_cast("bigint")).otherwise(whole)


def to_boolean(text: Column) -> Column:
    word = F.lower(stripped(text))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def to_epoch_ms(text: Column) -> Column:
    """Epoch milliseconds of an instant, or null; without an offset it is UTC."""
    t = stripped(text)

    def part(i: int) -> Column:
        return F.regexp_extract(t, _INSTANT, i)

    def two(i: int) -> Column:
        return F.lpad(F.when(part(i) == "", F.lit("00")).otherwise(part(i)), 2, "0")

    zone = F.upper(part(8))
    digits = F.regexp_replace(zone, "[^0-9]", "")
    offset = F.when(zone.isin("", "Z", "UTC", "GMT"), F.lit("+00:00")).otherwise(
        F.concat(F.substring(zone, 1, 1), F.substring(digits, 1, 2), F.lit(":"),
                 F.when(F.length(digits) == 4, F.substring(digits, 3, 2)).otherwise(F.lit("00"))))
    # six decimals at most reach the cast; the rest cannot change whole milliseconds
    fraction = F.when(part(7) == "", F.lit("")).otherwise(F.concat(F.lit("."), F.substring(part(7), 1, 6)))
    iso = F.concat(part(1), F.lit("-"), two(2), F.lit("-"), two(3), F.lit("T"), two(4), F.lit(":"), two(5), F.lit(":"),
                   two(6), fraction, offset)
    written = F.when(t.rlike(_INSTANT), F.unix_millis(iso.try_cast("timestamp")))
    bare = F.when(t.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?$"), t.try_cast("decimal(38,6)"))
    scaled = F.when(F.abs(bare) >= _MILLIS_FROM, bare).otherwise(bare * 1000)
    return F.coalesce(written, F.floor(scaled).try_cast("bigint"))
