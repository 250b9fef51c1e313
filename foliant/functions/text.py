"""Column builders for text: explicit character classes, the same in every engine.

Java's ``\\s`` is ASCII only and ``trim`` strips spaces only, so white space and
line ends are spelled out.  All functions treat a null text as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space and line ends of Unicode, in a syntax common to Java and RE2.
WS_SET = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_SET}]"
NOT_WS = f"[^{WS_SET}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: Private use, the replacement character, and controls other than tab and line ends.
SUSPICIOUS = r"[\x{e000}-\x{f8ff}\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f]"
#: Decimal digits, superscripts, subscripts and circled digits.
DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}]"
LETTER = r"\p{L}"


#: The same white space as characters.
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that filters behind them do not compute anew: a generator lies between."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")).select(*df.columns, *[F.col(f"_once.{n}") for n in columns])


def raw(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    return F.btrim(raw(text), F.lit(WS_CHARS))


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of a class a text has; by the length without them, so none becomes a string of its own."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).cast("bigint")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NOT_WS}+)"), 1)


def lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(raw(text), LINE_END), strip), lambda x: x != "")


def simple_normal(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscores as single blanks; built-in functions only."""
    return strip(F.regexp_replace(F.lower(raw(text)), r"[^\p{L}\p{M}\p{N}_]+", " "))
