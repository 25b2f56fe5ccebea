"""Tokenisation and scalar string functions. All built-in, code-point based; nulls stay null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accent marks (svarita twice, anudatta twice) and verse bars.
SVARITA, ANUDATTA = "॑̍", "॒̱"
MARKS = "॒̱॑̍"
BARS = "।॥|"
#: ASCII white space as the stream extraction of words sees it.
SPACE = r"[ \t\n\x0B\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often the body names it (lambdas would evaluate it anew)."""
    return F.transform(F.array(value), body)[0]


def split_code_points(c: Column) -> Column:
    """One element for each code point; an empty string gives an empty array."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def split_iast(c: Column) -> Column:
    """Code points, with `ai` and `au` as single units (greedy, left to right)."""
    return F.regexp_extract_all(c, F.lit("(?s)(ai|au|.)"), F.lit(1))


def split_words(c: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def clean_word(c: Column) -> Column:
    """Without trailing bars; blanks and leading bars stay."""
    return F.regexp_replace(c, f"[{BARS}]+$", "")


def words(c: Column) -> Column:
    """Cleaned words of a line, empty ones dropped."""
    return F.filter(F.transform(split_words(c), clean_word), lambda w: w != "")


def line(df: DataFrame, name: str) -> str:
    """The column that a verse's words are cut from: all its lines of that kind where a frame has them (dev_all), else the last."""
    return f"{name}_all" if f"{name}_all" in df.columns else name


def trim_ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def fold_ascii(c: Column) -> Column:
    """Lower case for A-Z only."""
    return F.translate(c, UPPER, LOWER)


def normal_surface(c: Column) -> Column:
    """For comparing Devanagari words: without accent marks and bars; spaces stay."""
    return F.regexp_replace(c, f"[{MARKS}{BARS}]", "")


def contains_text(hay: Column, needle: str, fold: bool = True) -> Column:
    """Substring test, A-Z without case; an empty needle never matches."""
    if needle == "":
        return F.lit(False)
    return fold_ascii(hay).contains(fold_ascii(F.lit(needle))) if fold else hay.contains(needle)


def starts_with_text(hay: Column, needle: str, fold: bool = True) -> Column:
    if needle == "":
        return F.lit(False)
    return fold_ascii(hay).startswith(fold_ascii(F.lit(needle))) if fold else hay.startswith(needle)


def ends_with_text(hay: Column, needle: str, fold: bool = True) -> Column:
    if needle == "":
        return F.lit(False)
    return fold_ascii(hay).endswith(fold_ascii(F.lit(needle))) if fold else hay.endswith(needle)


def bytes_view(c: Column) -> Column:
    """Each UTF-8 byte as one character, for byte-wise regular expressions."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def ngrams(units: Column, n: int) -> Column:
    """Overlapping runs of n units, joined. n = 0 gives size + 1 empty strings; n < 0 or n > size gives none."""
    if n < 0:
        return F.array().cast("array<string>")
    if n == 0:
        return F.array_repeat(F.lit(""), F.size(units) + 1)
    none = F.array().cast("array<int>")
    starts = lambda u: F.when(F.size(u) >= n, F.sequence(F.lit(1), F.size(u) - (n - 1))).otherwise(none)
    return let(units, lambda u: F.transform(starts(u), lambda i: F.array_join(F.slice(u, i, F.lit(n)), "")))
