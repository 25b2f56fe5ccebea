"""Search requests in words, and their execution as filters over verses and words.

mode="reference" searches what the original program effectively searches: a word's Devanagari surface, and its
aligned Roman words spelled in Devanagari; regular expressions work on bytes. mode="corrected" also searches the
aligned Roman text, counts clusters on it, and uses code points.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chandas.functions import phonology as P
from chandas.functions import text

from . import align

# Phrases that name a kind of search, most specific first; any of a kind's phrases selects it.
PHRASES = [
    ("prefix", ["words beginning with", "words starting with", "beginning with", "starting with"]),
    ("suffix", ["words ending with", "ending with"]),
    ("cluster", ["consonant clusters of length >="]),
    ("class", ["phoneme class"]),
    ("manner", ["manner of articulation"]),
    ("regex", ["vowel span patterns"]),
    ("verse", ["find all verses containing"]),
    ("word", ["find all occurrences of"]),
    ("word", ["find words containing"]),
    ("verse", ["find verses containing"]),
    ("word", ["containing"]),
]
_WHITE = " \t\n\x0b\f\r"
NOT_UNDERSTOOD = "Could not understand the search request."


@dataclass(frozen=True)
class Request:
    kind: str
    value: str = ""
    number: int = 0


def help_text() -> str:
    """What is said when a request can't be understood: one example of each kind."""
    values = {"prefix": "pra", "suffix": "ti", "cluster": "3", "class": "velar", "manner": "nasals", "regex": "a.i", "verse": "soma", "word": "agni"}
    shown = {kind: f"  {phrases[0]} {values[kind]}" for kind, phrases in reversed(PHRASES)}
    return "\n".join([NOT_UNDERSTOOD, "Examples:", *shown.values()])


def _fold(s: str) -> str:
    return s.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def clean_value(raw: str) -> str:
    """Outer quotes off, then trailing ASCII punctuation but ] and ), one leading hyphen, and the word `particular`."""
    v = raw.strip(_WHITE)
    while v and v[0] == v[-1] and v[0] in "\"'`":
        v = v[1:-1].strip(_WHITE)
    v = v.rstrip("".join(set(string.punctuation) - set("])"))).strip(_WHITE)
    if v.startswith("-"):
        v = v[1:].strip(_WHITE)
    return v[11:].strip(_WHITE) if _fold(v).startswith("particular ") else v


def parse(query: str) -> Request | None:
    """The request a text stands for; None if it can't be understood."""
    q = query.strip(_WHITE)
    low = _fold(q)
    after = lambda phrase: clean_value(q[low.index(phrase) + len(phrase) :]) if phrase in low else ""
    kind, phrases = next(((k, p) for k, p in PHRASES if any(x in low for x in p)), ("word", []))
    value = next(filter(None, map(after, phrases)), "") if phrases else clean_value(q)
    if kind == "regex" and not value:
        value = clean_value(q[low.index("pattern") + len("patterns") :])
    if kind == "cluster":
        return Request(kind, number=int(value)) if re.fullmatch("[0-9]+", value) else None
    return Request(kind, value) if value else None


def _cluster(unit_text: Column) -> Column:
    """Longest run of units that are neither vowels nor bars."""
    runs = F.split(unit_text, f"ai|au|[aāiīuūṛṝḷeo]|[{text.BARS}]")
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def cluster_length(mode: str = "reference") -> Column:
    """Longest cluster of a word frame's row."""
    return _cluster(F.col("text" if mode == "reference" else "roman"))


def word_frame(verses: DataFrame, keys: list[str], aligned: bool = True) -> DataFrame:
    """Words with text, surface (spelling searched beside the text), roman and iast_word. aligned=False leaves out the alignment, for kinds that test the text alone."""
    if aligned:
        w = align.aligned_words(verses, keys)
        surface = F.coalesce(F.nullif("underlying_dev_text", F.lit("")), "text")
        return w.select(*keys, "word_ord", "text", surface.alias("surface"), F.col("aligned_iast_underlying").alias("roman"), "iast_word")
    w = verses.select(*keys, text.words(text.line(verses, "iast")).alias("_i"), F.posexplode(text.words(text.line(verses, "dev"))).alias("word_ord", "text"))
    return w.select(*keys, "word_ord", "text", F.col("text").alias("surface"), F.lit("").alias("roman"), F.try_element_at("_i", F.col("word_ord") + 1).alias("iast_word"))


def predicate(r: Request, mode: str = "reference") -> Column:
    """Condition on a word frame's row (kind verse: on a verse's)."""
    if r.kind == "verse":
        return _any(lambda c: text.contains_text(c, r.value), "dev", "iast", "eng")
    places = ["surface", "text"] + (["roman"] if mode == "corrected" else [])
    if r.kind in ("word", "prefix", "suffix"):
        test = {"word": text.contains_text, "prefix": text.starts_with_text, "suffix": text.ends_with_text}[r.kind]
        return _any(lambda c: test(c, r.value), *places)
    if r.kind == "regex":
        if mode == "corrected":
            return _any(lambda c: c.rlike(_pattern(r, mode)), *places)
        return _any(lambda c: text.bytes_view(c).rlike(_pattern(r, mode)), *places)
    if r.kind == "cluster":
        return cluster_length(mode) >= r.number
    letters = P.dev_values(F.col("text"))
    if r.kind == "class":
        wanted = F.lit(_fold(r.value))
        return F.exists(letters, lambda x: text.fold_ascii(P.phoneme_class(x)) == wanted)
    classes = P.manner_classes(r.value.strip(_WHITE))
    return F.exists(letters, lambda x: P.phoneme_class(x).isin(*classes)) if classes else F.lit(False)


def _any(test, *columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(test(F.col(c)), F.lit(False))
    return out


# What is said of a match of each kind; of a cluster its length.
DETAILS = {
    "verse": "matched verse text", "word": "matched word text", "prefix": "matched prefix", "suffix": "matched suffix", "regex": "matched regex pattern", "class": "matched phoneme class",
    "manner": "matched manner of articulation",
}
BAD_PATTERN = "The regex pattern could not be compiled. Use a valid ECMAScript regex such as śr[aā]ddh."


def bad_pattern(verses: DataFrame, request: Request, mode: str = "reference") -> str | None:
    """What is said of a regular expression that can't be compiled; None for all other requests. Nothing is evaluated."""
    if request.kind != "regex":
        return None
    try:
        verses.sparkSession._jvm.java.util.regex.Pattern.compile(_pattern(request, mode))
    except Exception:  # py4j's error class differs between versions
        return BAD_PATTERN
    return None


def _pattern(r: Request, mode: str) -> str:
    return "(?d)" + (r.value if mode == "corrected" else r.value.encode("utf-8").decode("latin-1"))  # byte 0x85 is no line end here


def search(verses: DataFrame, request: Request, keys: list[str], mode: str = "reference") -> DataFrame:
    """Matches: keys, word_ord (null for verse matches), dev_word, iast_word, verse_dev, verse_iast, detail. Narrow: no shuffle.

    verses: keys, dev, iast, eng; any label wanted in the result is passed as a key. Null lines match nothing. dev_word
    is the surface: the aligned Roman words in Devanagari, or else the text. Words are aligned for every kind, since
    the result shows the surface. A regular expression that can't be compiled matches nothing: see bad_pattern.
    """
    lines = [F.col("dev").alias("verse_dev"), F.col("iast").alias("verse_iast")]
    if request.kind == "verse":
        found = verses.filter(predicate(request, mode))
        return found.select(*keys, F.lit(None).cast("int").alias("word_ord"), F.lit("").alias("dev_word"), F.lit("").alias("iast_word"), *lines, F.lit(DETAILS["verse"]).alias("detail"))
    w = word_frame(verses.select("*", *lines), [*keys, "verse_dev", "verse_iast"])
    w = w.filter(F.lit(False) if bad_pattern(verses, request, mode) else predicate(request, mode))
    detail = F.concat(F.lit("cluster length "), cluster_length(mode).cast("string")) if request.kind == "cluster" else F.lit(DETAILS[request.kind])
    return w.select(*keys, "word_ord", F.col("surface").alias("dev_word"), F.coalesce("iast_word", "text").alias("iast_word"), "verse_dev", "verse_iast", detail.alias("detail"))


def coverage(hymns: DataFrame, verses: DataFrame, matches: DataFrame) -> DataFrame:
    """hymn_index, matches, matched_verses (distinct verse numbers), total_verses, coverage (3 decimals) of every hymn, zeros too."""
    m = matches.groupBy("hymn_index").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct("verse_number").alias("matched_verses"))
    t = verses.groupBy("hymn_index").agg(F.count(F.lit(1)).alias("total_verses"))
    out = hymns.select("hymn_index").join(m, "hymn_index", "left").join(t, "hymn_index", "left").na.fill(0, ["matches", "matched_verses", "total_verses"])
    share = F.when(F.col("total_verses") > 0, F.round(F.col("matched_verses") / F.col("total_verses"), 3)).otherwise(F.lit(0.0))
    return out.withColumn("coverage", share)


def describe(r: Request) -> str:
    """What a request searches, as headings say it (fixed wording)."""
    named = {
        "verse": "verse text contains", "word": "word contains", "prefix": "word begins with", "suffix": "word ends with", "regex": "vowel/span regex", "class": "phoneme class", "manner": "manner",
    }
    return f"consonant cluster length >= {r.number}" if r.kind == "cluster" else f'{named[r.kind]} "{r.value}"'
