"""Padas, syllable counts and meters of verses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phonology as P
from . import syllables, text

# Syllables of each pada, in order of priority.
PATTERNS = {
    "Gayatri": [8, 8, 8], "Anustubh": [8, 8, 8, 8], "Brhati": [8, 8, 8, 12], "Pankti": [8, 8, 8, 8, 8], "Tristubh": [11, 11, 11, 11],
    "Jagati": [12, 12, 12, 12], "Ushnih-like": [8, 8, 12, 8],
}
NONE = "No Meter Detected"
_EMPTY = "array<int>"


def segments(line: Column) -> Column:
    """Text between bars; empty parts are dropped, blank ones stay."""
    return F.filter(F.split(line, f"[{text.BARS}]"), lambda x: x != "")


def iast_counts(line: Column) -> Column:
    """Syllables of each segment of a Roman line; a null line has none."""
    per = lambda s: F.aggregate(text.words(s), F.lit(0), lambda a, w: a + syllables.iast_count(w))
    return F.coalesce(F.transform(segments(line), per), F.array().cast(_EMPTY))


_NO_COUNT = "".join(P.DEV_VOWELS + P.DEV_SIGNS + P.DEV_CODA_MARKS) + P.VIRAMA + P.AVAGRAHA + text.BARS


def dev_counts(line: Column) -> Column:
    """Syllables of each segment of a Devanagari line: vowels, and consonants without virama; accent marks count."""
    rule = f"(?s)[{''.join(P.DEV_VOWELS)}]|[^{_NO_COUNT}](?!{P.VIRAMA})"
    per = lambda s: F.aggregate(text.words(s), F.lit(0), lambda a, w: a + F.regexp_count(w, F.lit(rule)))
    return F.coalesce(F.transform(segments(line), per), F.array().cast(_EMPTY))


def _step(k: int, want: Column):
    """From the states before a word, as pada * 100 + syllables so far, to those after it; full padas close."""

    def step(states, x):
        options = lambda s: F.when(x["r"], F.array(s + x["n"], s + x["n"] - 1)).otherwise(F.array(s + x["n"]))
        pada = lambda t: F.floor(t / 100).cast("int")
        target = lambda t: F.try_element_at(want, pada(t) + 1)
        grown = F.filter(F.flatten(F.transform(F.filter(states, lambda s: s < k * 100), options)), lambda t: t % 100 <= target(t))
        return F.array_distinct(F.transform(grown, lambda t: F.when(t % 100 == target(t), (pada(t) + 1) * 100).otherwise(t)))

    return step


def infer(words: Column) -> Column:
    """The first pattern whose padas a Roman line's words fill exactly, in order; null if none.

    A word of more than one syllable that ends in `a` may count one less. Sets of states (pada, syllables so far) are
    carried from word to word: at most a few dozen whatever the line's length.
    """
    n = syllables.iast_count
    some = F.filter(F.transform(words, lambda w: F.struct(n(w).alias("n"), (w.endswith("a") & (n(w) > 1)).alias("r"))), lambda x: x["n"] > 0)
    return text.let(some, _first_fit)


def _first_fit(some: Column) -> Column:
    total = F.aggregate(some, F.lit(0), lambda a, x: a + x["n"])
    less = F.size(F.filter(some, lambda x: x["r"]))
    out = F.lit(None).cast(_EMPTY)
    for pattern in reversed(PATTERNS.values()):
        k, want = len(pattern), F.array(*map(F.lit, pattern))
        fits = F.array_contains(F.aggregate(some, F.array(F.lit(0)), _step(k, want)), k * 100)
        admissible = (F.lit(sum(pattern)) <= total) & (F.lit(sum(pattern)) >= total - less)
        out = F.when(admissible & fits, want).otherwise(out)
    return out


def pada_counts(dev: Column, iast: Column, spoken: Column | None = None) -> Column:
    """Explicit counts of three or more segments; else the inferred pattern; else explicit counts, if any; else from Devanagari.

    spoken: the text whose words the pattern is inferred from, if it isn't the Roman line (repeated lines add words).
    """
    found = infer(text.words(F.coalesce(iast if spoken is None else spoken, F.lit(""))))
    choose = lambda x: F.when(F.size(x) >= 3, x).otherwise(F.coalesce(found, F.when(F.size(x) > 0, x), dev_counts(dev)))
    return text.let(iast_counts(iast), choose)


def detect(counts: Column) -> Column:
    """Name of the meter of pada counts."""
    return text.let(counts, _name)


def _name(counts: Column) -> Column:
    size = F.size(counts)
    within = lambda *n: (size > 0) & F.forall(counts, lambda x: x.isin(*n))
    has = lambda n: F.array_contains(counts, n)
    (name, pattern), *rest = PATTERNS.items()
    out = F.when(counts == F.array(*map(F.lit, pattern)), name)
    for name, pattern in rest:
        out = out.when(counts == F.array(*map(F.lit, pattern)), name)
    return (
        out.when((size == 4) & within(10, 11) & has(10), "Nicrd Tristubh")
        .when((size == 4) & within(11, 12) & has(11) & has(12), "Tristubh-Jagati Mixed")
        .when((size == 3) & within(7, 8) & has(7), "Nicrd Gayatri")
        .when((size == 4) & within(7, 8) & has(7), "Nicrd Anustubh")
        .otherwise(NONE)
    )


def format_counts(counts: Column) -> Column:
    return F.array_join(counts.cast("array<string>"), "-")
