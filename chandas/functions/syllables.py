"""Syllables of Devanagari and Roman words.

The left-to-right rules that cut a Devanagari word into syllables form a regular language over seven kinds of letters.
The word is coded with one character a letter, so that all syllables come out of one regular expression (JVM side,
inside code generation); letters are cut out by position only where they are asked for.

Kinds: A/B short or long vowel, s/S short or long vowel sign, m coda mark, x virama, b bar, C anything else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phonology as P
from . import text

_KINDS = {
    **{v: "A" for v in P.DEV_VOWELS}, **{v: "B" for v in P.DEV_LONG_VOWELS}, **{v: "s" for v in P.DEV_SIGNS}, **{v: "S" for v in P.DEV_LONG_SIGNS},
    **{v: "m" for v in P.DEV_CODA_MARKS}, P.VIRAMA: "x", **{b: "b" for b in text.BARS},
}
#: A syllable: bare consonants before a virama, the nucleus, its signs and coda; a consonant that neither a sign nor a virama follows ends it.
DEV_SYLLABLE = r"(?:C(?=x)|[xmb])*(?:C(?!x)|[ABsS])(?:[sSmxb]|C(?=[xsS]))*(?:C(?![xsS]))?"
_NUCLEUS_ONLY = r"^(?:C(?=x)|[xmb])*(?:C(?!x)|[ABsS])[xb]*$"


def dev_code(values: Column) -> Column:
    """Kinds of a word given without accent marks (string)."""
    # letters that happen to be Latin must not be taken for kinds: what isn't listed is a consonant
    masked = F.regexp_replace(values, "(?s)[^" + "".join(_KINDS) + "]", "C")
    return F.translate(masked, "".join(_KINDS), "".join(_KINDS.values()))


def _part(kind: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), kind)


def dev_part(letter: Column) -> Column:
    """What a Devanagari letter is in a syllable; whatever isn't listed is a consonant."""
    return _part(dev_code(letter), {"A": "vowel", "B": "long vowel", "s": "sign", "S": "long sign", "m": "coda mark", "x": "virama", "b": "bar", "C": "consonant"})


def iast_part(letter: Column) -> Column:
    """The same for a Roman letter."""
    return _part(_iast_code(F.array(letter)), {"v": "vowel", "w": "long vowel", "m": "coda mark", "b": "bar", "C": "consonant"})


def dev_tokens(code: Column) -> Column:
    """Each syllable's part of the code, in order and without gaps."""
    return F.regexp_extract_all(code, F.lit(DEV_SYLLABLE), F.lit(0))


def token_weight(token: Column) -> Column:
    """heavy or light: the last sign, coda mark or coda consonant decides; without any, the nucleus."""
    bare = F.regexp_replace(token, "[xb]", "")
    last = F.substring(bare, -1, 1)
    only_nucleus = token.rlike(_NUCLEUS_ONLY)
    return F.when(only_nucleus, F.when(last.isin("B", "S"), "heavy").otherwise("light")).otherwise(F.when(last == "s", "light").otherwise("heavy"))


def _plain(word: Column) -> Column:
    return F.regexp_replace(word, f"[{text.MARKS}]", "")


def dev_weights(word: Column) -> Column:
    """Weights of a Devanagari word's syllables."""
    return F.transform(dev_tokens(dev_code(_plain(word))), token_weight)


def dev_count(word: Column) -> Column:
    return F.size(dev_tokens(dev_code(_plain(word))))


def line_weights(words: Column) -> Column:
    """Weights of all syllables of a line's words."""
    return F.flatten(F.transform(words, dev_weights))


def _starts(tokens: Column) -> Column:
    """Place of each token's first letter, from 0, and of the end."""
    return F.aggregate(tokens, F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.length(t))))


def _pick(letters: Column, kinds: Column, *wanted: str) -> Column:
    return F.filter(letters, lambda x, j: F.try_element_at(kinds, j + 1).isin(*wanted))


def dev_syllables(word: Column) -> Column:
    """Array of syllable structs (onset, nucleus, coda, swaras, weight) of a Devanagari word."""

    def parts(x, t):
        """x: the syllable's letters, kinds, and number of letters before the nucleus."""
        n = x["before"]
        nucleus, kind = F.try_element_at(x["own"], n + 1), F.try_element_at(x["kinds"], n + 1)
        front = _pick(F.slice(x["own"], 1, n), x["kinds"], "C")
        onset = F.when(kind == "C", F.concat(front, F.array(nucleus))).otherwise(front)
        coda = _pick(F.slice(x["own"], n + 2, F.size(x["own"])), F.slice(x["kinds"], n + 2, F.size(x["kinds"])), "C", "m")
        swaras = F.when(kind.isin("s", "S"), F.array().cast("array<string>")).otherwise(F.array(nucleus["swara_type"]))
        return F.struct(onset.alias("onset"), nucleus.alias("nucleus"), coda.alias("coda"), swaras.alias("swaras"), token_weight(t).alias("weight"))

    def one(e, t, i):
        own = F.slice(e["letters"], F.try_element_at(e["starts"], i + 1) + 1, F.length(t))
        before = F.length(F.regexp_extract(t, r"^((?:C(?=x)|[xmb])*)", 1))
        return text.let(F.struct(own.alias("own"), F.split(t, "").alias("kinds"), before.alias("before")), lambda x: parts(x, t))

    return text.let(
        text.let(dev_tokens(dev_code(_plain(word))), lambda t: F.struct(P.dev_letters(word).alias("letters"), t.alias("tokens"), _starts(t).alias("starts"))),
        lambda e: F.transform(e["tokens"], lambda t, i: one(e, t, i)),
    )


_VOWEL_UNIT = "ai|au|[aāiīuūṛṝḷeo]"


def iast_count(word: Column) -> Column:
    """Syllables of a Roman word: its vowel units."""
    return F.regexp_count(word, F.lit(_VOWEL_UNIT))


def _iast_code(units: Column) -> Column:
    """Kinds of Roman units, one character each: v short vowel, w long vowel, m coda mark, b bar, C anything else."""

    def kind(u):
        long, short = F.lit("w"), F.lit("v")
        return (
            F.when(u.isin(*P.IAST_LONG_VOWELS), long).when(u.isin(*[v for v in P.IAST_VOWELS if v not in P.IAST_LONG_VOWELS]), short)
            .when(u.isin(*P.IAST_CODA_MARKS), "m").when(u.isin(*text.BARS), "b").otherwise("C")
        )

    return F.array_join(F.transform(units, kind), "")


def iast_syllables(word: Column) -> Column:
    """Array of (onset, nucleus, coda, weight) of Roman letters. Trailing consonants close the last syllable."""
    cut = lambda c: F.regexp_extract_all(c, F.lit(r"[Cbm]*[vw]m*(?:[Cbm]*$)?"), F.lit(0))

    def parts(x):
        n = x["before"]
        rest, kinds = F.slice(x["own"], n + 2, F.size(x["own"])), F.slice(x["kinds"], n + 2, F.size(x["kinds"]))
        # a coda mark that stands before the next vowel's consonants belongs to this syllable
        coda = F.concat(_pick(rest, kinds, "m"), _pick(x["follow"], F.split(x["after"], ""), "m"), _pick(rest, kinds, "C"))
        nucleus, long = F.try_element_at(x["own"], n + 1), F.try_element_at(x["kinds"], n + 1) == "w"
        out = lambda c: F.struct(_pick(F.slice(x["own"], 1, n), x["kinds"], "C").alias("onset"), nucleus.alias("nucleus"), c.alias("coda"), F.when((F.size(c) > 0) | long, "heavy").otherwise("light").alias("weight"))
        return text.let(coda, out)

    def one(e, t, i):
        start = lambda j: F.try_element_at(e["starts"], j + 1)
        after = F.coalesce(F.regexp_extract(F.try_element_at(e["tokens"], i + 2), "^([Cbm]*)", 1), F.lit(""))
        return text.let(
            F.struct(
                F.slice(e["units"], start(i) + 1, F.length(t)).alias("own"), F.split(t, "").alias("kinds"), F.length(F.regexp_extract(t, "^([Cbm]*)", 1)).alias("before"),
                after.alias("after"), F.slice(e["units"], start(i + 1) + 1, F.length(after)).alias("follow"),
            ),
            parts,
        )

    with_tokens = lambda u: text.let(cut(_iast_code(u)), lambda t: F.struct(u.alias("units"), t.alias("tokens"), _starts(t).alias("starts")))
    return text.let(text.let(P.iast_units(word), with_tokens), lambda e: F.transform(e["tokens"], lambda t, i: one(e, t, i)))
