"""Sound classes of letters, and letters with their accents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# The sound classes; letters of each in Devanagari and Roman, by vowel length or consonant place.
SHORT = "अ इ ि उ ु ऋ ृ ऌ ॢ a i u ṛ ḷ".split()
LONG = "आ ा ई ी ऊ ू ॠ ॄ ॡ ॣ ए े ओ ो ā ī ū ṝ ḹ e o".split()
DIPHTHONG = "ऐ ै औ ौ ai au".split()
CONSONANTS = {
    "Velar": "क ख ग घ k g", "Palatal": "च छ ज झ c j", "Retroflex": "ट ठ ड ढ ṭ ḍ", "Dental": "त थ द ध t d", "Labial": "प फ ब भ p b",
    "Nasal": "ङ ṅ ञ ñ ण ṇ न n म m ं ँ ṃ ṁ", "Semivowel": "य y व v", "Liquid": "र r ल l", "Sibilant": "श ś ष ṣ स s", "Aspirate": "ह ः h ḥ",
}
BASES = {
    "a": "अ आ ा a ā", "i": "इ ि ई ी i ī", "u": "उ ु ऊ ू u ū", "r": "ऋ ृ ॠ ॄ ṛ ṝ र r", "l": "ऌ ॢ ॡ ॣ ḷ ḹ ल l", "e": "ए े e", "o": "ओ ो o",
    "ai": "ऐ ै ai", "au": "औ ौ au", "k": "क ख ग घ ङ k g ṅ", "c": "च छ ज झ ञ c j ñ", "t": "ट ठ ड ढ ण ṭ ḍ ṇ त थ द ध न t d n",
    "p": "प फ ब भ म p b m", "y": "य y", "v": "व v", "s": "श ष स ś ṣ s", "h": "ह ः h ḥ", "m": "ं ँ ṃ ṁ",
}
#: Symbols of the consonant class sequence.
SYMBOLS = {"Velar": "V", "Palatal": "P", "Retroflex": "R", "Dental": "D", "Labial": "L", "Nasal": "N", "Semivowel": "S", "Liquid": "Q", "Sibilant": "X", "Aspirate": "H"}
# Letters by their part in a syllable.
DEV_VOWELS = "अ आ इ ई उ ऊ ऋ ॠ ऌ ॡ ए ऐ ओ औ".split()
DEV_LONG_VOWELS = "आ ई ऊ ॠ ॡ ए ऐ ओ औ".split()
DEV_SIGNS = "ा ि ी ु ू ृ ॄ ॢ ॣ े ै ो ौ".split()
DEV_LONG_SIGNS = "ा ी ू ॄ ॣ े ै ो ौ".split()
DEV_CODA_MARKS = "ं ः ँ".split()
VIRAMA, AVAGRAHA = "्", "ऽ"
IAST_VOWELS = "a ā i ī u ū ṛ ṝ ḷ e o ai au".split()
IAST_LONG_VOWELS = "ā ī ū e o ai au".split()
IAST_CODA_MARKS = "ṃ ṁ ḥ".split()
STOPS = ["Velar", "Palatal", "Retroflex", "Dental", "Labial"]

CLASS_OF = {x: "Vowel" for x in SHORT + LONG + DIPHTHONG} | {x: k for k, v in CONSONANTS.items() for x in v.split()}
BASE_OF = {x: k for k, v in BASES.items() for x in v.split()}
_CLASSES = ["Vowel", *CONSONANTS]


def _coded(c: Column, groups: list[list[str]]) -> Column:
    """1-based number of the group a unit belongs to, 0 for none: a hash lookup in translate(), not a chain of tests."""
    one = {x: chr(i + 1) for i, g in enumerate(groups) for x in g if len(x) == 1}
    code = F.ascii(F.translate(c, "".join(one), "".join(one.values())))
    out = F.when((F.length(c) == 1) & (code <= len(groups)), code)
    for i, g in enumerate(groups):
        two = [x for x in g if len(x) > 1]
        if two:
            out = out.when(c.isin(*two), F.lit(i + 1))
    return out.otherwise(F.lit(0))


def phoneme_class(c: Column) -> Column:
    """Vowel, a consonant class, or Other."""
    groups = [[x for x, k in CLASS_OF.items() if k == name] for name in _CLASSES]
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, _CLASSES)), F.nullif(_coded(c, groups), F.lit(0))), F.lit("Other"))


def vowel_length(c: Column) -> Column:
    """Short, Long, Diphthong, or None for what isn't a vowel."""
    names = F.array(*map(F.lit, ["Short", "Long", "Diphthong"]))
    return F.coalesce(F.try_element_at(names, F.nullif(_coded(c, [SHORT, LONG, DIPHTHONG]), F.lit(0))), F.lit("None"))


def phoneme_type(c: Column) -> Column:
    k = phoneme_class(c)
    return F.when(k == "Vowel", "Vowel").when(k == "Other", "Other").otherwise("Consonant")


def phoneme_base(c: Column) -> Column:
    """The sound a letter goes back to; other characters are their own."""
    names = list(BASES)
    groups = [BASES[n].split() for n in names]
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), F.nullif(_coded(c, groups), F.lit(0))), c)


def features(c: Column) -> Column:
    """Struct of type, class, consonantClass, vowelLength, base: one lookup for all of them."""
    names = ("type", "class", "consonantClass", "vowelLength", "base")

    def row(x):
        k = CLASS_OF[x]
        length = "Short" if x in SHORT else "Long" if x in LONG else "Diphthong" if x in DIPHTHONG else "None"
        return ("Vowel" if k == "Vowel" else "Consonant", k, "None" if k == "Vowel" else k, length, BASE_OF[x])

    known = list(CLASS_OF)
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row(x), names)]) for x in known])
    other = F.struct(*[F.lit(v).alias(n) for v, n in zip(("Other", "Other", "None", "None"), names)], c.alias("base"))
    return F.coalesce(F.try_element_at(table, F.nullif(_coded(c, [[x] for x in known]), F.lit(0))), other)


def letter(value: Column, marks: Column) -> Column:
    """LETTER of a Devanagari letter and the accent marks after it: the last mark counts, none means udatta."""
    last = F.substring(marks, -1, 1)
    kind = F.when(last.isin(*text.SVARITA), "svarita").when(last.isin(*text.ANUDATTA), "anudatta").otherwise("udatta")
    return F.struct(value.alias("value"), (F.length(marks) > 0).alias("has_swara"), kind.alias("swara_type"))


def marked_units(word: Column) -> Column:
    """Each letter with its accent marks; marks before the first letter are dropped."""
    return F.regexp_extract_all(word, F.lit(f"(?s)[^{text.MARKS}][{text.MARKS}]*"), F.lit(0))


def dev_letters(word: Column) -> Column:
    """Array of LETTER of a Devanagari word."""
    return F.transform(marked_units(word), lambda u: letter(F.substring(u, 1, 1), F.substring(u, 2, 1 << 30)))


def swara_of_unit(u: Column) -> Column:
    last = F.substring(u, -1, 1)
    return F.when(last.isin(*text.SVARITA), "svarita").when(last.isin(*text.ANUDATTA), "anudatta").otherwise("udatta")


def dev_values(word: Column) -> Column:
    """Letters of a Devanagari word without accents."""
    return text.split_code_points(F.regexp_replace(word, f"[{text.MARKS}]", ""))


def iast_units(word: Column) -> Column:
    """Roman letters without the combining accents."""
    return F.filter(text.split_iast(word), lambda u: ~u.isin("̍", "̱"))


def class_symbols(values: Column) -> Column:
    """Consonant class symbols of letters; vowels and others are skipped."""
    keep = F.filter(F.transform(values, phoneme_class), lambda k: ~k.isin("Vowel", "Other"))

    def symbol(k):
        (first, sign), *rest = SYMBOLS.items()
        pick = F.when(k == first, sign)
        for name, sign in rest:
            pick = pick.when(k == name, sign)
        return pick

    return F.transform(keep, symbol)


def manner_classes(manner: str) -> list[str]:
    """Classes that a manner of articulation (singular or plural, A-Z without case) stands for; unknown: none."""
    m = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in manner)
    m = m[:-1] if m.endswith("s") else m
    return {
        "stop": STOPS, "nasal": ["Nasal"], "sibilant": ["Sibilant"], "semivowel": ["Semivowel"], "liquid": ["Liquid"], "aspirate": ["Aspirate"],
        "vowel": ["Vowel"], "consonant": list(CONSONANTS),
    }.get(m, [])
