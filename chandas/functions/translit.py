"""Roman (IAST) to Devanagari as a chain of string replacements, and the units at word boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# Independent vowels, vowel signs (a has none), consonants.
VOWELS = dict(zip("a ā i ī u ū ṛ ṝ ḷ ḹ e ai o au".split(), "अ आ इ ई उ ऊ ऋ ॠ ऌ ॡ ए ऐ ओ औ".split()))
SIGNS = dict(zip("ā i ī u ū ṛ ṝ ḷ ḹ e ai o au".split(), "ा ि ी ु ू ृ ॄ ॢ ॣ े ै ो ौ".split())) | {"a": ""}
CONSONANTS = dict(zip(
    "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h".split(),
    "क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह".split(),
))
#: ṭh and ḍh are never joined in a word; each of their letters counts by itself.
PAIRS = [k for k in CONSONANTS if len(k) == 2 and k not in ("ṭh", "ḍh")] + ["ai", "au"]
_HOLD = {p: chr(0xE000 + i) for i, p in enumerate(PAIRS)}
_ONE = lambda u: _HOLD.get(u, u)
_V = "".join(_ONE(v) for v in VOWELS)
_END = "ṃṁḥ'’"
_C = rf"[^{_V}{_END}\s]"


def to_dev(c: Column) -> Column:
    """Devanagari spelling. A word's last consonant gets no virama; unknown characters count as consonants and stay."""
    s = c
    for pair, held in _HOLD.items():
        s = F.replace(s, F.lit(pair), F.lit(held))
    s = F.regexp_replace(s, f"[{text.MARKS}{text.BARS}]", "")
    s = F.regexp_replace(s, f"({_C})(?={_C})", "$1्")
    s = F.regexp_replace(s, f"(?<={_C})([{_V}])", "\x01$1")
    for v, sign in SIGNS.items():
        s = F.replace(s, F.lit("\x01" + _ONE(v)), F.lit(sign))
    plain = {_ONE(k): d for k, d in (VOWELS | CONSONANTS).items() if len(_ONE(k)) == 1} | {"ṃ": "ं", "ṁ": "ं", "ḥ": "ः", "'": "ऽ", "’": "ऽ"}
    s = F.translate(s, "".join(plain), "".join(plain.values()))
    return F.array_join(text.split_words(s), " ")


def boundary_units(c: Column) -> Column:
    """Units of a word for sandhi: aspirates joined, without accents, bars and apostrophes."""
    units = F.regexp_extract_all(c, F.lit("(?s)([kgcjtdpb]h|ai|au|.)"), F.lit(1))
    return F.filter(units, lambda u: ~u.isin(*text.MARKS, *text.BARS, "'", "’"))


def first_unit(c: Column) -> Column:
    return F.coalesce(F.try_element_at(boundary_units(c), F.lit(1)), F.lit(""))


def last_unit(c: Column) -> Column:
    return F.coalesce(F.try_element_at(boundary_units(c), F.lit(-1)), F.lit(""))
