"""One form for text that looks the same but is made of other characters.

Every value gets a look-alike-mapped form. Mapped forms are grouped in SQL under the accent-sensitive Unicode
collation, each class gets a deterministic canonical member, and it is joined back to the values.

The collation ignores the two Devanagari accent marks; they are replaced by marks it does tell apart while grouping,
so that accented and plain lines stay different.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from chandas.common import cut

# Letters of other alphabets that look like a Latin one.
LETTERS = {
    "а": "a", "ɑ": "a", "α": "a", "с": "c", "ϲ": "c", "ԁ": "d", "ɗ": "d", "е": "e", "ҽ": "e", "ɡ": "g", "ց": "g", "һ": "h", "հ": "h",
    "і": "i", "ı": "i", "ɩ": "i", "ι": "i", "ј": "j", "ϳ": "j", "к": "k", "κ": "k", "ӏ": "l", "ǀ": "|", "м": "m", "ո": "n", "ղ": "n", "о": "o",
    "ο": "o", "օ": "o", "ഠ": "o", "р": "p", "ρ": "p", "г": "r", "ѕ": "s", "ꜱ": "s", "т": "t", "τ": "t", "υ": "u", "ս": "u", "ʋ": "v", "ν": "v",
    "ѵ": "v", "у": "y", "ү": "y", "γ": "y", "ӯ": "ȳ",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "ʼ": "’", "ˈ": "’", "′": "’", "＇": "’", "ʹ": "’", "‛": "’", "∣": "|", "│": "|", "❘": "|", "ǁ": "||", "‖": "||", "∥": "||", "¦": "|",
}
# Devanagari sequences drawn like one vowel or sign, and signs drawn like the visarga.
SEQUENCES = {
    "अा": "आ", "अो": "ओ", "अौ": "औ", "आे": "ओ", "आै": "औ", "एे": "ऐ", "अाे": "ओ", "अाै": "औ", "ाे": "ो", "ाै": "ौ", "ेा": "ो", "ैा": "ौ",
    "ेे": "ै", "ोे": "ौ", "र्इ": "ई", "उू": "ऊ", "ऋृ": "ॠ", "ृृ": "ॄ", "।।": "॥",
}
VISARGA = ":꞉：∶ː"

# The ordinary letters of Roman lines; what stands for an avagraha or a bar is added to them.
ROMAN = "aāiīuūṛṝḷḹeokgṅcjñṭḍṇtdnpbmyrlḻvśṣshṃṁḥ"

_PLAIN = re.compile("[a-zA-ZāīūṛṝḷḹṅñṭḍṇśṣḥṃṁḻĀĪŪṚṬḌṆŚṢ’ |\u030d\u0331\u0900-\u093b\u093d-\u0957\u0960-\u097f]*")
_ODD_MARK = re.compile("(?<![aeiou])\u0331|[\u030d\u0331\u0951\u0952]{2}")


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters and marks of other alphabets, with the ordinary character each looks like by the Unicode confusables data.

    Two characters look alike if their skeletons are equal. Of several ordinary characters with one skeleton the first
    counts: small letters before capitals. Devanagari's own letters, digits of any kind, superscripts and subscripts
    are visibly others and are left alone. Signs that look like a colon are given as `:`. One call, a few hundred rows.
    """
    chars = [chr(i) for i in (0x27, 0x60, *range(0xA0, 0xD800), *range(0xF900, 0x1FFFF))]
    chars = [c for c in chars if unicodedata.category(c)[0] in "LMPS" and not _NEVER.match(c)]
    ordinary = [*ROMAN, *ROMAN.upper(), "’", *map(chr, [0x30D, 0x331, *range(0x904, 0x93A), *range(0x93E, 0x94D)]), ":"]
    checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    skeletons = checker.getSkeleton("\n".join(ordinary + chars)).split("\n")
    target: dict[str, str] = {}
    for c, sk in zip(ordinary, skeletons):
        target.setdefault(sk, c)
    got = {c: target[sk] for c, sk in zip(chars, skeletons[len(ordinary) :]) if sk in target and not _PLAIN.fullmatch(c)}
    return {c: t for c, t in got.items() if unicodedata.decomposition(c).partition(" ")[0] not in ("<super>", "<sub>")} | LETTERS


#: Devanagari, its extended blocks, and the signs of the Vedic texts.
_NEVER = re.compile("[\u0900-\u097f\u1cd0-\u1cff\ua8e0-\ua8ff]")


def _looks_alike(c: str, letters: dict[str, str]) -> str | None:
    """What a single character is mapped to, if anything."""
    if c in letters and letters[c] != ":":
        return letters[c]
    cat = unicodedata.category(c)
    if cat == "Cf" or c in "͏᠋᠌᠍ᅟᅠㅤ" or "\ufe00" <= c <= "\ufe0f" or (cat == "Cc" and not c.isspace()):
        return ""
    if cat in ("Zs", "Zl", "Zp") or (c.isspace() and c != " "):
        return " " if c != " " else None
    # full-width, half-width and mathematical forms of letters and signs; not superscripts, fractions and the like
    if unicodedata.decomposition(c).partition(" ")[0] in ("<wide>", "<narrow>", "<font>"):
        return "".join(letters.get(x, x) for x in unicodedata.normalize("NFKC", c))
    return None


_RUNS = re.compile("|".join(sorted(map(re.escape, SEQUENCES), key=len, reverse=True)))


class Mapper:
    """Ordinary spellings of texts, by a table of look-alike letters; ordinary text is its own spelling."""

    def __init__(self, letters: dict[str, str] = LETTERS):
        self.letters = letters
        colons = "".join({":", *VISARGA, *(c for c, t in letters.items() if t == ":")})
        self.colon = re.compile(f"(?<=[\u0900-\u097f])[{re.escape(colons)}]")
        self.table: dict[int, int | str] = {}

    def __getitem__(self, k: int):
        """str.translate's table, filled as characters are met."""
        x = self.table.get(k)
        if x is None:
            x = _looks_alike(chr(k), self.letters)
            x = self.table[k] = k if x is None else x
        return x

    def __call__(self, text: str) -> str:
        if _PLAIN.fullmatch(text) and not _RUNS.search(text) and not (("\u0331" in text or "\u0951" in text) and _ODD_MARK.search(text)):
            return text
        t = unicodedata.normalize("NFC", self.colon.sub("ः", text).translate(self))
        while (u := _RUNS.sub(lambda m: SEQUENCES[m.group()], t)) != t:
            t = u
        return unicodedata.normalize("NFC", self.colon.sub("ः", t))


def _block(form: str) -> int:
    """A number that forms equal under the collation always share: the hash of what has a primary weight, without case."""
    import xxhash

    n = xxhash.xxh64_intdigest(_WEIGHTLESS.sub("", unicodedata.normalize("NFKD", form)).casefold())
    return n - (n >> 63 << 64)


#: Marks, and what is neither letter, digit, sign nor space; vowel signs have weights of their own.
_WEIGHTLESS = re.compile("[" + "".join(re.escape(chr(i)) for i in range(0x3100) if unicodedata.category(chr(i))[0] in "MC" and not 0x93E <= i <= 0x94C) + "\u200b-\u200f\ufe00-\ufe0f\ufeff]+")


def with_mapped(values: DataFrame) -> DataFrame:
    """Adds `mapped` (null where the value is its own ordinary spelling) and `block`. One narrow pass."""
    letters = confusables(values.sparkSession)

    def run(batches):
        import pyarrow as pa

        of = Mapper(letters)
        for b in batches:
            texts = b.column(2).to_pylist()
            forms = [of(v) for v in texts]
            out = [None if f == v else f for f, v in zip(forms, texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string()), pa.array(map(_block, forms), pa.int64())], names=["field_name", "row_id", "value", "mapped", "block"])

    v = values.select("field_name", "row_id", "value").filter("value is not null")
    return v.mapInArrow(run, T.StructType([*v.schema.fields, T.StructField("mapped", T.StringType()), T.StructField("block", T.LongType())]))


#: Blocks of more than one form; only their forms can be equal under the collation without being the same.
BLOCKS = "SELECT block FROM {values} GROUP BY block HAVING min(xxhash64(coalesce(mapped, value))) <> max(xxhash64(coalesce(mapped, value)))"
FORMS = "SELECT DISTINCT v.block, coalesce(v.mapped, v.value) AS form FROM {values} v LEFT SEMI JOIN {blocks} b ON v.block = b.block"
CLASSES = """
SELECT block, collate(translate(form, '॒॑', '̥̐'), 'UNICODE') AS class, min(form) AS canonical
FROM {forms} GROUP BY 1, 2 HAVING min(form) <> max(form)
"""
MEMBERS = """
SELECT f.form, c.canonical FROM {forms} f JOIN {classes} c ON f.block = c.block AND collate(translate(f.form, '॒॑', '̥̐'), 'UNICODE') = c.class
WHERE f.form <> c.canonical
"""
JOINED = """
SELECT v.field_name, v.row_id, v.value, coalesce(m.canonical, v.mapped, v.value) AS canonical, v.mapped IS NOT NULL AS odd
FROM {values} v LEFT JOIN {members} m ON coalesce(v.mapped, v.value) = m.form
"""


def canonical(values: DataFrame) -> DataFrame:
    """field_name, row_id, value, canonical, odd for every value that is not null.

    values: field_name, row_id, value. odd: the value holds characters or sequences that are not ordinary. Repeated
    rows stay repeated; a class's canonical member is the least of its mapped forms by code point. Forms are compared
    under the collation within blocks that equal forms share, and only blocks of several forms are looked at; only
    forms that are not their class's canonical member are joined back, so a spelling that a third of all rows share
    costs no join of its own.
    """
    spark = values.sparkSession
    v = cut(with_mapped(values))  # mapped once
    forms = spark.sql(FORMS, values=v, blocks=spark.sql(BLOCKS, values=v))
    members = spark.sql(MEMBERS, forms=forms, classes=spark.sql(CLASSES, forms=forms))
    return spark.sql(JOINED, values=v, members=members)
