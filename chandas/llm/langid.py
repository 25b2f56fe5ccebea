"""Languages of documents and of their stretches: nearest clustered centroid of TF-IDF character n-grams.

Labelled samples become normalised TF-IDF vectors of hashed character trigrams; spherical k-means gives several
centroids a language (one language may be written in several scripts). A segment has the language of the centroid of
greatest cosine, and none if that cosine is below a limit learnt from the samples. Adjacent segments of one language
form a stretch.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows of each language the classifier is fitted on, and centroids a language.
FIT_ROWS, CLUSTERS, FIT_STEPS = 1000, 4, 10
BUCKETS = 1 << 15
#: A language is held if a stretch of at least this many characters is in it.
STRETCH = 60
#: Segments with fewer letters have no language of their own.
LEAST_LETTERS = 12
SEED = 20240501

# Codes and names of the languages told apart.
NAMES = {
    "sa": "sa san sanskrit samskrtam saṃskṛtam saṃskṛta संस्कृत संस्कृतम्",
    "hi": "hi hin hindi हिन्दी हिंदी",
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
}

_TAG = re.compile(r"^(?:(?:Mandala|Sukta|Devatas|Rishis|Categories):.*|\[(?:Verse|Hymn)[^\]]*\]|\s*)$")
_LEAD = re.compile(r"^(?:>\s*)?(?:(?:DEV|IAST|ENG):)?\s*")
_PAREN = re.compile(r"\([^()]*\)")
_CUT = re.compile(r"(?:[.;!?।॥]|\|+)(?=\s|$)|\n")


def standard_language(c: Column) -> Column:
    """The two-letter code of a language's code or name, with or without a region; null for anything else."""
    base = F.regexp_extract(F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")), r"^([^\-_\s]+)", 1)
    table = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in names.split() for x in (n, code)])
    return F.try_element_at(table, base)


def segments(text: str) -> list[tuple[int, int, str]]:
    """(from, to, cleaned text) of lines and sentences; tags, quotation marks at line starts and parentheses removed."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
            at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    got = []
    for a, z in out:
        raw = text[a:z]
        if _TAG.match(raw):
            continue
        lead = len(raw) - len(raw.lstrip())
        got.append((a + lead, a + len(raw.rstrip()), _PAREN.sub(" ", _LEAD.sub("", raw.strip()))))
    return got


class Classifier:
    """Fitted on (language, text) pairs; `score` labels many segments at once."""

    def __init__(self, samples: list[tuple[str, str]], clusters: int = CLUSTERS):
        import numpy as np

        self.languages = sorted({lang for lang, _ in samples})
        self.letters = self._letters()
        rows = [self._tf(t) for _, t in samples]
        df = np.zeros(BUCKETS)
        for g, _ in rows:
            df[g] += 1
        self.idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
        vec = np.zeros((len(rows), BUCKETS), np.float32)
        for i, (g, n) in enumerate(rows):
            vec[i, g] = n * self.idf[g]
        vec /= np.maximum(np.sqrt((vec * vec).sum(1)), 1e-9)[:, None]
        rng, centroids, owner = np.random.default_rng(SEED), [], []
        lab = np.array([self.languages.index(lang) for lang, _ in samples], int)
        for i in range(len(self.languages)):
            x = vec[lab == i]
            # far apart to begin with, so that scripts come apart
            pick = [int(rng.integers(len(x)))]
            while len(pick) < min(clusters, len(x)):
                pick.append(int(np.argmin((x @ x[pick].T).max(1))))
            c = x[pick]
            for _ in range(FIT_STEPS):
                near = np.argmax(x @ c.T, 1)
                c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
                c /= np.maximum(np.sqrt((c * c).sum(1)), 1e-9)[:, None]
            centroids.append(c)
            owner += [i] * len(c)
        cent = np.concatenate(centroids) if centroids else np.zeros((0, BUCKETS), np.float32)
        self.owner = np.array(owner, int)
        self.weights = np.ascontiguousarray((cent * self.idf).T.astype(np.float32))
        own = (vec @ cent.T).max(1) if len(cent) and len(vec) else np.zeros(1)
        #: Segments less alike to every centroid than a quarter of the least alike samples have no language.
        self.reject = float(np.quantile(own, 0.01)) / 4

    @staticmethod
    def _letters():
        """Lower-case letter, or a space, for each code point; 0 for what is left out (accents)."""
        import unicodedata

        import numpy as np

        table = np.full(0x3000, 32, np.int64)
        for i in range(0x3000):
            c = chr(i)
            if unicodedata.category(c)[0] in "LM":
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        for i in (0x951, 0x952, 0x30D, 0x331, 0x34F):
            table[i] = 0
        return table

    def _codes(self, texts: list[str]):
        """Letters of all texts, each text between spaces, and the number of the text each belongs to."""
        import numpy as np

        raw = np.frombuffer("".join(" " + t + " " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        seg = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
        code = np.where(raw < len(self.letters), self.letters[np.minimum(raw, len(self.letters) - 1)], raw)
        keep = code != 0
        keep[1:] &= (code[1:] != 32) | (code[:-1] != 32) | (seg[1:] != seg[:-1])
        return code[keep], seg[keep]

    @staticmethod
    def _grams(code, seg):
        h = (code[:-2] * 0x9E3779B1 + code[1:-1] * 0x85EBCA77 + code[2:] * 0xC2B2AE3D) & 0xFFFFFFFFFFFF
        h = ((h ^ (h >> 17)) * 0x27D4EB2F) >> 13
        whole = seg[:-2] == seg[2:]
        return (h & (BUCKETS - 1))[whole], seg[:-2][whole]

    def _tf(self, text: str):
        import numpy as np

        return np.unique(self._grams(*self._codes([text]))[0], return_counts=True)

    def score(self, texts: list[str]):
        """(language number or -1, confidence, letters) of each text. Confidence: cosine lead over the next language, 0..1."""
        import numpy as np

        n = len(texts)
        lang, conf, letters = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
        if not n or not len(self.owner):
            return lang, conf, letters
        code, seg = self._codes(texts)
        letters = np.bincount(seg[code != 32], minlength=n)
        gram, seg = self._grams(code, seg)
        if not len(gram):
            return lang, conf, letters
        pair, tf = np.unique(seg * BUCKETS + gram, return_counts=True)
        seg, gram = pair // BUCKETS, pair % BUCKETS
        norm = np.sqrt(np.bincount(seg, (tf * self.idf[gram]) ** 2, minlength=n))
        first = np.concatenate([[0], np.nonzero(np.diff(seg))[0] + 1])
        sims = np.zeros((n, len(self.owner)), np.float32)
        sims[seg[first]] = np.add.reduceat(self.weights[gram] * tf[:, None].astype(np.float32), first, axis=0)
        sims /= np.maximum(norm, 1e-9)[:, None]
        by = np.stack([sims[:, self.owner == i].max(1) for i in range(len(self.languages))], 1)
        best = by.argmax(1)
        top = by[np.arange(n), best]
        by[np.arange(n), best] = 0
        ok = (top >= self.reject) & (letters >= LEAST_LETTERS)
        lang[ok] = best[ok]
        conf[ok] = ((top - by.max(1)) / np.maximum(top, 1e-9))[ok]
        return lang, conf, letters


def fit(samples: DataFrame, rows: int = FIT_ROWS) -> Classifier:
    """From (lang, sample_text), at most `rows` of each language, by hash of sample_id; null or blank rows are left out.

    The languages told apart are a stated handful: a language's samples beyond `rows` never leave the executors.
    """
    some = samples.filter("lang is not null and trim(sample_text) <> ''").select("lang", "sample_text", "sample_id")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("sample_id"), "sample_id", "sample_text"))
    got = some.withColumn("n", place).filter(F.col("n") <= rows).orderBy("sample_id", "lang", "sample_text").collect()
    return Classifier([(r[0], r[1]) for r in got])


STRETCHES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("seg_from", T.IntegerType()), T.StructField("seg_to", T.IntegerType()),
    T.StructField("chars", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()),
])
LABELS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("langs", T.ArrayType(T.StringType())),
    T.StructField("main", T.StringType()), T.StructField("confidence", T.DoubleType()),
])
#: Texts are scored so many characters at a time.
CHUNK = 400_000


def _joined(model: Classifier, docs: list[list[tuple[int, int, str]]]) -> list[list[tuple]]:
    """Stretches (from, to, characters, language number, confidence) of each document, from its segments."""
    flat = [s for segs in docs for s in segs]
    lang, conf, letters = model.score([t for _, _, t in flat])
    out, i = [], 0
    for segs in docs:
        found: list[list] = []  # from, to, characters, language, letters, letters times confidence
        for s, e, _ in segs:
            x, c, n = int(lang[i]), float(conf[i]), int(letters[i])
            i += 1
            if x < 0:
                continue
            if not found or found[-1][3] != x:
                found.append([s, e, 0, x, 0, 0.0])
            f = found[-1]
            # what lies between two segments (tags, numbers, unrecognised bits) is no part of a stretch's characters
            f[1], f[2], f[4], f[5] = e, f[2] + e - s, f[4] + n, f[5] + c * n
        out.append([(a, z, size, x, sure / weight) for a, z, size, x, weight, sure in found])
    return out


def _scored(batches, model: Classifier):
    """(rows of a batch, their stretches) for rows with text, a bounded number of characters at a time. Column 1 is the text."""
    for b in batches:
        rows, n = [], 0
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[1] and not row[1].isspace():
                rows.append(row)
                n += len(row[1])
                if n >= CHUNK:
                    yield rows, _joined(model, [segments(r[1]) for r in rows])
                    rows, n = [], 0
        if rows:
            yield rows, _joined(model, [segments(r[1]) for r in rows])


def _batch(rows: list[tuple], schema: T.StructType):
    import pyarrow as pa

    kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.DoubleType: pa.float64(), T.ArrayType: pa.list_(pa.string())}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[type(f.dataType)]) for i, f in enumerate(schema)], names=schema.names)


def _stretches_with(model):
    def run(batches):
        m = model.value
        for rows, found in _scored(batches, m):
            yield _batch([(r[0], a, z, n, m.languages[x], c) for r, f in zip(rows, found) for a, z, n, x, c in f], STRETCHES)

    return run


def _label(model: Classifier, found: list[tuple], least: int) -> tuple:
    """(held languages, main language, its confidence) of a document's stretches."""
    size: dict[str, int] = {}
    longest: dict[str, int] = {}
    sure: dict[str, float] = {}
    for _, _, n, x, c in found:
        k = model.languages[x]
        size[k] = size.get(k, 0) + n
        longest[k], sure[k] = max(longest.get(k, 0), n), max(sure.get(k, 0.0), c)
    main = min(size, key=lambda k: (-size[k], k), default=None)
    return sorted(k for k in longest if longest[k] >= least), main, sure.get(main, 0.0)


def _labels_with(model, least: int):
    def run(batches):
        m = model.value
        for rows, found in _scored(batches, m):
            yield _batch([(r[0], r[2], *_label(m, f, least)) for r, f in zip(rows, found)], LABELS)

    return run


def _shared(documents: DataFrame, model: Classifier):
    return documents.sparkSession.sparkContext.broadcast(model)  # languages x clusters x BUCKETS floats, whatever the data


def stretches(documents: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, seg_from, seg_to, chars, lang, confidence: adjacent segments of one language as one row. documents: doc_id, text.

    chars: characters of the segments themselves, without tags and other bits between them. Null, blank and
    unrecognised texts give no row. No shuffle.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    return docs.mapInArrow(_stretches_with(_shared(documents, model)), STRETCHES)


def relabel(documents: DataFrame, model: Classifier, least: int = STRETCH) -> DataFrame:
    """doc_id, lang (stored), stored_code, langs (held, sorted), main, confidence of main, wrong. documents: doc_id, text, lang.

    wrong: the label is missing or names another language than the main one, or several languages are held. One row for
    each document with text; main (the language of most characters, ties to the first by name) and confidence come from
    all its stretches, langs from those of at least `least` characters, so that langs may be empty. Where nothing is
    recognised main is null, the confidence 0, and wrong says whether the label is missing. Null and blank texts give
    no row; a repeated document gives repeated rows. Each text is scored once, in one narrow pass.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter("text is not null")
    got = docs.mapInArrow(_labels_with(_shared(documents, model), least), LABELS).withColumn("stored_code", standard_language(F.col("lang")))
    wrong = F.col("stored_code").isNull() | F.coalesce(F.col("stored_code") != F.col("main"), F.lit(False)) | (F.size("langs") > 1)
    return got.select("doc_id", "lang", "stored_code", "langs", "main", "confidence", wrong.alias("wrong"))
