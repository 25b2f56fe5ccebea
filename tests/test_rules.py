"""Rules against slow, plain versions on random input; meters and boundary classes without a sample."""

import random

from pyspark.sql import functions as F

from chandas.functions import meter, syllables, text
from chandas.operators import align, search


def fits(words, pattern):
    """Whether words (syllables, may count one less) fill the padas exactly, by trying everything."""

    def go(i, pada, run):
        if pada == len(pattern):
            return i == len(words) and run == 0
        if i == len(words):
            return False
        n, less = words[i]
        for c in {n, n - 1} if less else {n}:
            if run + c == pattern[pada] and go(i + 1, pada + 1, 0):
                return True
            if run + c < pattern[pada] and go(i + 1, pada, run + c):
                return True
        return False

    return go(0, 0, 0)


def test_inference(spark):
    rnd, rows = random.Random(7), []
    for _ in range(150):
        n, words = rnd.choice([24, 25, 26, 32, 33, 36, 40, 44, 48]), []
        while n > 0:
            k = min(n, rnd.randint(1, 5))
            words.append("ki" * (k - 1) + rnd.choice(["ka", "ki", "kar"]))
            n -= k
        rows.append((" ".join(words),))
    got = {r.x: r.p for r in spark.createDataFrame(rows, "x string").select("x", meter.infer(text.words(F.col("x"))).alias("p")).collect()}
    found = 0
    for (line,) in rows:
        words = [(w.count("k"), w.endswith("a") and w.count("k") > 1) for w in line.split()]
        total, less = sum(n for n, _ in words), sum(r for _, r in words)
        want = next((p for p in meter.PATTERNS.values() if total - less <= sum(p) <= total and fits(words, p)), None)
        found += want is not None
        assert got[line] == want, line
    assert found > 10


def test_meter_names(spark):
    cases = {
        "Anustubh": [8] * 4, "Brhati": [8, 8, 8, 12], "Pankti": [8] * 5, "Jagati": [12] * 4, "Ushnih-like": [8, 8, 12, 8], "Nicrd Gayatri": [7, 8, 8], "Nicrd Anustubh": [8, 7, 8, 8],
        "Nicrd Tristubh": [10, 11, 11, 11], "Tristubh-Jagati Mixed": [11, 12, 12, 11], "No Meter Detected": [],
    }
    df = spark.createDataFrame(list(cases.items()), "n string, c array<int>")
    assert all(r.n == r.m for r in df.select("n", meter.detect(F.col("c")).alias("m")).collect())


def test_boundary_classes(spark):
    cases = [("naḥ", "ca", "external visarga"), ("ca", "āpa", "savarna dirgha"), ("dadhi", "atra", "external glide formation"), ("ca", "iha", "heterogeneous vowel contact"), ("tat", "ca", "external consonant contact"), ("tat", "iha", "boundary assimilation"), ("", "iha", "boundary assimilation"), ("ca’", "’āpa", "savarna dirgha")]
    df = spark.createDataFrame(cases, "a string, b string, want string")
    assert all(r.want == r.got for r in df.select("want", align.classify(F.col("a"), F.col("b"))["subtype"].alias("got")).collect())


def machine(word):
    """Weights by the letter rules, one letter at a time."""
    kind = lambda c: syllables._KINDS.get(c, "C")
    out, weight, has = [], None, False
    for i, c in enumerate(word):
        k, nxt = kind(c), kind(word[i + 1]) if i + 1 < len(word) else ""
        if k in "AB":
            if has:
                out.append(weight)
            has, weight = True, "heavy" if k == "B" else "light"
        elif k in "sS":
            has, weight = True, "heavy" if k == "S" else "light"
        elif k == "m" and has:
            weight = "heavy"
        elif k == "C" and not has:
            if nxt != "x":
                has, weight = True, "light"
        elif k == "C":
            weight = "heavy"
            if nxt not in ("x", "s", "S"):
                out.append(weight)
                has = False
    return out + [weight] if has else out


def test_syllable_rule(spark):
    rnd = random.Random(9)
    rows = [("".join(rnd.choice("अआइकतनरळऽािीुेोंः्््।A") for _ in range(rnd.randint(0, 14))),) for _ in range(1500)]
    df = spark.createDataFrame(rows, "w string").distinct()
    for r in df.select("w", syllables.dev_weights(F.col("w")).alias("got"), F.transform(syllables.dev_syllables(F.col("w")), lambda s: s["weight"]).alias("full")).collect():
        assert r.got == r.full == machine(r.w), r.w


def test_requests():
    p = search.parse
    assert p("find consonant clusters of length >= x") is None and p("find consonant clusters of length >= 0").number == 0
    assert search.clean_value('"abc".') == '"abc' and search.clean_value("śr[aā]ddh$") == "śr[aā]ddh" and search.clean_value("'particular x'") == "x"
    assert p("Words Beginning With 'pra'") == search.Request("prefix", "pra") and p("find all verses containing INDRA").kind == "verse"
    assert p("vowel span patterns a.i") == search.Request("regex", "a.i") and p("indra") == search.Request("word", "indra") and p("  ") is None
