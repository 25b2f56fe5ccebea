"""SQL for the operators that fold over words: transliteration, syllables, alignment, boundaries, meters, parsing.

Written apart from the operators: folds are recursive queries here, regular expressions do without looking ahead, and
all letters stand in the SQL itself (fixed values).
"""

from __future__ import annotations

# The current row of each verse.
V = """v AS (SELECT * FROM verses WHERE verse_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY verse_id ORDER BY loaded_at DESC NULLS LAST) = 1)"""
WORDS = r"list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '[ \t\n\x0B\f\r]+'), lambda w: regexp_replace(w, '[।॥|]+$', '')), lambda w: w <> '')"
MARKS = "॒̱॑̍"

# a: both word lists of a verse; d, i: their words one a row, from 1.
LISTS = f"""{V}, a AS (SELECT verse_id, hymn_index, verse_ord, verse_number, dev, iast, {WORDS.format(c='dev')} AS ds, {WORDS.format(c='iast')} AS ws FROM v),
d AS (SELECT verse_id, unnest(ds) AS word, unnest(range(1, len(ds) + 1)) AS k FROM a), i AS (SELECT verse_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM a)"""

# tw: each distinct Roman word in Devanagari. Units are vowels (V), ends (E) and all else (C).
TRANSLITERATED = """tu AS (SELECT DISTINCT word, list_filter(regexp_extract_all(word, '(?s)(kh|gh|ch|jh|th|dh|ph|bh|ai|au|.)'), lambda u: u NOT IN ('॒', '̱', '॑', '̍', '।', '॥', '|')) AS u FROM i),
tk AS (SELECT word, u, list_transform(u, lambda x: CASE WHEN x IN ('a', 'ā', 'i', 'ī', 'u', 'ū', 'ṛ', 'ṝ', 'ḷ', 'ḹ', 'e', 'ai', 'o', 'au') THEN 'V' WHEN x IN ('ṃ', 'ṁ', 'ḥ', '''', '’') THEN 'E' ELSE 'C' END) AS k,
  ['a', 'ā', 'i', 'ī', 'u', 'ū', 'ṛ', 'ṝ', 'ḷ', 'ḹ', 'e', 'ai', 'o', 'au'] AS v, ['अ', 'आ', 'इ', 'ई', 'उ', 'ऊ', 'ऋ', 'ॠ', 'ऌ', 'ॡ', 'ए', 'ऐ', 'ओ', 'औ'] AS alone,
  ['', 'ा', 'ि', 'ी', 'ु', 'ू', 'ृ', 'ॄ', 'ॢ', 'ॣ', 'े', 'ै', 'ो', 'ौ'] AS sign,
  ['k', 'kh', 'g', 'gh', 'ṅ', 'c', 'ch', 'j', 'jh', 'ñ', 'ṭ', 'ḍ', 'ṇ', 't', 'th', 'd', 'dh', 'n', 'p', 'ph', 'b', 'bh', 'm', 'y', 'r', 'l', 'v', 'ś', 'ṣ', 's', 'h', 'ṃ', 'ṁ', 'ḥ', '''', '’'] AS c,
  ['क', 'ख', 'ग', 'घ', 'ङ', 'च', 'छ', 'ज', 'झ', 'ञ', 'ट', 'ड', 'ण', 'त', 'थ', 'द', 'ध', 'न', 'प', 'फ', 'ब', 'भ', 'म', 'य', 'र', 'ल', 'व', 'श', 'ष', 'स', 'ह', 'ं', 'ं', 'ः', 'ऽ', 'ऽ'] AS t FROM tu),
tw AS (SELECT word, array_to_string(list_transform(range(1, len(u) + 1), lambda j: CASE
  WHEN k[j] = 'V' AND j > 1 AND k[j - 1] = 'C' THEN sign[list_position(v, u[j])] WHEN k[j] = 'V' THEN alone[list_position(v, u[j])]
  WHEN k[j] = 'C' AND j < len(u) AND k[j + 1] = 'C' THEN coalesce(t[list_position(c, u[j])], u[j]) || '्' ELSE coalesce(t[list_position(c, u[j])], u[j]) END), '') AS dev FROM tk)"""

# dc: each distinct Devanagari word with its bare letters, kinds, and syllables. A, B short and long vowels, s, S signs,
# m coda marks, x virama, b bars; consonants are D before a virama, E before a sign, else C.
SYLLABLES = """db AS (SELECT DISTINCT word, regexp_replace(word, '[॒̱॑̍]', '', 'g') AS bare FROM d),
dk AS (SELECT word, bare, translate(regexp_replace(bare, '[^अआइईउऊऋॠऌॡएऐओऔािीुूृॄॢॣेैोौंःँ्।॥|]', 'C', 'g'), 'अइउऋऌआईऊॠॡएऐओऔिुृॢाीूॄॣेैोौंःँ्।॥|', 'AAAAABBBBBBBBBssssSSSSSSSSSmmmxbbb') AS code FROM db),
dt AS (SELECT word, bare, regexp_extract_all(regexp_replace(regexp_replace(code, 'C(x)', 'D\\1', 'g'), 'C([sS])', 'E\\1', 'g'), '[Dxmb]*[CEABsS][sSmxbDE]*C?') AS tokens FROM dk)"""
WEIGHT = "CASE WHEN regexp_matches({t}, '^[Dxmb]*[CEABsS][xb]*$') THEN CASE WHEN right(regexp_replace({t}, '[xb]', '', 'g'), 1) IN ('B', 'S') THEN 'heavy' ELSE 'light' END WHEN right(regexp_replace({t}, '[xb]', '', 'g'), 1) = 's' THEN 'light' ELSE 'heavy' END"

VOWEL = "ai|au|[aāiīuūṛṝḷeo]"
# al: the run (s words before it, n words) of each Devanagari word w, by a walk over the words.
ALIGNED = f"""{LISTS}, {TRANSLITERATED}, {SYLLABLES},
ds AS (SELECT verse_id, list(regexp_replace(word, '[॒̱॑̍।॥|]', '', 'g') ORDER BY k) AS surface, list(len(tokens) ORDER BY k) AS need FROM d JOIN dt USING (word) GROUP BY 1),
iv AS (SELECT verse_id, k, i.word, tw.dev, len(regexp_extract_all(i.word, '{VOWEL}')) AS n, CASE WHEN k > 1 AND regexp_matches(i.word, '^[iu]') AND right(lag(i.word) OVER (PARTITION BY verse_id ORDER BY k), 1) = 'a' THEN 1 ELSE 0 END AS f FROM i JOIN tw ON tw.word = i.word),
ip AS (SELECT *, sum(n - f) OVER (PARTITION BY verse_id ORDER BY k) AS p FROM iv),
ii AS (SELECT verse_id, list(word ORDER BY k) AS words, list(dev ORDER BY k) AS devs, list(regexp_replace(dev, '[॒̱॑̍।॥|]', '', 'g') ORDER BY k) AS plain, list(f ORDER BY k) AS f, list_concat([0], list(p::INT ORDER BY k)) AS p FROM ip GROUP BY 1),
bo AS (SELECT ds.verse_id, surface, need, words, devs, plain, f, p FROM ds JOIN ii USING (verse_id)),
al AS (
  WITH RECURSIVE go AS (
    SELECT verse_id, 0 AS w, 0 AS s, 0 AS n FROM bo
    UNION ALL
    SELECT g.verse_id, g.w + 1, g.s + g.n, CASE WHEN surface[g.w + 1] <> '' AND surface[g.w + 1] = plain[g.s + g.n + 1] THEN 1 ELSE
      least(len(words) - g.s - g.n, greatest(1, len(words) - g.s - g.n - (len(need) - g.w - 1),
        coalesce(list_filter(range(1, len(words) - g.s - g.n + 1), lambda l: p[g.s + g.n + l + 1] - p[g.s + g.n + 1] + f[g.s + g.n + 1] >= need[g.w + 1])[1], len(words) - g.s - g.n))) END
    FROM go g JOIN bo USING (verse_id) WHERE g.w < len(need) AND g.s + g.n < len(words)
  ) SELECT verse_id, w, s, n::INT AS n FROM go WHERE w > 0),
aw AS (SELECT a.verse_id, hymn_index, verse_ord, verse_number, dev, iast, d.k::INT - 1 AS word_ord, d.word AS text, coalesce(array_to_string(words[s + 1:s + n], ''), '') AS aligned_iast,
  coalesce(array_to_string(words[s + 1:s + n], ' '), '') AS aligned_iast_underlying, coalesce(array_to_string(devs[s + 1:s + n], ' '), '') AS underlying_dev_text, ws[d.k] AS iast_word
  FROM d JOIN a USING (verse_id) LEFT JOIN al ON al.verse_id = d.verse_id AND al.w = d.k LEFT JOIN bo ON bo.verse_id = d.verse_id)"""

TRANSLITERATE = f"WITH {LISTS}, {TRANSLITERATED} SELECT word, dev FROM tw"
ALIGN_SPANS = f"WITH {ALIGNED} SELECT hymn_index, verse_ord, word_ord, text, aligned_iast, aligned_iast_underlying, underlying_dev_text, iast_word FROM aw"

_UNITS = "list_filter(regexp_extract_all({c}, '(?s)([kgcjtdpb]h|ai|au|.)'), lambda u: u NOT IN ('॒', '̱', '॑', '̍', '।', '॥', '|', '''', '’'))"
_VOWELS = "('a', 'ā', 'i', 'ī', 'u', 'ū', 'ṛ', 'ṝ', 'ḷ', 'ḹ', 'e', 'ai', 'o', 'au')"
_SAME = "((x IN ('a', 'ā') AND y IN ('a', 'ā')) OR (x IN ('i', 'ī') AND y IN ('i', 'ī')) OR (x IN ('u', 'ū') AND y IN ('u', 'ū')) OR (x IN ('ṛ', 'ṝ') AND y IN ('ṛ', 'ṝ')) OR (x = 'ḷ' AND y = 'ḷ'))"
KIND = (
    f"CASE WHEN x = 'ḥ' THEN 1 WHEN x IN {_VOWELS} AND y IN {_VOWELS} AND {_SAME} THEN 2 WHEN x IN ('i', 'ī', 'u', 'ū', 'ṛ', 'ṝ', 'ḷ') AND y IN {_VOWELS} THEN 3 WHEN x IN {_VOWELS} AND y IN {_VOWELS} THEN 4 "
    f"WHEN x <> '' AND y <> '' AND x NOT IN {_VOWELS} AND y NOT IN {_VOWELS} THEN 5 ELSE 6 END"
)
# The six classes of boundaries.
CLASSES = """(VALUES
(1, 'visarga sandhi', 'external visarga', 'high', 'Left underlying form ends in visarga before the next segment.'),
(2, 'vowel sandhi', 'savarna dirgha', 'high', 'Adjacent vowels are homorganic and may contract to a long vowel.'),
(3, 'semivowel sandhi', 'external glide formation', 'medium', 'A final high vowel before another vowel may surface as y, v, r, or l.'),
(4, 'vowel sandhi', 'heterogeneous vowel contact', 'medium', 'Adjacent vowels across the boundary suggest vowel sandhi.'),
(5, 'consonant sandhi', 'external consonant contact', 'medium', 'Both sides of the boundary are consonantal.'),
(6, 'sandhi candidate', 'boundary assimilation', 'medium', 'Surface token aligns with multiple underlying words.')) c(kind, category, subtype, confidence, notes)"""


def units(left: str, right: str, columns: str, source: str) -> str:
    return f"SELECT {columns}, coalesce({_UNITS.format(c=left)}[-1], '') AS x, coalesce({_UNITS.format(c=right)}[1], '') AS y FROM {source}"


BOUNDARY_CLASS = (
    f"WITH p AS ({units('left_underlying_iast', 'right_underlying_iast', 'boundary_id', 'sandhi WHERE boundary_id IS NOT NULL AND left_underlying_iast IS NOT NULL AND right_underlying_iast IS NOT NULL')}), "
    f"k AS (SELECT boundary_id, {KIND} AS kind FROM p) SELECT DISTINCT boundary_id, subtype FROM k JOIN {CLASSES} USING (kind)"
)
SANDHI_BOUNDARIES = (
    f"WITH {ALIGNED}, e AS (SELECT verse_id, w, s, n, unnest(range(s + 1, s + n)) AS l FROM al WHERE n > 1), "
    f"p AS ({units('words[l]', 'words[l + 1]', '*', 'e JOIN bo USING (verse_id) JOIN a USING (verse_id)')}), k AS (SELECT *, {KIND} AS kind FROM p) "
    "SELECT hymn_index, verse_ord, w::INT - 1 AS surface_word_index, ds[w] AS surface_dev, array_to_string(words[s + 1:s + n], '') AS surface_iast, array_to_string(devs[s + 1:s + n], ' ') AS segmented_dev, "
    "array_to_string(words[s + 1:s + n], ' ') AS segmented_iast, l::INT - 1 AS left_underlying_word_index, devs[l] AS left_underlying_dev, words[l] AS left_underlying_iast, l::INT AS right_underlying_word_index, "
    f"devs[l + 1] AS right_underlying_dev, words[l + 1] AS right_underlying_iast, category, subtype, confidence, 'generated' AS normalization_status, true AS detected, notes FROM k JOIN {CLASSES} USING (kind)"
)

DEV_SYLLABLE_WEIGHTS = (
    f"WITH {LISTS}, {SYLLABLES}, t AS (SELECT verse_id, k, unnest(tokens) AS t, unnest(range(len(tokens))) AS j FROM d JOIN dt USING (word)), g AS (SELECT verse_id, string_agg({WEIGHT.format(t='t')}, ' ' ORDER BY k, j) AS weights FROM t GROUP BY 1) "
    "SELECT hymn_index, verse_ord, CASE WHEN dev IS NOT NULL THEN coalesce(weights, '') END AS weights FROM a LEFT JOIN g USING (verse_id)"
)
# st: syllables of each distinct Devanagari word: place, letters before it, letters before its nucleus.
PARTS = f"""st AS (SELECT word, string_split(bare, '') AS letters, unnest(tokens) AS t, unnest(range(1, len(tokens) + 1)) AS j, tokens FROM dt),
sy AS (SELECT word, j, t, letters, coalesce(list_sum(list_transform(tokens[1:j - 1], lambda x: length(x))), 0)::INT AS o, length(regexp_extract(t, '^[Dxmb]*')) AS b FROM st),
sp AS (SELECT word, j, {WEIGHT.format(t='t')} AS weight, letters[o + b + 1] AS nucleus,
  array_to_string(list_transform(list_filter(range(1, b + 1), lambda q: t[q] = 'D'), lambda q: letters[o + q]), '') || CASE WHEN t[b + 1] IN ('C', 'E') THEN letters[o + b + 1] ELSE '' END AS onset,
  array_to_string(list_transform(list_filter(range(b + 2, length(t) + 1), lambda q: t[q] IN ('C', 'D', 'E', 'm')), lambda q: letters[o + q]), '') AS coda FROM sy)"""
DEV_SYLLABLES = f"WITH {LISTS}, {SYLLABLES}, {PARTS} SELECT hymn_index, verse_ord, (k - 1)::INT AS word_ord, (j - 1)::INT AS syllable_ord, onset, nucleus, coda, weight FROM d JOIN sp USING (word) JOIN a USING (verse_id)"

# Meters: explicit counts, else the first pattern that the words fill exactly, else counts of the Devanagari line.
_SEGMENTS = "list_filter(regexp_split_to_array({c}, '[।॥|]'), lambda x: x <> '')"
_IAST_COUNTS = f"coalesce(list_transform({_SEGMENTS.format(c='iast')}, lambda z: coalesce(list_sum(list_transform({WORDS.format(c='z')}, lambda y: len(regexp_extract_all(y, '{VOWEL}')))), 0)::INT), [])"
_DEV_COUNTS = (
    f"coalesce(list_transform({_SEGMENTS.format(c='dev')}, lambda z: coalesce(list_sum(list_transform({WORDS.format(c='z')}, lambda y: len(regexp_extract_all(regexp_replace(y, '([^अआइईउऊऋॠऌॡएऐओऔािीुूृॄॢॣेैोौंःँ्ऽ।॥|])्', '|्', 'g'), "
    "'[अआइईउऊऋॠऌॡएऐओऔ]|[^ािीुूृॄॢॣेैोौंःँ्ऽ।॥|]')))), 0)::INT), [])"
)
METERS = f"""{LISTS}, pt AS (SELECT * FROM (VALUES (1, 'Gayatri', [8, 8, 8]), (2, 'Anustubh', [8, 8, 8, 8]), (3, 'Brhati', [8, 8, 8, 12]), (4, 'Pankti', [8, 8, 8, 8, 8]), (5, 'Tristubh', [11, 11, 11, 11]), (6, 'Jagati', [12, 12, 12, 12]), (7, 'Ushnih-like', [8, 8, 12, 8])) t(pid, name, want)),
wn AS (SELECT verse_id, k, len(regexp_extract_all(word, '{VOWEL}')) AS n, right(word, 1) = 'a' AS r FROM i),
wr AS (SELECT verse_id, list(n ORDER BY k) AS ns, list(r AND n > 1 ORDER BY k) AS rs, sum(n) AS total, count(*) FILTER (r AND n > 1) AS less FROM wn WHERE n > 0 GROUP BY 1),
fit AS (
  WITH RECURSIVE go AS (
    SELECT verse_id, pid, 0 AS k, 0 AS pada, 0 AS run FROM wr JOIN pt ON list_sum(want) BETWEEN total - less AND total
    UNION
    SELECT verse_id, pid, k + 1, CASE WHEN run + c = want[pada + 1] THEN pada + 1 ELSE pada END, CASE WHEN run + c = want[pada + 1] THEN 0 ELSE run + c END
    FROM (SELECT g.*, want, unnest(CASE WHEN rs[k + 1] THEN [ns[k + 1], ns[k + 1] - 1] ELSE [ns[k + 1]] END) AS c FROM go g JOIN wr USING (verse_id) JOIN pt USING (pid) WHERE k < len(ns) AND pada < len(want)) WHERE run + c <= want[pada + 1]
  ) SELECT go.verse_id, min(pid) AS pid FROM go JOIN wr USING (verse_id) JOIN pt USING (pid) WHERE k = len(ns) AND pada = len(want) AND run = 0 GROUP BY 1),
mc AS (SELECT a.*, {_IAST_COUNTS} AS e, {_DEV_COUNTS} AS z, want FROM a LEFT JOIN fit USING (verse_id) LEFT JOIN pt USING (pid)),
mx AS (SELECT *, CASE WHEN len(e) >= 3 THEN e WHEN want IS NOT NULL THEN want WHEN len(e) > 0 THEN e ELSE z END AS counts FROM mc)"""
_ALL = "len(list_filter({c}, lambda x: x IN ({n}))) = len({c})"
METER_OF = (
    "CASE WHEN {c} = [8, 8, 8] THEN 'Gayatri' WHEN {c} = [8, 8, 8, 8] THEN 'Anustubh' WHEN {c} = [8, 8, 8, 12] THEN 'Brhati' WHEN {c} = [8, 8, 8, 8, 8] THEN 'Pankti' WHEN {c} = [11, 11, 11, 11] THEN 'Tristubh' WHEN {c} = [12, 12, 12, 12] THEN 'Jagati' "
    f"WHEN {{c}} = [8, 8, 12, 8] THEN 'Ushnih-like' WHEN len({{c}}) = 4 AND {_ALL.format(c='{c}', n='10, 11')} AND list_contains({{c}}, 10) THEN 'Nicrd Tristubh' WHEN len({{c}}) = 4 AND {_ALL.format(c='{c}', n='11, 12')} AND list_contains({{c}}, 11) AND list_contains({{c}}, 12) THEN 'Tristubh-Jagati Mixed' "
    f"WHEN len({{c}}) = 3 AND {_ALL.format(c='{c}', n='7, 8')} AND list_contains({{c}}, 7) THEN 'Nicrd Gayatri' WHEN len({{c}}) = 4 AND {_ALL.format(c='{c}', n='7, 8')} AND list_contains({{c}}, 7) THEN 'Nicrd Anustubh' ELSE 'No Meter Detected' END"
)
VERSE_METERS = f"WITH {METERS} SELECT hymn_index, verse_ord, array_to_string(counts, '-') AS counts, {METER_OF.format(c='counts')} AS meter FROM mx"
METER_OF_COUNTS = f"WITH {V} SELECT hymn_index, verse_ord, {METER_OF.format(c='pada_counts')} AS meter FROM v WHERE pada_counts IS NOT NULL"

# Tagged text: lines with the first recogniser that fits.
_LINES = r"""f AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM f),
k AS (SELECT *, CASE WHEN regexp_matches(line, 'Mandala:\s*\d+') THEN 'mandala' WHEN regexp_matches(line, 'Sukta:\s*\d+') THEN 'sukta' WHEN contains(line, 'Rishis:') THEN 'rishis' WHEN contains(line, 'Devatas:') THEN 'devatas' WHEN contains(line, 'Categories:') THEN 'categories'
  WHEN regexp_matches(line, '\[Verse\s*\d+\]') THEN 'verse' WHEN starts_with(line, 'DEV:') THEN 'dev' WHEN starts_with(line, 'IAST:') THEN 'iast' WHEN starts_with(line, 'ENG:') THEN 'eng' END AS kind FROM l),
t AS (SELECT doc_id, n, kind, CASE kind WHEN 'mandala' THEN regexp_extract(line, 'Mandala:\s*(\d+)', 1) WHEN 'sukta' THEN regexp_extract(line, 'Sukta:\s*(\d+)', 1) WHEN 'rishis' THEN regexp_extract(line, 'Rishis:\s*(.*)', 1)
  WHEN 'devatas' THEN regexp_extract(line, 'Devatas:\s*(.*)', 1) WHEN 'categories' THEN regexp_extract(line, 'Categories:\s*(.*)', 1) WHEN 'verse' THEN regexp_extract(line, '\[Verse\s*(\d+)\]', 1) WHEN 'iast' THEN substring(line, 6) ELSE substring(line, 5) END AS value FROM k WHERE kind IS NOT NULL)"""
PARSED_VERSES = f"""WITH {_LINES}, b AS (SELECT *, CASE WHEN kind = 'verse' THEN coalesce(try_cast(value AS INT), 0) END AS number FROM t WHERE kind IN ('verse', 'dev', 'iast', 'eng')),
c AS (SELECT *, coalesce(last_value(number IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
o AS (SELECT *, sum(CASE WHEN kind = 'verse' AND before <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS o FROM c),
g AS (SELECT doc_id, o, arg_max(number, n) FILTER (kind = 'verse') AS verse_number, coalesce(arg_max(value, n) FILTER (kind = 'dev'), '') AS dev, coalesce(arg_max(value, n) FILTER (kind = 'iast'), '') AS iast, coalesce(arg_max(value, n) FILTER (kind = 'eng'), '') AS eng,
  coalesce(string_agg(value, ' ' ORDER BY n) FILTER (kind = 'dev'), '') AS dev_all, coalesce(string_agg(value, ' ' ORDER BY n) FILTER (kind = 'iast'), '') AS iast_all FROM o GROUP BY 1, 2)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INT AS verse_ord, verse_number, dev, iast, eng, dev_all, iast_all FROM g WHERE verse_number <> 0"""
PARSED_HYMNS = f"""WITH {_LINES} SELECT doc_id, coalesce(try_cast(arg_max(value, n) FILTER (kind = 'mandala') AS INT), 0) AS mandala, coalesce(try_cast(arg_max(value, n) FILTER (kind = 'sukta') AS INT), 0) AS sukta,
coalesce(string_agg(value, '|' ORDER BY n) FILTER (kind = 'rishis'), '') AS rishis, coalesce(string_agg(value, '|' ORDER BY n) FILTER (kind = 'devatas'), '') AS devatas, coalesce(string_agg(value, '|' ORDER BY n) FILTER (kind = 'categories'), '') AS categories FROM t GROUP BY 1"""


def search(where: str, detail: str) -> str:
    """Matches among words: text, surface (the aligned Roman words in Devanagari, or the text), roman (the aligned words)."""
    return (
        f"WITH {ALIGNED}, h AS (SELECT hymn_index, arg_max(export_base, loaded_at) AS export_base FROM hymns WHERE hymn_index IS NOT NULL GROUP BY 1), m AS (SELECT *, coalesce(nullif(underlying_dev_text, ''), text) AS surface, aligned_iast_underlying AS roman FROM aw) "
        f"SELECT hymn_index, export_base, verse_ord, verse_number, word_ord, surface AS dev_word, coalesce(iast_word, text) AS iast_word, dev AS verse_dev, iast AS verse_iast, {detail} AS detail FROM m LEFT JOIN h USING (hymn_index) WHERE {where}"
    )


# The 31 columns' classes of single letters (fixed values).
CLASS = (
    "CASE WHEN {c} IN ('अ', 'इ', 'ि', 'उ', 'ु', 'ऋ', 'ृ', 'ऌ', 'ॢ', 'आ', 'ा', 'ई', 'ी', 'ऊ', 'ू', 'ॠ', 'ॄ', 'ॡ', 'ॣ', 'ए', 'े', 'ओ', 'ो', 'ऐ', 'ै', 'औ', 'ौ', 'a', 'ā', 'i', 'ī', 'u', 'ū', 'ṛ', 'ṝ', 'ḷ', 'ḹ', 'e', 'o', 'ai', 'au') THEN 'Vowel' "
    "WHEN {c} IN ('क', 'ख', 'ग', 'घ', 'k', 'g') THEN 'Velar' WHEN {c} IN ('च', 'छ', 'ज', 'झ', 'c', 'j') THEN 'Palatal' WHEN {c} IN ('ट', 'ठ', 'ड', 'ढ', 'ṭ', 'ḍ') THEN 'Retroflex' WHEN {c} IN ('त', 'थ', 'द', 'ध', 't', 'd') THEN 'Dental' "
    "WHEN {c} IN ('प', 'फ', 'ब', 'भ', 'p', 'b') THEN 'Labial' WHEN {c} IN ('ङ', 'ञ', 'ण', 'न', 'म', 'ं', 'ँ', 'ṅ', 'ñ', 'ṇ', 'n', 'm', 'ṃ', 'ṁ') THEN 'Nasal' WHEN {c} IN ('य', 'व', 'y', 'v') THEN 'Semivowel' WHEN {c} IN ('र', 'ल', 'r', 'l') THEN 'Liquid' "
    "WHEN {c} IN ('श', 'ष', 'स', 'ś', 'ṣ', 's') THEN 'Sibilant' WHEN {c} IN ('ह', 'ः', 'h', 'ḥ') THEN 'Aspirate' ELSE 'Other' END"
)
LENGTH = (
    "CASE WHEN {c} IN ('अ', 'इ', 'ि', 'उ', 'ु', 'ऋ', 'ृ', 'ऌ', 'ॢ', 'a', 'i', 'u', 'ṛ', 'ḷ') THEN 'Short' WHEN {c} IN ('ऐ', 'ै', 'औ', 'ौ', 'ai', 'au') THEN 'Diphthong' "
    "WHEN {c} IN ('आ', 'ा', 'ई', 'ी', 'ऊ', 'ू', 'ॠ', 'ॄ', 'ॡ', 'ॣ', 'ए', 'े', 'ओ', 'ो', 'ā', 'ī', 'ū', 'ṝ', 'ḹ', 'e', 'o') THEN 'Long' ELSE 'None' END"
)

# ri: syllables of each distinct Roman text: v, w short and long vowels, m coda marks, b bars, C all else.
ROMAN_SYLLABLES = """ru AS (SELECT word, list_filter(regexp_extract_all(word, '(?s)(ai|au|.)'), lambda u: u NOT IN ('̍', '̱')) AS units FROM rw),
rc AS (SELECT word, units, array_to_string(list_transform(units, lambda u: CASE WHEN u IN ('ā', 'ī', 'ū', 'e', 'o', 'ai', 'au') THEN 'w' WHEN u IN ('a', 'i', 'u', 'ṛ', 'ṝ', 'ḷ') THEN 'v' WHEN u IN ('ṃ', 'ṁ', 'ḥ') THEN 'm' WHEN u IN ('।', '॥', '|') THEN 'b' ELSE 'C' END), '') AS code FROM ru),
rt AS (SELECT word, units, regexp_extract_all(code, '[Cbm]*[vw]m*(?:[Cbm]*$)?') AS ts FROM rc),
rs AS (SELECT word, units, ts, unnest(range(1, len(ts) + 1)) AS j FROM rt),
ro AS (SELECT word, units, j, ts[j] AS t, coalesce(list_sum(list_transform(ts[1:j - 1], lambda x: length(x))), 0)::INT AS o, length(regexp_extract(ts[j], '^[Cbm]*')) AS b, regexp_extract(coalesce(ts[j + 1], ''), '^[Cbm]*') AS nx FROM rs),
rp AS (SELECT word, j, list_transform(list_filter(range(1, b + 1), lambda q: t[q] = 'C'), lambda q: units[o + q]) AS onset, units[o + b + 1] AS nucleus, t[b + 1] = 'w' AS long,
  list_concat(list_concat(list_transform(list_filter(range(b + 2, length(t) + 1), lambda q: t[q] = 'm'), lambda q: units[o + q]), list_transform(list_filter(range(1, length(nx) + 1), lambda q: nx[q] = 'm'), lambda q: units[o + length(t) + q])),
    list_transform(list_filter(range(b + 2, length(t) + 1), lambda q: t[q] = 'C'), lambda q: units[o + q])) AS coda FROM ro),
ri AS (SELECT word, j, onset, nucleus, coda, CASE WHEN len(coda) > 0 OR long THEN 'heavy' ELSE 'light' END AS weight FROM rp)"""
IAST_SYLLABLES = (
    f"WITH {LISTS}, rw AS (SELECT DISTINCT word FROM i), {ROMAN_SYLLABLES} SELECT hymn_index, verse_ord, (k - 1)::INT AS word_ord, (j - 1)::INT AS syllable_ord, array_to_string(onset, '') AS onset, nucleus, array_to_string(coda, '') AS coda, weight "
    "FROM i JOIN ri ON ri.word = i.word JOIN a USING (verse_id)"
)
_SWARA = "CASE WHEN right({u}, 1) IN ('॑', '̍') THEN 'svarita' WHEN right({u}, 1) IN ('॒', '̱') THEN 'anudatta' ELSE 'udatta' END"
# dl: syllables of each distinct Devanagari word with the places of onset, nucleus and coda letters among its units.
DEV_LETTERS = f"""wu AS (SELECT word, regexp_extract_all(word, '(?s)[^॒̱॑̍][॒̱॑̍]*') AS us FROM db),
dl AS (SELECT sy.word, j, t, us, us[o + b + 1] AS nu, t[b + 1] AS nk, list_transform(list_filter(range(1, b + 1), lambda q: t[q] = 'D'), lambda q: us[o + q]) AS front,
  list_transform(list_filter(range(b + 2, length(t) + 1), lambda q: t[q] IN ('C', 'D', 'E', 'm')), lambda q: us[o + q]) AS coda FROM sy JOIN wu USING (word)),
dm AS (SELECT *, CASE WHEN nk IN ('C', 'E') THEN list_append(front, nu) ELSE front END AS onset FROM dl),
dn AS (SELECT word, j, {WEIGHT.format(t='t')} AS weight, onset, nu, coda, list_concat(list_append(onset, nu), coda) AS us, CASE WHEN nk IN ('s', 'S') THEN '' ELSE {_SWARA.format(u='nu')} END AS swaras FROM dm)"""
_TEXT = "array_to_string(list_transform({c}, lambda u: u[1]), '')"
LETTER_TABLE = f"""WITH {ALIGNED}, {PARTS}, rw AS (SELECT DISTINCT aligned_iast AS word FROM aw), {ROMAN_SYLLABLES}, {DEV_LETTERS},
h AS (SELECT * FROM hymns WHERE hymn_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hymn_index ORDER BY loaded_at DESC NULLS LAST) = 1),
x AS (SELECT aw.*, dn.j, dn.weight AS w, dn.onset, nu, dn.coda, us, swaras, list_concat(list_append(ri.onset, ri.nucleus), ri.coda) AS rl FROM aw JOIN dn ON dn.word = aw.text LEFT JOIN ri ON ri.word = aw.aligned_iast AND ri.j = dn.j),
y AS (SELECT *, unnest(range(1, greatest(len(us), coalesce(len(rl), 0)) + 1)) AS q FROM x), z AS (SELECT *, us[q] AS u, rl[q] AS r FROM y)
SELECT z.hymn_index, z.verse_ord, mandala AS "Mandala", sukta AS "Sukta", coalesce(array_to_string(rishis, '|'), '') AS "Rishis", coalesce(array_to_string(devatas, '|'), '') AS "Devatas", coalesce(array_to_string(categories, '|'), '') AS "Categories",
  z.verse_number AS "Verse", v.meter AS "Meter", z.dev AS "Verse_DEV", z.iast AS "Verse_IAST", word_ord AS "Word_Index", text AS "Word_DEV", coalesce(nullif(aligned_iast, ''), iast_word, '') AS "Word_IAST", (j - 1)::INT AS "Syllable_Index",
  {_TEXT.format(c='onset')} || nu[1] || {_TEXT.format(c='coda')} AS "Syllable_DEV", coalesce(array_to_string(rl, ''), '') AS "Syllable_IAST", {_TEXT.format(c='onset')} AS "Syllable_Onset", nu[1] AS "Syllable_Nucleus", {_TEXT.format(c='coda')} AS "Syllable_Coda",
  w AS "Syllable_Weight", swaras AS "Syllable_Swaras", coalesce(array_to_string(rl, ''), '') AS "Syllable_IAST_Letters", CASE WHEN u IS NOT NULL THEN (q - 1)::INT END AS "Letter_Index", u[1] AS "Letter_Value", length(u) > 1 AS "Letter_HasSwara",
  CASE WHEN u IS NOT NULL THEN {_SWARA.format(u='u')} END AS "Letter_SwaraType", CASE WHEN u IS NOT NULL THEN {CLASS.format(c='u[1]')} END AS "Letter_PhonemeClass", CASE WHEN u IS NOT NULL THEN {LENGTH.format(c='u[1]')} END AS "Letter_VowelLength",
  CASE WHEN r IS NOT NULL THEN (q - 1)::INT END AS "Letter_IAST_Index", r AS "Letter_IAST_Value", CASE WHEN r IS NOT NULL THEN {CLASS.format(c='r')} END AS "Letter_IAST_PhonemeClass", CASE WHEN r IS NOT NULL THEN {LENGTH.format(c='r')} END AS "Letter_IAST_VowelLength"
FROM z JOIN v USING (verse_id) LEFT JOIN h ON h.hymn_index = z.hymn_index"""
SYLLABLE_PAIRS = f"""WITH {ALIGNED}, {PARTS}, rw AS (SELECT DISTINCT aligned_iast AS word FROM aw), {ROMAN_SYLLABLES}
SELECT hymn_index, verse_ord, word_ord, (sp.j - 1)::INT AS syllable_ord, sp.onset || CASE WHEN right(sp.onset, 1) = sp.nucleus THEN '' ELSE sp.nucleus END || sp.coda AS dev, array_to_string(ri.onset, '') || ri.nucleus || array_to_string(ri.coda, '') AS iast
FROM aw JOIN sp ON sp.word = aw.text JOIN ri ON ri.word = aw.aligned_iast AND ri.j = sp.j"""
VERSE_REPORT = f"""WITH {METERS}, {SYLLABLES}, n AS (SELECT verse_id, sum(len(tokens))::BIGINT AS dev_syllables FROM d JOIN dt USING (word) GROUP BY 1), m AS (SELECT verse_id, sum(len(regexp_extract_all(word, '{VOWEL}')))::BIGINT AS iast_syllables FROM i GROUP BY 1)
SELECT hymn_index, verse_ord, verse_number, array_to_string(counts, '-') AS pada_counts, {METER_OF.format(c='counts')} AS meter, coalesce(dev_syllables, 0) AS dev_syllables, coalesce(iast_syllables, 0) AS iast_syllables FROM mx LEFT JOIN n USING (verse_id) LEFT JOIN m USING (verse_id)"""


def similarity(features: str, owners: str, keys: str, shown: str, decimals: int = 6) -> str:
    """All scores of pairs x.o < y.o within g, from CTEs f(g, o, kind, key, value) and owners w(g, o, ...)."""
    scores = []
    for k in ("phoneme", "swara", "meter"):
        conf = f"CASE WHEN {k}.active > 0 AND {k}.ta <> 0 AND {k}.tb <> 0 THEN ({k}.shared / {k}.active + least({k}.ta, {k}.tb) / greatest({k}.ta, {k}.tb) + least(1.0, {k}.active / 8.0)) / 3 ELSE 0.0 END"
        cosine = f"CASE WHEN {k}.qa = 0 OR {k}.qb = 0 THEN 0.0 ELSE {k}.dot / (sqrt({k}.qa) * sqrt({k}.qb)) END"
        for name, x in (("dot_product", f"{k}.dot"), ("magnitude_a", f"sqrt({k}.qa)"), ("magnitude_b", f"sqrt({k}.qb)"), ("cosine_similarity", cosine), ("confidence", conf)):
            scores.append(f"round({x}, {decimals}) AS {k}_{name}")
    s = "s AS (SELECT g, o, kind, sum(value)::DOUBLE AS t, sum(value * value)::DOUBLE AS q, count(*) AS n FROM f GROUP BY 1, 2, 3), dp AS (SELECT a.g, a.o AS a, b.o AS b, kind, sum(a.value * b.value)::DOUBLE AS dot, count(*) AS shared FROM f a JOIN f b USING (g, kind, key) WHERE a.o < b.o GROUP BY 1, 2, 3, 4), "
    s += "p AS (SELECT x.g, x.o AS a, y.o AS b FROM w x JOIN w y ON x.g = y.g AND x.o < y.o), kinds AS (SELECT unnest(['phoneme', 'swara', 'meter']) AS kind), "
    s += "j AS (SELECT p.g, p.a, p.b, kinds.kind, coalesce(dot, 0.0) AS dot, coalesce(shared, 0) AS shared, coalesce(u.t, 0.0) AS ta, coalesce(v2.t, 0.0) AS tb, coalesce(u.q, 0.0) AS qa, coalesce(v2.q, 0.0) AS qb, coalesce(u.n, 0) + coalesce(v2.n, 0) - coalesce(shared, 0) AS active "
    s += "FROM p JOIN kinds ON true LEFT JOIN s u ON u.g = p.g AND u.o = p.a AND u.kind = kinds.kind LEFT JOIN s v2 ON v2.g = p.g AND v2.o = p.b AND v2.kind = kinds.kind LEFT JOIN dp ON dp.g = p.g AND dp.a = p.a AND dp.b = p.b AND dp.kind = kinds.kind)"
    joins = " ".join(f"JOIN j {k} ON {k}.g = p.g AND {k}.a = p.a AND {k}.b = p.b AND {k}.kind = '{k}'" for k in ("phoneme", "swara", "meter"))
    return f"WITH {features}, w AS ({owners}), {s} SELECT {keys}, {', '.join(scores)} FROM p {joins} JOIN w x ON x.g = p.g AND x.o = p.a JOIN w y ON y.g = p.g AND y.o = p.b {shown}"


def features(owner: str, source: str = "a", group: str = "g, o") -> str:
    """CTE f of the counted classes, accents and weights of verses; owner gives g and o from the verse's columns."""
    return (
        f"{LISTS}, {SYLLABLES}, own AS (SELECT verse_id, {owner} FROM {source}), uu AS (SELECT g, o, unnest(regexp_extract_all(word, '(?s)[^॒̱॑̍][॒̱॑̍]*')) AS u FROM d JOIN own USING (verse_id)), "
        f"uc AS (SELECT g, o, {CLASS.format(c='u[1]')} AS c, {_SWARA.format(u='u')} AS w FROM uu), tk AS (SELECT own.verse_id, g, o, k, unnest(tokens) AS t, unnest(range(len(tokens))) AS j FROM d JOIN own USING (verse_id) JOIN dt USING (word)), "
        f"tn AS (SELECT g, o, {WEIGHT.format(t='t')} AS w, row_number() OVER (PARTITION BY verse_id, g, o ORDER BY k, j) AS n FROM tk), "
        "f AS (SELECT g, o, 'phoneme' AS kind, c AS key, count(*) AS value FROM uc WHERE c <> 'Other' GROUP BY ALL UNION ALL SELECT g, o, 'swara', w, count(*) FROM uc GROUP BY ALL UNION ALL SELECT g, o, 'meter', n || ':' || w, count(*) FROM tn GROUP BY ALL)"
    )


VERSE_SIMILARITY = similarity(
    features("hymn_index AS g, verse_ord AS o"), "SELECT hymn_index AS g, verse_ord AS o, verse_number FROM a", "p.g AS hymn_index, p.a AS verse_ord_a, p.b AS verse_ord_b, x.verse_number AS verse_number_a, y.verse_number AS verse_number_b", "",
)
COMPARE_HYMNS = similarity(
    features("0 AS g, hymn_index AS o", "(SELECT * FROM a WHERE hymn_index IN (SELECT verse_id // 1000 FROM knn_probes))"), "SELECT 0 AS g, hymn_index AS o, count(*) AS verses FROM a WHERE hymn_index IN (SELECT verse_id // 1000 FROM knn_probes) GROUP BY ALL",
    "p.a AS hymn_index_a, p.b AS hymn_index_b, x.verses AS verses_a, y.verses AS verses_b", "",
)


def compare_verses(references: list[tuple[int, int]]) -> str:
    """Selected (hymn, verse number) references, by their place; the first verse of a number counts."""
    sel = ", ".join(f"({i}, {h}, {v})" for i, (h, v) in enumerate(references))
    pick = f"(SELECT verse_id, sel AS o FROM a JOIN (VALUES {sel}) q(sel, h, n) ON h = hymn_index AND n = verse_number QUALIFY row_number() OVER (PARTITION BY sel ORDER BY verse_ord) = 1)"
    return similarity(features("0 AS g, o", pick), f"SELECT 0 AS g, o FROM {pick}", "p.a AS sel_ord_a, p.b AS sel_ord_b", "")


STRING_FUNCTIONS = f"""WITH {V} SELECT hymn_index, verse_ord, regexp_replace(eng, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS trimmed, translate(eng, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded,
regexp_replace(dev, '[॒̱॑̍।॥|]', '', 'g') AS surface, regexp_replace(iast, '[।॥|]+$', '') AS cleaned, len({WORDS.format(c='iast')})::INT AS words FROM v WHERE eng IS NOT NULL AND dev IS NOT NULL AND iast IS NOT NULL"""
LETTER_PARTS = f"""WITH {LISTS}, x AS (SELECT DISTINCT 'dev' AS script, unnest(string_split(regexp_replace(word, '[॒̱॑̍]', '', 'g'), '')) AS letter FROM d), y AS (SELECT DISTINCT 'iast' AS script, unnest(list_filter(regexp_extract_all(word, '(?s)(ai|au|.)'), lambda u: u NOT IN ('̍', '̱'))) AS letter FROM i)
SELECT script, letter, CASE WHEN letter IN ('आ', 'ई', 'ऊ', 'ॠ', 'ॡ', 'ए', 'ऐ', 'ओ', 'औ') THEN 'long vowel' WHEN letter IN ('अ', 'इ', 'उ', 'ऋ', 'ऌ') THEN 'vowel' WHEN letter IN ('ा', 'ी', 'ू', 'ॄ', 'ॣ', 'े', 'ै', 'ो', 'ौ') THEN 'long sign' WHEN letter IN ('ि', 'ु', 'ृ', 'ॢ') THEN 'sign'
  WHEN letter IN ('ं', 'ः', 'ँ') THEN 'coda mark' WHEN letter = '्' THEN 'virama' WHEN letter IN ('।', '॥', '|') THEN 'bar' ELSE 'consonant' END AS part FROM x
UNION ALL SELECT script, letter, CASE WHEN letter IN ('ā', 'ī', 'ū', 'e', 'o', 'ai', 'au') THEN 'long vowel' WHEN letter IN ('a', 'i', 'u', 'ṛ', 'ṝ', 'ḷ') THEN 'vowel' WHEN letter IN ('ṃ', 'ṁ', 'ḥ') THEN 'coda mark' WHEN letter IN ('।', '॥', '|') THEN 'bar' ELSE 'consonant' END FROM y"""
WORD_LETTERS = f"""WITH {LISTS}, u AS (SELECT verse_id, k, unnest(us) AS u, unnest(range(len(us))) AS j FROM (SELECT verse_id, k, regexp_extract_all(word, '(?s)[^॒̱॑̍][॒̱॑̍]*') AS us FROM d))
SELECT hymn_index, verse_ord, (k - 1)::INT AS word_ord, j::INT AS letter_ord, u[1] AS value, length(u) > 1 AS has_swara, {_SWARA.format(u='u')} AS swara_type, {CLASS.format(c='u[1]')} AS phoneme_class, {LENGTH.format(c='u[1]')} AS vowel_length FROM u JOIN a USING (verse_id)"""
IAST_LETTERS = f"""WITH {LISTS}, u AS (SELECT verse_id, k, unnest(us) AS u, unnest(range(len(us))) AS j FROM (SELECT verse_id, k, list_filter(regexp_extract_all(word, '(?s)(ai|au|.)'), lambda u: u NOT IN ('̍', '̱')) AS us FROM i))
SELECT hymn_index, verse_ord, (k - 1)::INT AS word_ord, j::INT AS letter_ord, u AS value, {CLASS.format(c='u')} AS phoneme_class, {LENGTH.format(c='u')} AS vowel_length FROM u JOIN a USING (verse_id)"""
_PARSED = PARSED_VERSES.replace("WITH ", "", 1).replace("\nSELECT doc_id, (row_number()", ", pv AS (SELECT doc_id, (row_number()") + ")"
PARSED_METERS = (
    f"WITH {_PARSED}, " + METERS.replace(V, "v AS (SELECT doc_id * 1000000 + verse_ord AS verse_id, doc_id AS hymn_index, * EXCLUDE doc_id FROM pv)")
    .replace(WORDS.format(c="dev") + " AS ds", WORDS.format(c="dev_all") + " AS ds").replace(WORDS.format(c="iast") + " AS ws", WORDS.format(c="iast_all") + " AS ws")
    + f" SELECT hymn_index AS doc_id, verse_ord, verse_number, array_to_string(counts, '-') AS counts, {METER_OF.format(c='counts')} AS meter FROM mx"
)
DOCUMENTS_READ = f"""WITH {ALIGNED}, {PARTS}, rw AS (SELECT DISTINCT aligned_iast AS word FROM aw UNION SELECT DISTINCT word FROM i), {ROMAN_SYLLABLES},
lt AS (SELECT d.verse_id, count(*) AS words, sum(length(bare)) AS letters, sum(len(tokens)) AS syllables FROM d JOIN dt USING (word) GROUP BY 1), pr AS (SELECT verse_id, count(*) AS pairs FROM aw JOIN sp ON sp.word = aw.text JOIN ri ON ri.word = aw.aligned_iast AND ri.j = sp.j GROUP BY 1),
rm AS (SELECT i.verse_id, count(DISTINCT k) AS roman_words, count(ri.j) AS roman_syllables FROM i LEFT JOIN ri ON ri.word = i.word GROUP BY 1), bs AS (SELECT verse_id, sum(n - 1) AS boundaries FROM al GROUP BY 1)
SELECT hymn_index, verse_ord, verse_number, dev, iast, coalesce(words, 0)::INT AS words, coalesce(letters, 0)::INT AS letters, coalesce(syllables, 0)::INT AS syllables, coalesce(pairs, 0)::INT AS pairs, coalesce(roman_words, 0)::INT AS roman_words, coalesce(roman_syllables, 0)::INT AS roman_syllables, coalesce(boundaries, 0)::INT AS boundaries
FROM a LEFT JOIN lt USING (verse_id) LEFT JOIN pr USING (verse_id) LEFT JOIN rm USING (verse_id) LEFT JOIN bs USING (verse_id)"""
