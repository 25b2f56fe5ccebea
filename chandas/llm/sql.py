"""SQL that computes the same as some of the queries, without their methods."""

from __future__ import annotations

from .queries import CLASSES, SWARAS

# p1: brute force over the probes. Keys are compared without case and outer blanks.
_SUM = "coalesce(list_sum(list_transform(list_filter(map_entries({m}), lambda e: lower(regexp_replace(e.key, '^\\s+|\\s+$', '', 'g')) = '{k}'), lambda e: coalesce(e.value, 0))), 0)::DOUBLE"
_VEC = "[" + ", ".join([_SUM.format(m="phoneme_class_frequency", k=c) for c in CLASSES] + [_SUM.format(m="swara_frequency", k=s) for s in SWARAS]) + "]"
_VECTORS = (
    "c AS (SELECT * FROM verse_analysis WHERE verse_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY verse_id ORDER BY exported_at DESC NULLS LAST) = 1), "
    f"x AS (SELECT verse_id AS id, {_VEC} AS v FROM c), n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS m FROM x)"
)
_NEAR = (
    "p AS (SELECT q.id AS query_id, o.id AS neighbor_id, round(list_dot_product(q.v, o.v) / (q.m * o.m), 9) AS cosine FROM n q JOIN n o ON q.id <> o.id WHERE {where} AND q.m > 0 AND o.m > 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, neighbor_id) AS rank FROM p WHERE cosine > 0)"
)
P1_FOUND = f"WITH {_VECTORS}, {_NEAR.format(where='q.id IN (SELECT verse_id FROM knn_probes)')} SELECT DISTINCT least(query_id, neighbor_id) AS verse_a, greatest(query_id, neighbor_id) AS verse_b FROM r WHERE rank <= 5"

P1_KNN = f"WITH {_VECTORS}, {_NEAR.format(where='q.id % 100 = 0')} SELECT query_id, neighbor_id, cosine, rank::INT AS rank FROM r WHERE rank <= 5"
P1_EMBEDDINGS = (
    "WITH x AS (SELECT vec_id AS id, list_transform(embedding, lambda y: y::DOUBLE) AS v FROM embeddings), n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS m FROM x), "
    + _NEAR.format(where="q.id % 100 = 0") + " SELECT query_id, neighbor_id, rank::INT AS rank FROM r WHERE rank <= 10"
)

# p2: by what a value holds: hidden characters, odd spaces, full-width forms, letters of other alphabets, anything not
# composed, Devanagari written in parts, signs for the visarga, accents in another order than the composed one.
P2_FOUND = r"""
WITH v AS (SELECT 'dev' AS field_name, verse_id AS row_id, dev AS x FROM verses UNION ALL SELECT 'iast', verse_id, iast FROM verses UNION ALL SELECT 'surface_iast', boundary_id, surface_iast FROM sandhi)
SELECT DISTINCT field_name, row_id FROM v WHERE x IS NOT NULL AND (nfc_normalize(x) <> x OR regexp_matches(x, '[\x{AD}\x{34F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{FE00}-\x{FE0F}]')
  OR regexp_matches(x, '[\t-\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]') OR regexp_matches(x, '[\x{FF01}-\x{FF5E}]') OR regexp_matches(x, '[\p{Cyrillic}\p{Greek}\p{Armenian}ıɡɑ''`‘ʼ]')
  OR regexp_matches(x, 'अा|अो|अौ|आे|आै|एे|ाे|ाै|ेा|ैा|ेे|ोे|र्इ|उू|ऋृ|ृृ|।।') OR regexp_matches(x, '[\x{900}-\x{97F}][:꞉：∶ː]'))
"""

_HIDDEN, _SPACES = r"[\x{AD}\x{34F}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]", r"[\t-\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SPELLED = f"nfc_normalize(translate(regexp_replace(regexp_replace(x, '{_HIDDEN}', '', 'g'), '{_SPACES}', ' ', 'g'), 'ıɡɑνοаеорсуѕіјһԁａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ', 'igavoaeopcysijhdabcdefghijklmnopqrstuvwxyz'))"
for _a, _b in (pair.split() for pair in ("अाे ओ", "अाै औ", "र्इ ई", "अा आ", "अो ओ", "अौ औ", "आे ओ", "आै औ", "एे ऐ", "ाे ो", "ाै ौ", "ेा ो", "ैा ौ", "ेे ै", "ोे ौ", "उू ऊ", "ऋृ ॠ", "ृृ ॄ", "।। ॥")):
    _SPELLED = f"replace({_SPELLED}, '{_a}', '{_b}')"
P2_CANONICAL = (
    "WITH v AS (SELECT 'dev' AS field_name, verse_id AS row_id, dev AS x FROM verses UNION ALL SELECT 'iast', verse_id, iast FROM verses UNION ALL SELECT 'surface_iast', boundary_id, surface_iast FROM sandhi) "
    f"SELECT DISTINCT field_name, row_id, x AS value, regexp_replace({_SPELLED}, '([\\x{{900}}-\\x{{97F}}])[:꞉]', '\\1ः', 'g') AS canonical FROM v WHERE x IS NOT NULL"
)

# p3: all windows of all lines.
P3_FOUND = """
WITH t AS (SELECT DISTINCT 'dev' AS f, verse_id AS id, dev AS x FROM verses WHERE length(dev) >= 60 UNION SELECT DISTINCT 'iast', verse_id, iast FROM verses WHERE length(iast) >= 60),
g AS (SELECT f, id, x, unnest(range(0, length(x) - 59)) AS p FROM t), w AS (SELECT f, id, p, substring(x, p + 1, 60) AS s FROM g WHERE id IS NOT NULL),
h AS (SELECT f, s FROM w GROUP BY f, s HAVING min(id) <> max(id)), m AS (SELECT DISTINCT f, id, p FROM w JOIN h USING (f, s)),
o AS (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY f, id ORDER BY p) + 60 THEN 1 ELSE 0 END AS fresh FROM m), n AS (SELECT *, sum(fresh) OVER (PARTITION BY f, id ORDER BY p) AS k FROM o)
SELECT f AS field_name, id AS verse_id, min(p)::INT AS span_from, (max(p) + 60)::INT AS span_to FROM n GROUP BY f, id, k
"""

P3_COVERAGE = f"""
WITH g AS (SELECT field_name AS field, verse_id AS id, sum(span_to - span_from)::BIGINT AS shared_chars FROM ({P3_FOUND}) GROUP BY 1, 2),
b AS (SELECT field, id, max(length(text)) AS chars FROM (SELECT 'dev' AS field, verse_id AS id, dev AS text FROM verses UNION ALL SELECT 'iast', verse_id, iast FROM verses) WHERE text IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2)
SELECT field, id, coalesce(shared_chars, 0) AS shared_chars, chars::INT AS chars, CASE WHEN chars > 0 THEN coalesce(shared_chars, 0) / chars ELSE 0.0 END AS share FROM b LEFT JOIN g USING (field, id)
"""

_TERMS = r"""
v AS (SELECT * FROM verse_analysis WHERE verse_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY verse_id ORDER BY exported_at DESC NULLS LAST) = 1),
l AS (SELECT 'letter' AS term_set, verse_id::VARCHAR AS r, e.key AS term, e.value::BIGINT AS n FROM (SELECT verse_id, unnest(map_entries(letter_frequency)) AS e FROM v) WHERE e.value > 0),
k AS (SELECT export_base, CASE lower(regexp_replace(feat_type, '^\s+|\s+$', '', 'g')) WHEN 'letter' THEN 'Letter' WHEN 'swara' THEN 'Swara' WHEN 'phonemeclass' THEN 'PhonemeClass' END AS type,
  nfc_normalize(regexp_replace(feat_key, '^[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')) AS key, feat_value, exported_at, received_at FROM analysis WHERE export_base IS NOT NULL),
a AS (SELECT * FROM k WHERE type IS NOT NULL AND key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY export_base, type, key ORDER BY exported_at DESC NULLS LAST, received_at DESC NULLS LAST, feat_value DESC NULLS LAST) = 1),
o AS (SELECT * FROM l UNION ALL SELECT 'key', export_base, type || ':' || key, feat_value FROM a WHERE feat_value > 0 UNION ALL SELECT 'value', export_base, feat_value::VARCHAR, 1 FROM a WHERE feat_value > 0),
c AS (SELECT term_set, term, sum(n)::BIGINT AS cf, count(DISTINCT r) AS df FROM o GROUP BY 1, 2),
s AS (SELECT 'letter' AS term_set, count(DISTINCT verse_id) AS records FROM verse_analysis UNION ALL SELECT 'key', count(DISTINCT export_base) FROM analysis UNION ALL SELECT 'value', count(DISTINCT export_base) FROM analysis),
d AS (SELECT term_set, term, cf, df, CASE WHEN df <= 3 THEN 'rare' WHEN df > 0.9 * records THEN 'common' ELSE 'useful' END AS verdict FROM c JOIN s USING (term_set))
"""
P4_WORD_NGRAMS = r"""
WITH t AS (SELECT verse_id, max(iast) AS x FROM verses WHERE verse_id IS NOT NULL GROUP BY 1), w AS (SELECT verse_id, list_filter(regexp_split_to_array(x, '[ \t\n\r\x0B\f|।॥]+'), lambda y: y <> '') AS a FROM t WHERE x IS NOT NULL),
i AS (SELECT verse_id, a, unnest(range(1, len(a) + 1)) AS p FROM w), n AS (SELECT verse_id, a, p, unnest(range(1, least(3, len(a) - p + 1) + 1)) AS k FROM i)
SELECT array_to_string(a[p:p + k - 1], ' ') AS ngram, count(*) AS cf, count(DISTINCT verse_id) AS df FROM n GROUP BY 1
"""
# p6: all runs of 10 words. Of the compatibility forms the texts hold full-width ones, no-break spaces and sharp s.
_NORMAL = r"""list_filter(regexp_split_to_array(replace(lower(nfc_normalize(translate(regexp_replace({c}, '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}\x{{951}}\x{{952}}\x{{30D}}\x{{331}}]', '', 'g'),
'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９．，；：！？（）', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.,;:!?()'))), 'ß', 'ss'),
'[\s\x{{A0}}!-/:-@\[-`{{-~।॥‘’‚“”„«»‹›\x{{2010}}-\x{{2015}}…\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'), lambda w: w <> '')"""
_LEAKS = f"""
d AS (SELECT doc_id, {_NORMAL.format(c='text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_NORMAL.format(c='item_text')} AS w FROM eval_items WHERE item_text IS NOT NULL),
dg AS (SELECT doc_id, len(w) AS n, p, array_to_string(w[p:p + 9], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 8)) AS p FROM d)), ig AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 8)) AS p FROM i)),
m AS (SELECT DISTINCT doc_id, item_id, n, p FROM dg JOIN ig USING (g))
"""
P6_FOUND = f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM m"
P6_REPORT = f"""WITH {_LEAKS}, o AS (SELECT *, CASE WHEN p >= lag(p) OVER (PARTITION BY doc_id, item_id ORDER BY p) + 10 THEN 1 ELSE 0 END AS fresh FROM m), k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY p) AS k FROM o),
r AS (SELECT doc_id, item_id, n, k, max(p) - min(p) + 10 AS size FROM k GROUP BY ALL) SELECT doc_id, item_id, max(size)::INT AS longest, sum(size)::INT AS words_matched, n::INT AS doc_words FROM r GROUP BY doc_id, item_id, n"""
P7_FOUND = r"""
WITH d AS (SELECT regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s_\-]+', '_', 'g') AS source, coalesce(strlen(text), 0) AS n FROM documents),
t AS (SELECT m.source, target_share, max_repeats, coalesce(sum(n), 0) AS tokens FROM mix_targets m LEFT JOIN d ON d.source = m.source GROUP BY 1, 2, 3)
SELECT source FROM t WHERE tokens * max_repeats < target_share * (SELECT sum(tokens) FROM t) / 2
"""
# p7: each source's records in the order of their hash, as far as what is left of the budget after full copies goes.
_MIX = r"""
d AS (SELECT doc_id AS id, regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s_\-]+', '_', 'g') AS source, coalesce(strlen(text), 0)::BIGINT AS tokens FROM documents),
t AS (SELECT m.source, target_share, max_repeats, coalesce(sum(d.tokens), 0)::BIGINT AS tokens FROM mix_targets m LEFT JOIN d ON d.source = m.source GROUP BY 1, 2, 3),
b AS (SELECT *, target_share * (SELECT sum(tokens) FROM t) / 2 AS wanted FROM t), f AS (SELECT *, CASE WHEN tokens > 0 THEN least(floor(wanted / tokens), max_repeats) ELSE 0 END AS whole FROM b),
r AS (SELECT *, CASE WHEN whole < max_repeats THEN wanted - whole * tokens ELSE 0.0 END AS rest FROM f),
o AS (SELECT d.id, d.source, d.tokens, whole, rest, sum(d.tokens) OVER (PARTITION BY d.source ORDER BY substring(md5(d.id::VARCHAR), 1, 15)) AS used FROM d JOIN r ON r.source = d.source),
p AS (SELECT id, source, tokens, (whole + CASE WHEN used <= rest THEN 1 ELSE 0 END)::INT AS copies FROM o)
"""
P7_PLAN = f"WITH {_MIX} SELECT id, source, tokens, copies FROM p WHERE copies > 0"
P7_REPORT = f"""WITH {_MIX}, u AS (SELECT source, sum(tokens * copies)::BIGINT AS used_tokens FROM p GROUP BY 1) SELECT r.source, target_share, coalesce(coalesce(used_tokens, 0) / (SELECT sum(used_tokens) FROM u), 0.0) AS actual_share, r.tokens,
coalesce(used_tokens, 0) AS used_tokens, r.tokens * max_repeats >= wanted AS reachable FROM r LEFT JOIN u ON u.source = r.source"""

SQL = {
    "p1_found": P1_FOUND,
    "p1_knn": P1_KNN,
    "p1_embeddings": P1_EMBEDDINGS,
    "p2_found": P2_FOUND,
    "p2_canonical": P2_CANONICAL,
    "p3_found": P3_FOUND,
    "p3_compacted": P3_FOUND,
    "p3_coverage": P3_COVERAGE,
    "p4_found": f"WITH {_TERMS} SELECT term_set, term, verdict FROM d WHERE verdict <> 'useful'",
    "p4_counts": f"WITH {_TERMS} SELECT term_set, term, cf, df, verdict FROM d",
    "p4_word_ngrams": P4_WORD_NGRAMS,
    "p6_found": P6_FOUND,
    "p6_report": P6_REPORT,
    "p7_found": P7_FOUND,
    "p7_plan": P7_PLAN,
    "p7_report": P7_REPORT,
}
