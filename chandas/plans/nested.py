"""Queries p5: nested verse records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chandas.common import latest, table
from chandas.operators import nested

MAPS = ("analysis.letterFrequency", "analysis.swaraFrequency", "analysis.phonemeClassFrequency")
NODES = {"devWords": "dev_word", "devWords.alignment": "alignment", "devWords.alignment.dev.onset": "onset", "sandhi": "sandhi", "analysis.letterFrequency": "letter"}


def records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "verse_json").select("record_id", "payload")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    base = records(spark, sf)
    schema = nested.Schema(nested.infer(base, MAPS), MAPS)
    rows = nested.explode_all(base, schema, list(NODES), keys_only=True)
    name = F.create_map(*[F.lit(x) for kv in NODES.items() for x in kv])
    return rows.select("record_id", name[F.col("node")].alias("node"), "ordinals").distinct()


def _node(path: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return nested.flatten(latest(table(spark, sf, "verse_json"), ["record_id"], ["received_at"], ["payload"]), MAPS, [path])[path]

    return run


QUERIES = {
    "p5_found": p5_found, "p5_records": _node(""), "p5_words": _node("devWords"), "p5_alignment": _node("devWords.alignment"),
    "p5_sandhi": _node("sandhi"), "p5_letters": _node("analysis.letterFrequency"),
}

# The first argument of json paths; a bare object counts as an array of one.
_ARR = "CASE json_type({j}) WHEN 'ARRAY' THEN from_json({j}, '[\"JSON\"]') WHEN 'OBJECT' THEN [{j}] ELSE [] END"


def _each(src: str, expr: str, keep: str) -> str:
    return f"SELECT {keep}, unnest(a) AS j, unnest(range(len(a))) AS i FROM (SELECT *, {_ARR.format(j=expr)} AS a FROM {src})"


SQL = {
    "p5_found": (
        "WITH b AS (SELECT record_id, regexp_replace(payload, '^[\\s\\x{FEFF}]+|[\\s\\x{FEFF}]+$', '', 'g') AS t FROM verse_json WHERE payload IS NOT NULL), r AS (SELECT DISTINCT record_id, CASE WHEN json_valid(t) THEN t::JSON END AS o FROM b), "
        f"w AS (SELECT record_id, i::VARCHAR AS o, j FROM ({_each('r', 'json_extract(o, ' + chr(39) + '$.devWords' + chr(39) + ')', 'record_id')})), "
        f"a AS (SELECT record_id, o || '.' || i AS o, j FROM ({_each('w', 'json_extract(j, ' + chr(39) + '$.alignment' + chr(39) + ')', 'record_id, o')})), "
        f"n AS (SELECT record_id, o || '.' || i AS o FROM ({_each('a', 'json_extract(j, ' + chr(39) + '$.dev.onset' + chr(39) + ')', 'record_id, o')})), "
        f"s AS (SELECT record_id, i::VARCHAR AS o FROM ({_each('r', 'json_extract(o, ' + chr(39) + '$.sandhi' + chr(39) + ')', 'record_id')})), "
        "l AS (SELECT record_id, unnest(json_keys(json_extract(o, '$.analysis.letterFrequency'))) AS o FROM r WHERE json_type(json_extract(o, '$.analysis.letterFrequency')) = 'OBJECT') "
        "SELECT record_id, 'dev_word' AS node, o AS ordinals FROM w UNION SELECT record_id, 'alignment', o FROM a UNION SELECT record_id, 'onset', o FROM n UNION SELECT record_id, 'sandhi', o FROM s UNION SELECT record_id, 'letter', o FROM l"
    )
}

# The current payload of each record, by the table of each array level; fields are text cast to their type.
_CURRENT = (
    "b AS (SELECT record_id, regexp_replace(payload, '^[\\s\\x{FEFF}]+|[\\s\\x{FEFF}]+$', '', 'g') AS t FROM verse_json WHERE record_id IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY received_at DESC NULLS LAST, payload DESC NULLS LAST) = 1), r AS (SELECT record_id, t::JSON AS o FROM b WHERE json_valid(t) AND json_type(t::JSON) = 'OBJECT')"
)
_TEXT = "j->>'$.{f}' AS {n}"


def _texts(*fields: str) -> str:
    return ", ".join(_TEXT.format(f=f, n=f.replace(".", "_")) for f in fields)


def _casts(kind: str, *fields: str) -> str:
    return ", ".join(f"TRY_CAST(j->>'$.{f}' AS {kind}) AS {f.replace('.', '_')}" for f in fields)


_W = f"w AS (SELECT record_id, i, j FROM ({_each('r', 'json_extract(o, ' + chr(39) + '$.devWords' + chr(39) + ')', 'record_id')}) WHERE json_type(j) <> 'NULL')"
_A = f"a AS (SELECT record_id, w, i, j FROM ({_each('w', 'json_extract(j, ' + chr(39) + '$.alignment' + chr(39) + ')', 'record_id, i AS w')}) WHERE json_type(j) <> 'NULL')"
_S = f"s AS (SELECT record_id, i, j FROM ({_each('r', 'json_extract(o, ' + chr(39) + '$.sandhi' + chr(39) + ')', 'record_id')}) WHERE json_type(j) <> 'NULL')"
_SIDE = [f"{s}.{f}" for s in ("dev", "iast") for f in ("weight", "nucleus.value", "nucleus.phonemeClass", "nucleus.vowelLength", "nucleus.phoneme.type", "nucleus.phoneme.class", "nucleus.phoneme.consonantClass", "nucleus.phoneme.vowelLength", "nucleus.phoneme.base")]
SQL |= {
    "p5_records": f"WITH {_CURRENT}, q AS (SELECT record_id, o AS j FROM r) SELECT record_id, '' AS row_key, NULL::VARCHAR AS parent_key, NULL::INT AS ordinal, '' AS ordinals, {_texts('iast', 'eng', 'dev', 'meter')}, {_casts('BIGINT', 'verseNumber', 'exporter.build')} FROM q",
    "p5_words": f"WITH {_CURRENT}, {_W} SELECT record_id, '/devWords.' || i AS row_key, '' AS parent_key, i::INT AS ordinal, i::VARCHAR AS ordinals, {_texts('text', 'underlyingText', 'underlyingDevText', 'alignedIAST')} FROM w",
    "p5_alignment": (
        f"WITH {_CURRENT}, {_W}, {_A} SELECT record_id, '/devWords.' || w || '/alignment.' || i AS row_key, '/devWords.' || w AS parent_key, i::INT AS ordinal, w || '.' || i AS ordinals, {_texts(*_SIDE, 'dev.nucleus.swaraType')}, "
        f"{_casts('BOOLEAN', 'dev.nucleus.hasSwara', 'iast.nucleus.hasSwara')} FROM a"
    ),
    "p5_sandhi": (
        f"WITH {_CURRENT}, {_S} SELECT record_id, '/sandhi.' || i AS row_key, '' AS parent_key, i::INT AS ordinal, i::VARCHAR AS ordinals, {_texts('surfaceDev', 'leftUnderlyingIAST', 'rightUnderlyingIAST', 'category', 'subtype', 'confidence', 'notes')}, "
        f"{_casts('BIGINT', 'surfaceWordIndex', 'leftUnderlyingWordIndex', 'rightUnderlyingWordIndex')}, {_casts('BOOLEAN', 'detected')} FROM s"
    ),
    "p5_letters": (
        f"WITH {_CURRENT}, f AS (SELECT record_id, json_extract(o, '$.analysis.letterFrequency') AS m FROM r), k AS (SELECT record_id, m, unnest(json_keys(m)) AS k FROM f WHERE json_type(m) = 'OBJECT') "
        "SELECT record_id, '/analysis.letterFrequency.' || k AS row_key, '' AS parent_key, NULL::INT AS ordinal, k AS ordinals, TRY_CAST(m->>k AS BIGINT) AS value FROM k"
    ),
}
