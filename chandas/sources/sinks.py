"""Exports: single CSV and JSON files of one hymn, and partitioned output for whole collections."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tasks over which one folder's rows are spread.
SPREAD = 8
BOM = "﻿"


def quote(value) -> str:
    return '"' + ("" if value is None else str(value)).replace('"', '""') + '"'


def _cell(value, kind: T.DataType, decimals: int | None, quoted: bool) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(kind, (T.DoubleType, T.FloatType)) and decimals is not None:
        return f"{value:.{decimals}f}"
    return quote(value) if quoted and isinstance(kind, T.StringType) else str(value)


def write_csv(df: DataFrame, path: str, order: list[str], decimals: int | None = None, quoted: bool = True) -> None:
    """One hymn's table as a single file with byte-order mark; rows stream to the driver in order."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(BOM + ",".join(c for c in df.columns if c not in order or not c.islower()) + "\n")
        shown = [(i, x.dataType) for i, x in enumerate(df.schema) if x.name not in order or not x.name.islower()]
        for r in df.orderBy(*order).toLocalIterator():
            f.write(",".join(_cell(r[i], t, decimals, quoted) for i, t in shown) + "\n")


def write_json(document: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, indent=2, sort_keys=True)


def write_partitioned(df: DataFrame, path: str, by: str, fmt: str = "parquet") -> None:
    """A whole collection's table in one distributed write, one folder a value of `by`; no single file is built on the driver.

    Rows of one value are spread over a few tasks by their hash, so a value that holds a third of them has no task to itself.
    """
    df.repartition(F.col(by), F.pmod(F.xxhash64(F.to_json(F.struct(*df.columns))), F.lit(SPREAD))).write.mode("overwrite").partitionBy(by).format(fmt).save(path)


LETTER = "struct<value:string,hasSwara:boolean,swaraType:string,phonemeClass:string,vowelLength:string>"
SYLLABLE = f"struct<onset:array<{LETTER}>,nucleus:{LETTER},coda:array<{LETTER}>,weight:string,swaras:array<string>>"
WORD = f"struct<text:string,alignedIAST:string,alignedIASTUnderlying:string,underlyingDevText:string,letters:array<{LETTER}>,devSyllables:array<{SYLLABLE}>,alignment:array<struct<dev:{SYLLABLE},iast:{SYLLABLE}>>>"
BOUNDARY = "struct<surfaceWordIndex:int,leftUnderlyingWordIndex:int,rightUnderlyingWordIndex:int,surfaceDev:string,surfaceIAST:string,category:string,subtype:string,confidence:string,detected:boolean>"
ROMAN = f"struct<text:string,letters:array<{LETTER}>,iastSyllables:array<{SYLLABLE}>>"
VERSE = f"struct<verseNumber:int,meter:string,dev:string,iast:string,eng:string,devWords:array<{WORD}>,iastWords:array<{ROMAN}>,sandhi:array<{BOUNDARY}>>"
HYMN = f"mandala int, sukta int, rishis array<string>, devatas array<string>, categories array<string>, verses array<{VERSE}>"


def read_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Hymns back from their documents: metadata and verses with their words, letters and syllables. Bad documents give null fields."""
    return df.withColumn("_h", F.from_json(column, HYMN)).select(*[c for c in df.columns if c != column], "_h.*")


def read_verse_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Verses back from their documents, with words, letters and syllables. Bad documents give null fields."""
    return df.withColumn("_v", F.from_json(column, VERSE)).select(*[c for c in df.columns if c != column], "_v.*")
