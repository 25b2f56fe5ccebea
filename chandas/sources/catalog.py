"""A session: loaded hymns, renumbered as they come and go, with exports, search and comparison."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chandas.operators import align, compare, frequency, nesting, report, search

from . import sinks, tagged


def resolve(names: list[str], choice: str) -> str:
    """A listing's number (leading digits count), else a name without case, else the text itself."""
    choice = choice.strip()
    m = re.match(r"[+-]?\d+", choice)
    if m and 1 <= int(m[0]) <= len(names):
        return names[int(m[0]) - 1]
    return next((n for n in names if n.lower() == choice.lower()), choice)


class Session:
    """hymns(): hymn_index, source_path, export_base, ...; verses(): hymn_index, verse_ord, ... of what is loaded now."""

    def __init__(self, spark: SparkSession, folder: str = "Hymns"):
        self.spark, self.folder = spark, folder
        self.loaded: list[tuple[str, str]] = []  # path, export name
        self.used: set[str] = set()  # names stay taken after removal

    def _system(self, path: str):
        """The file system of a path, any that the cluster's executors can read, and the path in it."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _full(self, path: str) -> str:
        """The path with its scheme, as files read by the executors have it."""
        system, where = self._system(path)
        return system.makeQualified(where).toUri().getPath()

    def available(self) -> list[str]:
        """Names of the folder's text files, sorted by bytes."""
        system, where = self._system(self.folder)
        if not system.exists(where):
            return []
        names = [f.getPath().getName() for f in system.listStatus(where) if f.isFile()]
        return sorted((n for n in names if n.lower().endswith(".txt")), key=lambda n: n.encode())

    def listing(self) -> str:
        """The numbered list of the folder's files (fixed wording)."""
        names = self.available()
        return "\n".join(["Available hymn files in /Hymns:", *[f"  [{i}] {n}" for i, n in enumerate(names, 1)]]) if names else ""

    def path(self, name: str) -> str:
        return name if os.path.dirname(name) else os.path.join(self.folder, name)

    def exists(self, choice: str) -> bool:
        system, where = self._system(self.path(resolve(self.available(), choice)))
        return bool(choice.strip()) and system.exists(where)

    def add(self, *choices: str) -> None:
        for c in choices:
            path = self.path(resolve(self.available(), c))
            stem = os.path.splitext(os.path.basename(path))[0]
            base = "".join("_" if x in tagged.ILLEGAL else x for x in stem) or "Hymn"
            name, n = base, 1
            while name in self.used:
                n += 1
                name = f"{base}_{n}"
            self.used.add(name)
            self.loaded.append((path, name))

    def remove(self, request: str) -> bool:
        """A comma list of indexes; any that isn't loaded refuses the whole request. The rest is renumbered."""
        parts = [p.strip() for p in request.split(",") if p.strip()]
        if not parts or not all(re.fullmatch("[0-9]+", p) and 1 <= int(p) <= len(self.loaded) for p in parts):
            return False
        gone = {int(p) - 1 for p in parts}
        self.loaded = [x for i, x in enumerate(self.loaded) if i not in gone]
        return True

    def _parsed(self) -> DataFrame:
        kinds = "hymn_index int, source_path string, export_base string"
        if not self.loaded:
            return self.spark.createDataFrame([], kinds + ", text string")
        places = self.spark.createDataFrame([(i + 1, self._full(p), n) for i, (p, n) in enumerate(self.loaded)], kinds)
        return places.join(tagged.read_files(self.spark, sorted({p for p, _ in self.loaded})), "source_path", "left")

    def hymns(self) -> DataFrame:
        p = self._parsed()
        return p.select("hymn_index", "source_path", "export_base").join(tagged.hymns(tagged.lines(p, "hymn_index"), "hymn_index"), "hymn_index", "left")

    def verses(self) -> DataFrame:
        return tagged.with_meters(tagged.verses(tagged.lines(self._parsed(), "hymn_index"), "hymn_index")).drop("counts")

    def summary(self) -> DataFrame:
        """index, name, path, verses of every hymn, those without verses too."""
        n = self.verses().groupBy("hymn_index").agg(F.count(F.lit(1)).alias("verses"))
        return self.hymns().select("hymn_index", "export_base", "source_path").join(n, "hymn_index", "left").na.fill(0, ["verses"]).orderBy("hymn_index")

    def describe(self) -> dict[str, DataFrame]:
        """The detail report as frames: verses, aligned words, letters, syllables of both scripts side by side, and frequencies of verses and hymns."""
        v, keys = self.verses(), ["hymn_index", "verse_ord"]
        return {
            "verses": v.join(report.verse_lines(v).drop("verse_number", "meter"), keys),
            "words": align.aligned_words(v, keys),
            "letters": report.word_letters(v, keys),
            "syllable_pairs": report.syllable_pairs(v, keys),
            "verse_frequency": frequency.analysis_rows(v, keys),
            "hymn_frequency": frequency.analysis_rows(v, ["hymn_index"]),
        }

    def search(self, query: str, mode: str = "reference") -> DataFrame | str:
        r = search.parse(query)
        if r is None:
            return search.help_text()
        v = self.verses().join(self.hymns().select("hymn_index", "export_base"), "hymn_index", "left")
        return search.bad_pattern(v, r, mode) or search.search(v, r, ["hymn_index", "export_base", "verse_ord", "verse_number"], mode).orderBy("hymn_index", "verse_ord", "word_ord")

    def coverage(self, query: str) -> DataFrame | str:
        found = self.search(query)
        return found if isinstance(found, str) else search.coverage(self.hymns(), self.verses(), found)

    def compare_verses(self, references: str) -> DataFrame | str:
        """Comma list of hymn:verse, at least two."""
        refs = [p.strip() for p in references.split(",") if p.strip()]
        if len(refs) < 2:
            return "Select at least two verses."
        pairs = []
        for r in refs:
            m = re.fullmatch(r"\s*(\d+)\s*:\s*(\d+)\s*", r)
            if not m:
                return f"Invalid verse reference: {r}"
            pairs.append((int(m[1]), int(m[2])))
        got = compare.resolve_verses(self.hymns(), self.verses(), pairs)
        known = {r[0] for r in got.select("sel_ord").collect()}  # as many as were typed
        bad = [r for i, r in enumerate(refs) if i not in known]
        return f"Invalid verse reference: {bad[0]}" if bad else compare.compare_verses(got)

    def compare_hymns(self, indexes: str) -> DataFrame | str:
        refs = [p.strip() for p in indexes.split(",") if p.strip()]
        if len(refs) < 2 or not all(re.fullmatch("[0-9]+", r) and 1 <= int(r) <= len(self.loaded) for r in refs):
            return "Select at least two loaded hymns."
        return compare.compare_hymns(self.verses().filter(F.col("hymn_index").isin(*map(int, refs))))

    def tables(self) -> dict[str, DataFrame]:
        """The export tables of all loaded hymns; every table has hymn_index for a partitioned write."""
        h, v = self.hymns(), self.verses()
        keys = ["hymn_index", "verse_ord"]
        return {
            "full": nesting.letter_rows(h, v), "sandhi": align.boundaries(v, keys), "analysis": frequency.analysis_rows(v, ["hymn_index"]), "similarity": compare.verse_pairs(v), "json": nesting.verse_documents(v),
        }

    def export_tables(self, out: str) -> None:
        """The export tables of all loaded hymns, each in one distributed write, one folder a hymn."""
        for name, df in self.tables().items():
            sinks.write_partitioned(df, f"{out}/{name}", "hymn_index")

    def export(self, index: int, out: str = "HymnExports") -> list[str]:
        """The five single files of one hymn. Its rows stream through the driver; for collections use tables()."""
        h = self.hymns().filter(F.col("hymn_index") == index)
        v = self.verses().filter(F.col("hymn_index") == index).cache()
        row = h.first()
        base, path = row["export_base"], lambda end: os.path.join(out, row["export_base"] + end)
        head = [F.lit(row["mandala"] or 0).alias("Mandala"), F.lit(row["sukta"] or 0).alias("Sukta")]
        full = nesting.letter_rows(h.na.fill(0, ["mandala", "sukta"]), v)
        sinks.write_csv(full.withColumn("letter_place", F.coalesce("Letter_Index", "Letter_IAST_Index")), path(".csv"), ["hymn_index", "verse_ord", "Word_Index", "Syllable_Index", "letter_place"])
        b = align.boundaries(v, ["hymn_index", "verse_ord", "verse_number", "meter"])
        title = lambda c: "_".join(p.upper() if p in ("dev", "iast") else p.capitalize() for p in c.split("_"))
        cols = [c for c in b.columns if c not in ("hymn_index", "verse_ord", "verse_number", "meter")]
        b = b.select("verse_ord", *head, F.col("verse_number").alias("Verse"), F.col("meter").alias("Meter"), *[F.col(c).alias(title(c)) for c in cols])
        sinks.write_csv(b, path("_Sandhi.csv"), ["verse_ord", "Left_Underlying_Word_Index"])
        block = F.when(F.col("feat_type") == "Letter", 0).when(F.col("feat_type") == "Swara", 1).otherwise(2)
        a = frequency.analysis_rows(v, ["hymn_index"]).select(block.alias("block"), F.col("feat_type").alias("Type"), F.col("feat_key").alias("Key"), F.col("feat_value").alias("Value"))
        sinks.write_csv(a, path("_Analysis.csv"), ["block", "Key"], quoted=False)
        p = compare.verse_pairs(v)
        scores = [F.col(c).alias(title(c)) for c in p.columns if c.split("_")[0] in compare.KINDS]
        s = p.select("verse_ord_a", "verse_ord_b", *head, F.col("verse_number_a").alias("Verse_A"), F.col("verse_number_b").alias("Verse_B"), *scores)
        sinks.write_csv(s, path("_Similarity.csv"), ["verse_ord_a", "verse_ord_b"], decimals=6)
        docs = [r["document"].asDict(True) for r in nesting.verse_documents(v).orderBy("verse_ord").toLocalIterator()]
        totals = {k: {r["feat_key"]: r["feat_value"] for r in frequency.analysis_rows(v, ["hymn_index"]).filter(F.col("feat_type") == t).toLocalIterator()} for k, t in (("totalLetterFrequency", "Letter"), ("totalSwaraFrequency", "Swara"), ("totalPhonemeClassFrequency", "PhonemeClass"))}
        sims = [r.asDict() for r in p.orderBy("verse_ord_a", "verse_ord_b").toLocalIterator()]
        meta = {k: row[k] or ([] if k in ("rishis", "devatas", "categories") else 0) for k in ("mandala", "sukta", "rishis", "devatas", "categories")}
        sinks.write_json(meta | {"verses": docs, "verseSimilarities": sims, "analysis": totals}, path(".json"))
        v.unpersist()
        return [base + e for e in (".csv", "_Sandhi.csv", "_Analysis.csv", "_Similarity.csv", ".json")]
