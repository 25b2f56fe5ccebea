"""Passages of evaluation items inside a corpus, by a generalised suffix automaton over words.

The automaton holds every run of words of every item. A document's words are streamed through it; the state always
stands for the longest run of item words that ends here. Where that run reaches `min_words`, the state of its last
`min_words` words names all items holding them. The automaton's size is bounded by the items (two states a word); past
MAX_BLOCK_WORDS the items are split into blocks of their own automaton each. Automata are built once and broadcast; the
corpus is read once, a group of documents being streamed through one automaton after the other.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 10
#: Item words in one automaton; with about 200 bytes a state, two states a word, under 100 MB in a Python worker.
MAX_BLOCK_WORDS = 200_000
#: Cleaning limits: spans of at least this many words are cut; documents covered beyond the share are dropped whole.
CUT_WORDS, DROP_COVERAGE = 10, 0.8

# The four accent marks.
ACCENTS = "॒̱॑̍"
_ACCENT_RE = re.compile(f"[{ACCENTS}]")


def _classes() -> tuple[re.Pattern, re.Pattern]:
    """Invisible characters (format characters, fillers, joiners, variation selectors), and separators of words."""
    cats: dict[str, list[str]] = {}
    for i in range(0x3100):
        cats.setdefault(unicodedata.category(chr(i)), []).append(chr(i))
    hidden = "".join(cats["Cf"]) + "".join(c for c in cats["Cc"] if not c.isspace())
    hidden += "".join(map(chr, [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0]))
    apart = "".join(c for k in ("Pi", "Pf", "Pd", "Zs", "Zl", "Zp") for c in cats[k])
    apart += "".join(map(chr, [0x201A, 0x201E, 0x2026, 0x2212, 0x964, 0x965, *range(0x300C, 0x3010)]))
    return re.compile(f"[{re.escape(hidden)}]"), re.compile("[\\s!-/:-@\\[-`{-~" + re.escape(apart) + "]+")


_HIDDEN, _APART = _classes()


def normalise(text: str) -> str:
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKC", text)
    t2 = _ACCENT_RE.sub("", _HIDDEN.sub("", t))
    if t2 is not t and len(t2) != len(t):
        t2 = unicodedata.normalize("NFKC", t2)
    return t2.casefold()


def words(text: str) -> list[str]:
    return [w for w in _APART.split(normalise(text)) if w]


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each state at depth `k`."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        self.k = k
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        seqs = []
        for item, text in items:
            seq = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if len(seq) >= k:
                seqs.append((item, seq))
                last = 0
                for c in seq:
                    last = self._extend(last, c)
        owners: list[set[int]] = [set() for _ in self.next]
        for item, seq in seqs:
            at = 0
            for c in seq:
                at = self.next[at][c]
                v = at
                while v > 0 and item not in owners[v]:
                    owners[v].add(item)
                    v = self.link[v]
        # the state that holds the last k words of whatever a state stands for
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        at_k = [-1] * len(self.next)
        for v in order:
            if self.length[v] >= k:
                p = self.link[v]
                at_k[v] = v if self.length[p] < k else at_k[p]
        self.at_k = at_k
        self.owners = {v: tuple(sorted(owners[v])) for v in set(at_k) if v >= 0}

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is None:
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p < 0:
                return cur
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
                return cur
            link[cur] = self._clone(p, q, c)
            return cur
        return self._clone(last, q, c)

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def stream(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(end word, matched length, state) wherever at least k words match."""
        get, nxt, link, length, k = self.vocabulary.get, self.next, self.link, self.length, self.k
        out, v, n = [], 0, 0
        for i, w in enumerate(tokens):
            c = get(w)
            if c is None:
                v = n = 0
                continue
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            t = nxt[v].get(c)
            if t is None:
                v = n = 0
                continue
            v, n = t, n + 1
            if n >= k:
                out.append((i + 1, n, v))
        return out


#: Characters of documents streamed through a block before the next is loaded, where there are several.
GROUP_CHARS = 16_000_000


def _blocks(items: DataFrame, k: int) -> list:
    """The stated query set as broadcast automata of bounded size each. Items come to the driver one partition at a time."""
    spark = items.sparkSession
    blocks, block, n = [], [], 0

    def close():
        if block:
            blocks.append(spark.sparkContext.broadcast(Automaton(block, k)))

    for r in items.select("item_id", "item_text").filter("item_id is not null and item_text is not null").toLocalIterator():
        block.append((r[0], r[1]))
        n += len(words(r[1]))
        if n >= MAX_BLOCK_WORDS:
            close()
            block, n = [], 0
    close()
    return blocks


def _loaded(blocks: list):
    """Each block's automaton in turn; a single one is kept between calls, of several only one is held at a time."""
    for b in blocks:
        yield b.value if len(blocks) == 1 or getattr(b, "_path", None) is None else b.load_from_path(b._path)


def _groups(batches, several: bool):
    """Rows of the batches, put together to groups of GROUP_CHARS where several automata wait. Column 1 is the text."""
    rows, n = [], 0
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            rows.append(row)
            n += len(row[1] or "")
        if rows and (not several or n >= GROUP_CHARS):
            yield rows
            rows, n = [], 0
    if rows:
        yield rows


REPORT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("longest", T.IntegerType()),
    T.StructField("words_matched", T.IntegerType()), T.StructField("doc_words", T.IntegerType()),
])


def _batch(rows: list[tuple], schema: T.StructType):
    import pyarrow as pa

    kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[type(f.dataType)]) for i, f in enumerate(schema)], names=schema.names)


def _measured(auto: Automaton, hits: list[tuple[int, int, int]]) -> dict[int, list[int]]:
    """Of each item in a document's hits: longest joined stretch, words matched, current stretch's start and end."""
    by: dict[int, list[int]] = {}
    for end, _, v in hits:
        for item in auto.owners[auto.at_k[v]]:
            e = by.setdefault(item, [0, 0, 0, 0])
            start = end - auto.k
            if start < e[3] and e[1]:
                e[1] += end - e[3]
            else:
                e[1] += auto.k
                e[2] = start
            e[3] = end
            e[0] = max(e[0], end - e[2])
    return by


def _report_with(blocks: list, k: int):
    def run(batches):
        for group in _groups(batches, len(blocks) > 1):
            docs = [(doc, t) for doc, text in group if len(t := words(text)) >= k]
            rows = []
            for auto in _loaded(blocks):
                for doc, tokens in docs:
                    if hits := auto.stream(tokens):
                        rows += [(doc, item, e[0], e[1], len(tokens)) for item, e in _measured(auto, hits).items()]
            yield _batch(rows, REPORT)

    return run


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, longest (joined stretch of shared runs, in words), words_matched, doc_words.

    documents: doc_id, text; items: item_id, item_text; other columns are ignored. Null or empty texts, and items of
    fewer than min_words words, match nothing. Repeated documents give repeated rows; items that share text all come
    out. One narrow pass over the documents, no shuffle.
    """
    blocks = _blocks(items, min_words)
    if not blocks:
        return documents.sparkSession.createDataFrame([], REPORT)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    return docs.mapInArrow(_report_with(blocks, min_words), REPORT)


@functools.lru_cache(maxsize=1 << 16)
def _extends(c: str) -> bool:
    """Whether a character may compose with what stands before it, or may stand hidden in between."""
    first = unicodedata.normalize("NFKC", c)[:1]
    return unicodedata.category(first)[0] == "M" or "\u1160" <= first <= "\u11ff" or bool(_HIDDEN.match(c))


def _offsets(text: str) -> list[tuple[str, int, int]]:
    """Words with their place in the raw text. Characters are normalised together with all that may compose with them."""
    out: list[tuple[str, int, int]] = []
    word, start, end, i = "", 0, 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and _extends(text[j]):
            j += 1
        for c in normalise(text[i:j]):
            if _APART.fullmatch(c):
                if word:
                    out.append((word, start, end))
                word = ""
            else:
                if not word:
                    start = i
                word += c
                end = j
        i = j
    return out + [(word, start, end)] if word else out


CLEAN = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("clean_text", T.StringType()), T.StructField("removed_chars", T.LongType()),
    T.StructField("coverage", T.DoubleType()), T.StructField("dropped", T.BooleanType()),
])


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, joined where they overlap or touch."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(text: str, places: list[tuple[str, int, int]], spans: list[tuple[int, int]], cut_words: int) -> tuple[str, int]:
    """The text without its spans of at least cut_words words, and how many characters went."""
    kept, at, gone = [], 0, 0
    for s, e in spans:
        if e - s >= cut_words:
            a, z = places[s][1], places[e - 1][2]
            kept.append(text[at:a])
            at, gone = z, gone + z - a
    return "".join(kept) + text[at:], gone


def _clean_with(blocks: list, k: int, cut_words: int, drop: float):
    def run(batches):
        for group in _groups(batches, len(blocks) > 1):
            docs = [words(text) if text else [] for _, text in group]
            spans: list[list[tuple[int, int]]] = [[] for _ in group]
            places: dict[int, list] = {}
            for auto in _loaded(blocks):
                for i in range(len(group)):
                    if len(docs[i]) < k or not (hits := auto.stream(docs[i])):
                        continue
                    if i not in places:  # from the first hit on, words are those whose places are known
                        places[i] = _offsets(group[i][1])
                        if len(places[i]) != len(docs[i]) or any(p[0] != w for p, w in zip(places[i], docs[i])):
                            docs[i] = [w for w, _, _ in places[i]]
                            hits = auto.stream(docs[i])
                    spans[i] += [(end - n, end) for end, n, _ in hits]
            rows = []
            for i, (doc, text) in enumerate(group):
                joined = _joined(spans[i])
                coverage = sum(e - s for s, e in joined) / len(docs[i]) if joined else 0.0
                if coverage > drop:
                    rows.append((doc, "", len(text), coverage, True))
                elif not joined:
                    rows.append((doc, text, 0, 0.0, False))
                else:
                    rows.append((doc, *_cut(text, places[i], joined, cut_words), coverage, False))
            yield _batch(rows, CLEAN)

    return run


def clean(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, cut_words: int = CUT_WORDS, drop_coverage: float = DROP_COVERAGE) -> DataFrame:
    """doc_id, clean_text, removed_chars, coverage, dropped: every document without its leaked spans.

    Spans of at least cut_words shared words are cut; a document whose words are covered beyond drop_coverage is
    emptied and marked. Null text stays null. Spans are places in the original text, gathered over all blocks of items
    and joined before anything is measured or cut, so the result doesn't depend on how the items are split.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = _blocks(items, min_words)
    if not blocks:
        return docs.select("doc_id", F.col("text").alias("clean_text"), F.lit(0).cast("long").alias("removed_chars"), F.lit(0.0).alias("coverage"), F.lit(False).alias("dropped"))
    return docs.mapInArrow(_clean_with(blocks, min_words, cut_words, drop_coverage), CLEAN)
