"""The step-by-step session: menus, prompts, and result texts over a Session.

Texts of results stream through the driver row by row; for collections use the Session's frames. `ask` gives the next
line a user types (None at the end of input, which ends the session), `say` shows a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chandas.operators import compare, search

from .catalog import Session

# Menus and the requests that their entries stand for.
MAIN = ["Search", "Compare", "List loaded hymns", "Add hymn", "Remove hymn", "Help", "Exit"]
SEARCHES = {
    "Find verses containing text": "find all verses containing ", "Find words containing text or letters": "find words containing ", "Find all occurrences of text": "find all occurrences of ",
    "Find words beginning with a prefix": "find words beginning with ", "Find words ending with a suffix": "find words ending with -", "Find vowel span pattern": "find vowel span patterns ",
    "Find phoneme class": "find verse/words containing particular phoneme class ", "Find manner of articulation": "find verse/words containing particular manner of articulation ",
    "Find consonant clusters by length": "find consonant clusters of length >= ",
}
COMPARES = ["Compare verses", "Compare hymns", "Compare one search pattern across hymns"]
PICKED = {
    "Find phoneme class": "Vowel Velar Palatal Retroflex Dental Labial Nasal Semivowel Liquid Sibilant Aspirate Other".split(),
    "Find manner of articulation": "stops nasals sibilants semivowels liquids aspirates vowels consonants".split(),
}


class _End(Exception):
    """The user ended the session."""


class _Back(Exception):
    """The user went back one menu."""


def summary_text(session: Session) -> str:
    rows = session.summary().toLocalIterator()
    return "\n".join(["Loaded hymns:", *[f"  [{r.hymn_index}] {r.export_base} ({r.source_path}) verses={r.verses}" for r in rows]])


def search_text(session: Session, query: str) -> str:
    """Heading, every hymn's numbers, and each match with its verse; or what is said of a request or pattern that is none."""
    found = session.search(query)
    if isinstance(found, str):
        return found
    out = [f"Search results for {search.describe(search.parse(query))}"]
    rows = list(_lines(found))
    if not rows:
        return "\n".join([*out, "No matches found."])
    out.append("Summary by hymn:")
    out += [f"  [{r.hymn_index}] {r.export_base} matches={r.matches} verses={r.matched_verses}" for r in _counted(session, found)]
    return "\n".join([*out, "Detailed matches:", *rows])


def _counted(session: Session, found: DataFrame):
    h = session.hymns()
    return search.coverage(h, session.verses(), found).join(h.select("hymn_index", "export_base"), "hymn_index").orderBy("hymn_index").toLocalIterator()


def _lines(found: DataFrame):
    for r in found.toLocalIterator():
        words = f' DEV="{r.dev_word}"' + (f' IAST="{r.iast_word}"' if r.iast_word else "") if r.dev_word or r.iast_word else ""
        yield f"  [{r.hymn_index}] {r.export_base} Verse {r.verse_number}{words} ({r.detail})\n    Verse DEV: {r.verse_dev}\n    Verse IAST: {r.verse_iast}"


def coverage_text(session: Session, query: str) -> str:
    """A request's numbers in every hymn, and the references of its matches."""
    found = session.search(query)
    if isinstance(found, str):
        return found
    out = [f"Comparison of query across loaded hymns: {search.describe(search.parse(query))}"]
    for r in _counted(session, found):
        out.append(f"  [{r.hymn_index}] {r.export_base} matches={r.matches} matchedVerses={r.matched_verses} totalVerses={r.total_verses} verseCoverage={r.coverage:.3f}")
    refs = [
        f"  [{r.hymn_index}] {r.export_base}:{r.verse_number}" + (f' DEV="{r.dev_word}"' if r.dev_word else "") + (f' IAST="{r.iast_word}"' if r.iast_word else "")
        for r in found.toLocalIterator()
    ]
    return "\n".join([*out, "Matched verse references:", *refs] if refs else [*out, "No hymns matched the comparison query."])


def scores_text(got: DataFrame | str, names: list[str]) -> str:
    """Pairs with their scores, six decimals."""
    if isinstance(got, str):
        return got
    shown = [f"{k}_{s}" for k in compare.KINDS for s in ("dot_product", "cosine_similarity", "confidence")]
    rows = got.orderBy(*names).select(*names, *[F.round(c, 6).alias(c) for c in shown]).toLocalIterator()
    return "\n".join(" ".join(f"{c}={r[c]}" if c in names else f"{c}={r[c]:.6f}" for c in [*names, *shown]) for r in rows)


class Console:
    """A session driven by typed lines."""

    def __init__(self, session: Session, ask: Callable[[str], str | None], say: Callable[[str], None]):
        self.session, self.ask, self.say = session, ask, say

    def _line(self, prompt: str) -> str:
        got = self.ask(prompt)
        if got is None or got.strip().lower() in ("exit", "quit", "stop"):
            raise _End
        return got.strip(" \t\r\n")

    def _pick(self, title: str, options: list[str], back: bool = True) -> str:
        """One of the options by its number."""
        while True:
            menu = [title, *[f"  {i}. {o}" for i, o in enumerate(options, 1)], "Type a number, or `back` to return." if back else "Type a number."]
            self.say("\n".join(menu))
            got = self._line("Selection: ")
            if back and got.lower() in ("back", "cancel"):
                raise _Back
            if got.isdecimal() and 1 <= int(got) <= len(options):
                return options[int(got) - 1]
            self.say("Invalid selection.")

    def _value(self, prompt: str, help_text: str = "No additional help is available for this step.") -> str:
        while True:
            got = self._line(prompt)
            if got.lower() == "help":
                self.say(help_text)
            elif got.lower() in ("back", "cancel"):
                raise _Back
            elif got:
                return got
            else:
                self.say("Input cannot be empty.")

    def build_search(self) -> str:
        """A request put together step by step; going back from a value shows the kinds again."""
        while True:
            kind = self._pick("Search", list(SEARCHES))
            try:
                value = self._pick(kind, PICKED[kind]) if kind in PICKED else self._value(f"{kind} (`back` to return): ")
            except _Back:
                continue
            return SEARCHES[kind] + value

    def search(self) -> None:
        self.say(search_text(self.session, self.build_search()))

    def compare(self) -> None:
        while True:
            kind = self._pick("Compare", COMPARES)
            try:
                if kind == COMPARES[0]:
                    self.say(summary_text(self.session))
                    refs = self._value("Verse references as hymnIndex:verseNumber, comma-separated (`back` to return): ", "Example: 1:4,2:6")
                    self.say(scores_text(self.session.compare_verses(refs), ["sel_ord_a", "sel_ord_b"]))
                elif kind == COMPARES[1]:
                    self.say(summary_text(self.session))
                    refs = self._value("Hymn indices, comma-separated (`back` to return): ", "Example: 1,2")
                    self.say(scores_text(self.session.compare_hymns(refs), ["hymn_index_a", "hymn_index_b"]))
                else:
                    self.say(coverage_text(self.session, self.build_search()))
            except _Back:
                continue
            return

    def load(self) -> bool:
        """The first files: how many, then each by number or name, asked again until it exists. False where no number is given."""
        first = self._line("Enter number of hymn files to input\n")
        if not first.isdecimal() or int(first) < 1:
            self.say("Invalid number of hymn files.")
            return False
        self.say(self.session.listing())
        for i in range(int(first)):
            self._add(f"Enter File Name for {i + 1}: ")
        return True

    def _add(self, prompt: str) -> None:
        while True:
            name = self._line(prompt)
            if self.session.exists(name):
                self.session.add(name)
                return
            self.say("Empty file name provided. Enter a listed number or file name." if not name else "Enter a listed number or file name from /Hymns.")

    def _once(self, action: str) -> None:
        if action == "Search":
            self.search()
        elif action == "Compare":
            self.compare()
        elif action == "Add hymn":
            self.say(self.session.listing())
            self._add("File name or number (`exit` to end): ")
            self.session.export(len(self.session.loaded), self.out)
        elif action == "Remove hymn":
            if not self.session.remove(self._value("Hymn indices to remove, comma-separated (`back` to return): ")):
                self.say("Invalid hymn selection.")
        elif action == "Help":
            self.say(search.help_text())
        if action in ("List loaded hymns", "Add hymn", "Remove hymn"):
            self.say(summary_text(self.session))

    def run(self, out: str = "HymnExports") -> int:
        """The whole session: load, export, then the main menu until its end. 1 where nothing was to be loaded, else 0."""
        self.out = out
        try:
            if not self.load():
                return 1
            for i in range(len(self.session.loaded)):
                self.session.export(i + 1, out)
            self.say(summary_text(self.session))
            while (action := self._pick("Main Menu", MAIN, back=False)) != "Exit":
                try:
                    self._once(action)
                except _Back:
                    continue
        except _End:
            pass
        self.say("Session terminated.")
        return 0
