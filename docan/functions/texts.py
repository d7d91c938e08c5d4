"""Text functions that the JVM has no expression for, over Arrow batches, and small ones that it has."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def normal_form(form: str):
    """A column function that brings text into a Unicode normal form (NFC, NFKC ...)."""

    @pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return run


def rtl_ratio_of(text: str | None) -> float:
    """Share of letters that are written from right to left."""
    letters = [unicodedata.bidirectional(c) for c in text or "" if unicodedata.bidirectional(c) in ("L", "R", "AL")]
    return sum(b != "L" for b in letters) / len(letters) if letters else 0.0


def rtl_ratio():
    @pandas_udf(T.DoubleType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(rtl_ratio_of)

    return run


def edit_distance(a: list | str, b: list | str) -> int:
    """Least number of insertions, deletions and replacements of items."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def error_rate(reference: list | str, hypothesis: list | str) -> float:
    """Edits per item of the reference; for an empty one 0 against nothing and 1 against anything."""
    if not reference:
        return 1.0 if hypothesis else 0.0
    return edit_distance(reference, hypothesis) / len(reference)


def word_error_rate():
    """Column function of (reference, hypothesis); null where one is null."""

    @pandas_udf(T.DoubleType())
    def run(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or h is None else error_rate(r.split(), h.split()) for r, h in zip(reference, hypothesis)], dtype="float64")

    return run


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Character edits per character of the reference, in the JVM."""
    n = F.length(reference)
    return F.when(n > 0, F.levenshtein(reference, hypothesis) / n).when(F.length(hypothesis) > 0, 1.0).when(F.length(hypothesis) == 0, 0.0)


def line_accuracy(reference: Column, hypothesis: Column) -> Column:
    """Share of the reference's lines that stand unchanged at the same place."""
    r, h = F.split(reference, "\r?\n"), F.split(hypothesis, "\r?\n")
    same = F.size(F.filter(F.zip_with(r, h, lambda x, y: x == y), lambda b: b == F.lit(True)))
    return same / F.size(r)


def agreement(a: Column, b: Column) -> Column:
    """1 less the edit distance over the greater length, of trimmed small letters."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(x == y, 1.0).otherwise(F.round(1 - F.levenshtein(x, y) / longest, 4))


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.depth, self.skip, self.cell = 0, 0, None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth and tag == "tr":
            self._close()
            self.tables[-1].append([])
        elif self.depth and tag in ("td", "th"):
            self._close()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th", "tr"):
            self._close()
        elif tag == "table" and self.depth:
            self._close()
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.cell is not None and not self.skip:
            self.cell.append(data)

    def _close(self) -> None:
        if self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def table_rows(html: str | None) -> list[list[list[str]]]:
    """Tables of a page as rows of cell texts; unclosed rows and cells end where the next begins."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    parser._close()
    return parser.tables


def html_tables():
    @pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
    def run(html: pd.Series) -> pd.Series:
        return html.map(table_rows)

    return run


def sanitise(html: Column, allowed: str = "table|thead|tbody|tr|th|td|br|p") -> Column:
    """Only the allowed tags, without attributes; scripts and styles go with their contents."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    bare = F.regexp_replace(bare, rf"(?i)<(?!/?(?:{allowed})\b)[^>]*>", "")
    return F.regexp_replace(bare, rf"(?i)<(/?)({allowed})\b[^>]*>", "<$1$2>")


def apply_glossary(text: Column, entries: list[tuple[str, str]]) -> Column:
    """Literal replacements one after the other, in the order given."""
    for source, target in entries:
        text = F.replace(text, F.lit(source), F.lit(target))
    return text


def merge_paragraphs(first: Column, second: Column) -> Column:
    """Two halves of a paragraph as one; a word broken at the end of the first is joined."""
    a, b = F.rtrim(first), F.ltrim(second)
    return F.when(a.rlike(r"\p{L}-$"), F.concat(F.regexp_replace(a, "-$", ""), b)).otherwise(F.concat(a, F.lit(" "), b))


def redacted_sample(text: Column, privileged: Column, tokens: Column, least: int = 500, size: int = 60) -> Column:
    """The first characters of a text; nothing of privileged or short ones."""
    return F.when(privileged | (tokens < least), F.lit("")).otherwise(F.substring(text, 1, size))


def evidence(text: Column, begin: Column, end: Column, around: int = 40, most: int = 200) -> Column:
    """Text around a span, blanks collapsed, cut with dots."""
    a = F.greatest(begin - around, F.lit(0))
    part = F.trim(F.regexp_replace(F.substring(text, a + 1, end + around - a), r"\s+", " "))
    return F.when(F.length(part) > most, F.concat(F.substring(part, 1, most), F.lit("..."))).otherwise(part)


def escape_cell(text: Column) -> Column:
    """Text that can stand in a cell of a Markdown table."""
    return F.regexp_replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def rank_sentences(text: str | None, most: int = 5, damping: float = 0.85, rounds: int = 30) -> list[str]:
    """The sentences that share most words with the others (rank by random walk), in their order."""
    import numpy as np

    parts = [s.strip() for s in _SENTENCE.split(text or "") if len(s.strip()) >= 10]
    if len(parts) <= most:
        return parts
    index: dict[str, int] = {}
    rows = [{index.setdefault(w, len(index)) for w in re.findall(r"\w+", s.lower())} for s in parts]
    m = np.zeros((len(parts), len(index)))
    for i, r in enumerate(rows):
        m[i, list(r)] = 1
    shared = m @ m.T
    np.fill_diagonal(shared, 0)
    size = np.log(np.maximum(m.sum(axis=1), 1))
    weight = shared / np.maximum(size[:, None] + size[None, :], 1e-9)
    total = weight.sum(axis=1, keepdims=True)
    step = np.divide(weight, total, out=np.full_like(weight, 1 / len(parts)), where=total > 0)
    score = np.full(len(parts), 1 / len(parts))
    for _ in range(rounds):
        score = (1 - damping) / len(parts) + damping * (step.T @ score)
    chosen = sorted(sorted(range(len(parts)), key=lambda i: (-score[i], i))[:most])
    return [parts[i] for i in chosen]


def summary(most: int = 5):
    @pandas_udf(T.ArrayType(T.StringType()))
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: rank_sentences(t, most))

    return run
