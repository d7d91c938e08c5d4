"""Noise of scanned pages: broken words, misread characters, running headers and page numbers; and their repair.

Lines are first classed: page numbers by their notation at the edge of a page, running headers as title
lines that recur, not always letter for letter, at the edges of pages of one document. What is left
is body; words broken at line and page ends are joined, and the joined text is read for misread words.

A misread word is looked for in the vocabulary by intersecting the word's Levenshtein automaton (one
edit) with a trie of the vocabulary, of which those are taken that differ in letters scanners read for each other. Digits and signs read for
letters are folded in both, and the search takes letter groups which scanners read for each other
(``rn``/``m``, ``cl``/``d``, ``ii``/``u``, ``ri``/``n``) as groups and as letters, so that both are no edit at all, a sign inside a group neither. Candidates are complete within that distance; they are ranked by the kind
of edit, by the words around them and by frequency.

A word is misread if a candidate is ``RATIO`` times as frequent in the whole corpus (``SHORT_RATIO``
times for short words); both counts are exact. What is said of a word depends on these two counts only,
so neither unrelated texts nor the size of the corpus change it. The vocabulary is a table as large as
it is: it is cut into shards of which any two words one edit apart share at least one (the beginning or
the end of the shorter half), and each shard's trie is searched by the tokens of the same shard. Only
``HEAD`` of the most frequent words are sent to the tasks, to settle them at once; all others are
settled by joins.

Defined results
* null or empty text: no noise, text unchanged; null document id of a page: the page is a document of
  its own, so that none of its lines recurs;
* repeated rows: a page is one page however often it is stored (its words count as often);
* ties between candidates: the more frequent, then the first by code point;
* very long texts: processed whole; empty tables: empty result; extra columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docan.llm.lookalikes import normalise
from docan.session import checkpoint

#: How many times as frequent as the word a candidate must be, and as a word of up to three letters.
RATIO, SHORT_RATIO = 12, 100
#: Occurrences of a candidate for a word that holds digits or signs.
LEAST = 8
#: Most frequent words that are sent to the tasks; all others are settled by joins.
HEAD = 50_000

_MARKS = "-¬­‐"
_BROKEN = re.compile(rf"[{_MARKS}][ \t]*\n[ \t]*(?=[^\W\d_])")
_BROKEN_PAGE = re.compile(rf"([{_MARKS}])[ \t]*\n\s*\n[ \t]*(?=[a-zà-ÿ])")
_BREAK_END = re.compile(rf"[^\W\d_][{_MARKS}][ \t]*$")
_HALF_LAST = re.compile(rf"[^{_MARKS}\s]*[{_MARKS}]$")
_HALF_FIRST = re.compile(r"^\s*[a-zà-ÿ]+(?![\w@~])")
_TOKEN = re.compile(r"[^\s.,;:!?()\[\]\"“”«»/<>]+")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_NOISY = re.compile(r"(?=[^\s]*[^\W\d_])[^\W_~@]?[^\W_]*[\d@~][\w@~]*")
_ROMAN = r"(?=[ivxlcdm])(?:m{0,3})(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBER = rf"(?:[0-9OlIo]{{0,3}}[0-9][0-9OlIo]{{0,3}}|{_ROMAN})"
_PAGE_WORD = r"(?:p[a@][gq9][ec]|p|pg|pp|seite|s|p[áa]gina|p[áa]g|blatt|folio|fol|feuille|hoja)"
_PAGENO = rf"[\-–—\[(|~]*\s*(?:{_PAGE_WORD}\b\.?\s*)?{_NUMBER}(?:\s*(?:/|of|0f|von|de|sur|out\sof)\s*[0-9OlIo]{{1,4}})?\s*[\-–—\])|~]*"
_ONLY_NUMBER = re.compile(_PAGENO, re.I)
_THEN = re.compile(rf"(?P<no>{_PAGENO})\s{{2,}}(?P<title>\S.*)", re.I)
_BEFORE = re.compile(rf"(?P<title>\S.*?)\s{{2,}}(?P<no>{_PAGENO})", re.I)
_SMALL = frozenset("and of the for to in et de la und der die y und des von du".split())
#: Lines at either end of a page that may be furniture, and their length at most (parameters of ``survey``).
EDGE, LONG_LINE = 2, 120

_GROUPS = (("rn", "m"), ("cl", "d"), ("ii", "u"), ("ri", "n"), ("vv", "w"))
_SIGNS = str.maketrans("i1|0596@", "lllosgga")
# the groups as they are once signs are letters: c1, ci and cl are one group
_LETTER_OF = {group.translate(_SIGNS): letter for group, letter in _GROUPS}
_GROUP_OF = {letter: group for group, letter in _LETTER_OF.items()}
_LETTERS = tuple(((group[0], group[1]), letter) for group, letter in _LETTER_OF.items())
# Letters that scanners read for each other.
_PAIRS = frozenset(frozenset(p) for p in "ce hb tf tl fl co eo un uv nu hn ao ae rn il ij lj gq oq ec bh kh sz vy ft".split())


def page_number(line: str) -> bool:
    s = line.strip()
    return 0 < len(s) <= 24 and bool(_ONLY_NUMBER.fullmatch(s)) and any(c.isalnum() for c in s)


def split_line(line: str) -> tuple[str, bool]:
    """Title part of an edge line, and whether the line holds a page number."""
    s = line.strip()
    if page_number(s):
        return "", True
    for pattern in (_THEN, _BEFORE):
        m = pattern.fullmatch(s)
        if m and title(m.group("title")):
            return m.group("title").strip(), True
    return s, False


def title(line: str) -> bool:
    """Whether a line looks like a title: two words or more, nearly all with a capital, no end of a sentence."""
    if not 6 <= len(line) <= 90 or line[-1] in ".,;:":
        return False
    words = [w for w in re.findall(r"[^\W_][\w@~.'’-]*", line) if w.lower() not in _SMALL]
    letters = [w for w in words if any(c.isalpha() for c in w)]
    if len(letters) < 2:
        return False
    large = sum(w[0].isupper() or w[0].isdigit() or w[0] in "@~" or w.isupper() for w in letters)
    return large >= len(letters) - (len(letters) > 4)


@lru_cache(maxsize=500_000)
def fold(word: str) -> str:
    """Word with signs that are read for letters made letters; the trie's search reads the groups."""
    return word.lower().translate(_SIGNS)


def header_keys(line: str) -> list[str]:
    """Keys of a title line of which two readings of one title share at least one."""
    s = re.sub(r"[^\w]", "", line.lower().translate(_SIGNS))
    s = s.replace("rn", "m").replace("cl", "d").translate(str.maketrans("bfeoq", "htccg"))
    third = max(4, len(s) // 3)
    return sorted({f"1{s[:third]}", f"2{s[third : 2 * third]}", f"3{s[-third:]}"})


class Trie:
    """Vocabulary by folded spelling, searched with a word's Levenshtein automaton.

    A group of two letters stands for its letter, in the word as in the trie, wherever the search comes upon it.
    """

    def __init__(self, words: Mapping[str, int]) -> None:
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in fold(word):
                node = node.setdefault(c, {})
            node.setdefault("", []).append(word)

    @staticmethod
    def _follow(node: dict | None, word: str, groups: list[str | None], i: int) -> list[str]:
        """Words below a node that read as the rest of ``word``; ``groups`` has the letter of the group that begins at each place."""
        found, n = [], len(word)
        branches = [(node, i)]
        while branches:
            node, i = branches.pop()
            while node is not None:
                if i == n:
                    found += node.get("", [])
                    break
                c = word[i]
                if groups[i] is not None and groups[i] in node:
                    branches.append((node[groups[i]], i + 2))
                if c in _GROUP_OF:
                    first, second = _GROUP_OF[c]
                    if first in node and second in node[first]:
                        branches.append((node[first][second], i + 1))
                node = node.get(c)
                i += 1
        return found

    def near(self, word: str) -> list[tuple[str, str, str]]:
        """(candidate, letter of the word, letter of the candidate) of all folded words within one edit."""
        found = []
        n = len(word)
        groups = [_LETTER_OF.get(word[i : i + 2]) for i in range(n)]
        places = [(self.root, 0)]
        for node, i in places:  # grows: all places that are reached without an edit
            heads = [(word[i], i + 1)] if i < n else []
            if i < n and groups[i] is not None:
                heads.append((groups[i], i + 2))
            below = [(c, child) for c, child in node.items() if c != ""]
            below += [(c, node[a][b]) for (a, b), c in _LETTERS if a in node and b in node[a]]
            for a, j in heads:
                found += [(w, a, "") for w in self._follow(node, word, groups, j)]
                if a in node:
                    places.append((node[a], j))
            for c, child in below:
                found += [(w, "", c) for w in self._follow(child, word, groups, i)]
                for a, j in heads:
                    if a != c:
                        found += [(w, a, c) for w in self._follow(child, word, groups, j)]
            if i < n and word[i] in _GROUP_OF:
                a, b = _GROUP_OF[word[i]]
                if a in node and b in node[a]:
                    places.append((node[a][b], i + 1))
            if i == n:
                found += [(w, "", "") for w in node.get("", [])]
        return found


def odd(word: str) -> bool:
    """Whether a word holds signs that are no letters of words."""
    return any(c.isdigit() or c in "@~" for c in word)


def _kind(word: str, cand: str, a: str, b: str) -> int | None:
    """0 where both read alike, 1 where they differ in letters read for each other, None where they differ else."""
    if cand == word or len(cand) < 2 or not cand[0].isalpha() or any(c.isdigit() for c in cand):
        return None
    if odd(word) and abs(len(cand) - len(word)) > 1:
        return None
    if not a and not b:
        return 0
    return 1 if "~" in (a, b) or (a and b and frozenset((a, b)) in _PAIRS) else None


def needed(word: str, count: int) -> int:
    """How often a candidate must occur for ``word``, which itself occurs ``count`` times."""
    if odd(word):
        return LEAST
    return (RATIO if len(word) > 3 else SHORT_RATIO) * max(count, 1)


class Reader:
    """Decides which words are misread, and what they were, from counts held in memory (small corpora, tests)."""

    def __init__(self, counts: Mapping[str, int]) -> None:
        self.counts = dict(counts)
        self.trie = Trie(self.counts)

    def misread(self, token: str) -> tuple[str, ...]:
        """Candidates of a body token, the likeliest first; empty where it is right or nothing is near."""
        word = token.lower()
        if not readable(word):
            return ()
        need, ranked = needed(word, self.counts.get(word, 0)), []
        for cand, a, b in self.trie.near(fold(word)):
            kind = _kind(word, cand, a, b)
            if kind is not None and self.counts[cand] >= need:
                ranked.append((kind, -self.counts[cand], cand))
        return tuple(dict.fromkeys(c for _, _, c in sorted(ranked)))  # by its best kind each


class Found(Reader):
    """Verdicts that are known already: misread words and their candidates."""

    def __init__(self, verdicts: Mapping[str, tuple[str, ...]]) -> None:
        self.verdicts = verdicts

    def misread(self, token: str) -> tuple[str, ...]:
        return self.verdicts.get(token.lower(), ())


def readable(word: str) -> bool:
    """Whether a word is long enough to be told from others."""
    return sum(c.isalpha() for c in word) >= 2 if odd(word) else len(word) > 2


def _parts(raw: str) -> tuple[tuple[int, int], ...]:
    """Parts [begin, end) of what stands between two blanks that may be misread words."""
    out = []
    for m in _TOKEN.finditer(raw):
        token = m.group()
        core = token.strip("-–—'’*_")
        if core.isalpha():
            places = [(m.start() + token.index(core), core)]
        elif "@" in core and re.search(r"@[\w\-]*\.\w|[.+_]\w*@", raw[m.start() : m.end() + 8]):
            continue  # an address
        else:
            places = [(m.start() + p.start(), p.group()) for p in re.finditer(r"[^\s\-–—'’_+=]+", token)]
        for at, part in places:
            if len(part) < 2 or not any(c.isalpha() for c in part):
                continue
            strange = odd(part)
            if not strange and not part.islower():
                continue  # names and headings
            if strange and (sum(c.isdigit() for c in part) > max(1, len(part) // 3) or part[0] == "@" or not (part[:-1].islower() or part[1:].islower() or part.islower())):
                continue  # numbers, codes, handles
            if readable(part.lower()):
                out.append((at, at + len(part)))
    return tuple(out)


class _Suspects(dict):
    """What stands between two blanks, to its words that are not settled as right; met once per worker."""

    def __init__(self, fine: frozenset[str]) -> None:
        super().__init__()
        self.fine = fine

    def __missing__(self, raw: str) -> tuple[str, ...]:
        if len(self) > 500_000:
            self.clear()
        words = (raw[a:b].lower() for a, b in _parts(raw))
        found = self[raw] = tuple(w for w in words if w not in self.fine)
        return found


_RUN = re.compile(r"\S+")


def misread_places(body: str, reader: Reader) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """Misread words of a body: (begin, end, candidates)."""
    for m in _RUN.finditer(body):
        for a, b in _parts(m.group()):
            found = reader.misread(m.group()[a:b])
            if found:
                yield m.start() + a, m.start() + b, found


def edge_lines(text: str, edge: int = EDGE) -> list[tuple[int, str]]:
    """(line number, line) of the first and last ``edge`` lines of a page that are not blank."""
    lines = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip()]
    return lines if len(lines) <= 2 * edge else lines[:edge] + lines[-edge:]


def furniture(text: str, headers: set[str] | None, whole: bool, edge: int = EDGE, long_line: int = LONG_LINE) -> tuple[set[int], bool, bool]:
    """Lines that are furniture, whether a header is among them, and whether a page number is.

    ``whole``: the text holds all pages of a document, joined by blank lines, and titles are compared
    within it; else ``headers`` has the keys of the titles that recur in the page's document.
    """
    lines = text.split("\n")
    if whole:
        edges, start = [], 0
        for i in [*(i for i, x in enumerate(lines) if not x.strip()), len(lines)]:
            block = range(start, i)
            start = i + 1
            edges += block if len(block) <= 2 * edge else [*block[:edge], *block[-edge:]]
    else:
        edges = [i for i, _ in edge_lines(text, edge)]
    parts = {i: split_line(lines[i]) for i in edges if len(lines[i]) <= long_line and lines[i].strip()}
    titles = {i: t for i, (t, _) in parts.items() if t and title(t)}
    if whole:
        held = Counter(k for i, t in titles.items() for k in set(header_keys(t)))
        headers = {k for k, n in held.items() if n > 1}
    out, is_header, is_number = set(), False, False
    for i, (_, number) in parts.items():
        if i in titles and headers and any(k in headers for k in header_keys(titles[i])):
            out.add(i)
            is_header = True
        elif number and titles.get(i):
            out.add(i)
        if number:
            out.add(i)
            is_number = True
    return out, is_header, is_number


def body_of(text: str, drop: set[int]) -> str:
    """The text without its furniture; blank lines beside removed lines at a page break go as well."""
    if not drop:
        return text
    out: list[str] = []
    lines = text.split("\n")
    skip = False
    for i, line in enumerate(lines):
        if i in drop:
            while out and not out[-1].strip() and out[-1:] and i - 1 not in drop and len(out) > 1 and not lines[i - 1].strip():
                out.pop()
            skip = True
            continue
        if skip and not line.strip():
            continue
        skip = False
        out.append(line)
    return "\n".join(out)


def join_broken(body: str) -> tuple[str, bool]:
    """The body with words broken at line ends joined, and whether there were any."""
    hits = 0

    def one(m: re.Match) -> str:
        nonlocal hits
        if not body[m.start() - 1 : m.start()].isalpha():
            return m.group()
        hits += 1
        return ""

    if "\n" not in body:
        return body, False
    body = _BROKEN_PAGE.sub(lambda m: m.group(1) + "\n" if body[m.start() - 1 : m.start()].isalpha() else m.group(), body)
    joined = _BROKEN.sub(one, body)
    return joined, hits > 0


def survey(text: str | None, headers: set[str] | None = None, whole: bool = True, edge: int = EDGE, long_line: int = LONG_LINE) -> tuple[list[str], str, str | None, bool]:
    """Kinds of noise but misread words, the body to read, a page's first word where it may be a half, and whether the end is a broken word."""
    if not text:
        return [], "", None, False
    text = normalise(text)[0]
    drop, is_header, is_number = furniture(text, headers, whole, edge, long_line) if "\n" in text or len(text) < 100 else (set(), False, False)
    body = body_of(text, drop)
    joined, broken = join_broken(body)
    ends = bool(_BREAK_END.search(body.rstrip("\n")))
    kinds = [k for k, held in (("header", is_header), ("hyphen", broken or ends), ("pageno", is_number)) if held]
    first = None
    if not whole:
        joined = _HALF_LAST.sub("", joined.rstrip())  # the half of a word broken at the page's end is no word
        m = _HALF_FIRST.match(joined)
        if m:
            first, joined = m.group().strip(), joined[m.end() :]
    return kinds, joined, first, ends


def noise(text: str | None, reader: Reader, headers: set[str] | None = None, whole: bool = True, after_break: bool = False) -> list[str]:
    """Kinds of noise in a text or page; ``after_break``: the page before ends in a broken word, whose other half begins this one."""
    kinds, body, first, _ = survey(text, headers, whole)
    if first and not after_break:
        body = first + " " + body
    return sorted([*kinds, "misread"]) if next(misread_places(body, reader), None) else kinds


def repair(text: str | None, reader: Reader, best: Mapping[tuple[str, str, str], str] | None = None, headers: set[str] | None = None, whole: bool = True) -> str | None:
    """Continuous paragraphs: furniture removed, words joined and corrected, lines reflowed.

    ``best`` has the candidate to take for a misread word between two neighbours, where there are several.
    """
    if not text:
        return text
    joined = body_to_read(text, headers, whole)
    out, last = [], 0
    for a, b, found in misread_places(joined, reader):
        word = found[0]
        if best and len(found) > 1:
            word = best.get((joined[a:b].lower(), *_beside(joined, a, b)), word)
        if joined[a].isupper():
            word = word.capitalize()
        out += [joined[last:a], word]
        last = b
    fixed = "".join([*out, joined[last:]])
    return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n[ \t]*\n\s*", fixed) if p.strip())


def body_to_read(text: str, headers: set[str] | None, whole: bool) -> str:
    text = normalise(text)[0]
    drop, _, _ = furniture(text, headers, whole)
    return join_broken(body_of(text, drop))[0]


def _beside(text: str, a: int, b: int) -> tuple[str, str]:
    """The words to the left and right of a place, small letters; empty where there is none."""
    left = re.search(r"([^\W\d_]+)\W*$", text[max(0, a - 40) : a])
    right = re.match(r"\W*([^\W\d_]+)", text[b : b + 40])
    return left.group(1).lower() if left else "", right.group(1).lower() if right else ""


def count_words(texts: Iterator[str | None]) -> Counter[str]:
    """Lower-case words of the texts after joining broken ones, and how often each occurs."""
    raw: Counter[str] = Counter()
    for text in texts:
        if text:
            raw.update((join_broken(text)[0] if "\n" in text else text).split())
    total: Counter[str] = Counter()
    for token, n in raw.items():  # taken apart once, however often it occurs
        for word in _PLAIN.findall(token.lower()):
            total[word] += n
    return total


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n): exact counts of all words of all texts, added up in the tasks before they are moved."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            total.update(count_words(batch.column(0).to_pylist()))
            if len(total) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), type=pa.int64())], names=["word", "n"])
                total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.string()), pa.array(list(total.values()), type=pa.int64())], names=["word", "n"])

    return texts.select(F.col(column).cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _heads(s: str, h: int) -> set[str]:
    """First ``h`` letters of all readings of a folded word (its groups as they are, or as their letters)."""
    if not h or not s:
        return {""}
    out = {s[0] + r for r in _heads(s[1:], h - 1)}
    return out | {_LETTER_OF[s[:2]] + r for r in _heads(s[2:], h - 1)} if s[:2] in _LETTER_OF else out


def _tails(s: str, h: int) -> set[str]:
    if not h or not s:
        return {""}
    out = {r + s[-1] for r in _tails(s[:-1], h - 1)}
    return out | {r + _LETTER_OF[s[-2:]] for r in _tails(s[:-2], h - 1)} if s[-2:] in _LETTER_OF else out


#: Letters of a word's beginning or end that name a shard, at most.
SHARD_LETTERS = 6


def shards(word: str) -> set[str]:
    """Shards of a word. Two words with readings one edit apart share at least one.

    Of two such readings the edit spares the first or the last half of the shorter one. All lengths that
    the word's readings and a partner may have are taken.
    """
    s = fold(word)
    least = len(s) // 2  # all groups read as letters
    halves = {max(1, min(m // 2, SHARD_LETTERS)) for m in range(max(1, least - 1 if any(g in s for g in _LETTER_OF) else len(s) - 1), len(s) + 1)}
    out = set()
    for h in halves:
        out |= {f"{h}<{x}" for x in _heads(s, h)} | {f"{h}>{x}" for x in _tails(s, h)}
    return out


def candidates(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, candidates) of those of (token, n) that are misread, by (word, n) of the whole corpus.

    Words and tokens of a shard come together sorted, the words first; the shard's trie is made of the
    words that occur often enough for any token, and each token's automaton is run through it.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for side, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = shards(word)
                for column, values in zip(out, (own, [side] * len(own), [word] * len(own), [n] * len(own))):
                    column.extend(values)
            types = [pa.string(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)], names=["shard", "side", "word", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, trie, most = None, {}, None, 0
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for shard, side, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != current:
                    current, held, trie, most = shard, {}, None, 0
                if not side:
                    held[word] = n
                    most = max(most, n)
                    continue
                need = needed(word, n)
                if not held or need > most:
                    continue
                trie = trie or Trie(held)
                for cand, a, b in trie.near(fold(word)):
                    kind = _kind(word, cand, a, b)
                    if kind is not None and held[cand] >= need:
                        for column, v in zip(out, (word, cand, kind, held[cand])):
                            column.append(v)
            types = [pa.string(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)], names=["token", "cand", "kind", "n"])

    words = counts.filter(F.col("n") >= min(LEAST, RATIO, SHORT_RATIO)).select(F.lit(0).alias("side"), "word", "n")
    both = words.unionByName(tokens.select(F.lit(1).alias("side"), F.col("token").alias("word"), "n"))
    placed = both.mapInArrow(place, "shard string, side int, word string, n long").repartition("shard").sortWithinPartitions("shard", "side")
    found = placed.mapInArrow(search, "token string, cand string, kind int, n long").groupBy("token", "cand").agg(F.min("kind").alias("kind"), F.max("n").alias("n"))
    ranked = F.sort_array(F.collect_list(F.struct("kind", (-F.col("n")).alias("less"), "cand")))  # as many as one edit has
    return found.groupBy("token").agg(F.transform(ranked, lambda r: r["cand"]).alias("candidates"))


def settled(counts: DataFrame, most: int = HEAD) -> frozenset[str]:
    """Those of the ``most`` most frequent words that are right."""
    head = checkpoint(counts.orderBy(F.desc("n"), "word").limit(most).select(F.col("word").alias("token"), "n"))
    wrong = candidates(head, counts).select("token")
    return frozenset(r[0] for r in head.join(wrong, "token", "left_anti").select("token").collect())  # at most ``most`` words


SURVEY = "kinds array<string>, tokens array<string>, first string, ends boolean"


def surveyed(rows: DataFrame, fine: frozenset[str], whole: bool) -> DataFrame:
    """(key, doc, page, kinds, tokens, first, ends) of rows (key, doc, page, text, headers); tokens are those not settled."""
    kinds = dict(rows.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspects = _Suspects(fine)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, headers in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                found, body, first, ends = survey(text, set(headers or ()), whole)
                tokens = {w for raw in set(body.split()) for w in suspects[raw]}
                begin = suspects[first] if first else ()
                for column, v in zip(out, (found, sorted(tokens), begin[0] if begin else None, ends)):
                    column.append(v)
            types = [pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, type=t) for c, t in zip(out, types))], names=["key", "doc", "page", "kinds", "tokens", "first", "ends"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("key", "doc", "page"))
    return rows.select("key", "doc", "page", "text", "headers").mapInArrow(work, f"{schema}, {SURVEY}")


def with_first(pages: DataFrame) -> DataFrame:
    """Surveyed pages with the first word among the tokens, unless the page before in the document ends in a broken word."""
    ends = pages.filter("doc is not null").groupBy("doc", "page").agg(F.max("ends").alias("ends"))
    before = ends.select(F.col("doc").alias("__d"), F.col("page").alias("__p"), F.lag("ends").over(Window.partitionBy("doc").orderBy("page")).alias("__after"))
    joined = pages.join(before, F.col("doc").eqNullSafe(F.col("__d")) & F.col("page").eqNullSafe(F.col("__p")), "left")
    own = F.when(F.col("first").isNotNull() & ~F.coalesce("__after", F.lit(False)), F.array("first")).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("tokens", F.concat("tokens", own)).drop("__d", "__p", "__after")


def verdicts(read: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, candidates) of the misread ones among the tokens of surveyed rows."""
    tokens = read.select(F.explode("tokens").alias("token")).distinct().join(counts.withColumnRenamed("word", "token"), "token", "left")
    return candidates(tokens.select("token", F.coalesce("n", F.lit(0)).alias("n")), counts)


def contexts(texts: DataFrame, whole: bool) -> DataFrame:
    """(key, token, left, right) of the misread words with several candidates in rows (key, text, headers, wrong)."""
    kind = dict(texts.dtypes)["key"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, text, headers, wrong in zip(*(c.to_pylist() for c in batch.columns)):
                reader = Found({w["token"]: tuple(w["candidates"]) for w in wrong or ()})
                body = body_to_read(text, set(headers or ()), whole)
                for a, b, found in misread_places(body, reader):
                    if len(found) > 1:
                        for column, v in zip(out, (key, body[a:b].lower(), *_beside(body, a, b))):
                            column.append(v)
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types)], names=["key", "token", "left", "right"])

    several = F.exists("wrong", lambda w: F.size(w["candidates"]) > 1)
    return texts.filter(several).select("key", "text", "headers", "wrong").mapInArrow(work, f"key {kind}, token string, left string, right string").distinct()


#: Bits of the filter that tells the tasks which words may be candidates; bounds what they are sent.
FILTER_BITS = 1 << 23


def _filter(words: DataFrame) -> np.ndarray:
    """Bits of the hashes of the words; at most ``FILTER_BITS`` / 64 numbers come to the driver."""
    h = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(FILTER_BITS))
    rows = words.select((h / 64).cast("long").alias("slot"), F.expr(f"shiftleft(1L, cast(pmod(crc32(cast(word as binary)), {FILTER_BITS}) % 64 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for r in rows:
        out[r["slot"]] = r["bits"]
    return out


def neighbours(texts: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """(a, b, n): how often each of the ``wanted`` pairs (a, b) of words stands side by side in all texts."""
    bits = _filter(wanted.select(F.explode(F.array("a", "b")).alias("word")).distinct())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[tuple[str, str]] = Counter()
        held: dict[str, bool] = {}

        def may(word: str) -> bool:
            if word not in held:
                if len(held) > 500_000:
                    held.clear()
                h = crc32(word.encode("utf-8", "surrogatepass")) % FILTER_BITS
                held[word] = bool(int(bits[h // 64]) >> (h % 64) & 1)
            return held[word]

        def flush() -> pa.RecordBatch:
            a, b = [k[0] for k in total], [k[1] for k in total]
            out = pa.RecordBatch.from_arrays([pa.array(a, type=pa.string()), pa.array(b, type=pa.string()), pa.array(list(total.values()), type=pa.int64())], names=["a", "b", "n"])
            total.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    run = _PLAIN.findall(join_broken(text)[0].lower())
                    ok = [may(w) for w in run]
                    total.update((run[i], run[i + 1]) for i in range(len(run) - 1) if ok[i] and ok[i + 1])
            if len(total) > 500_000:
                yield flush()
        yield flush()

    counts = texts.select(F.col(column).cast("string")).mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.join(wanted.select("a", "b").distinct(), ["a", "b"], "left_semi")


def likeliest(places: DataFrame, wrong: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """(key, token, left, right, word): of several candidates the one that stands most often beside these neighbours."""
    spots = places.select("token", "left", "right").distinct().join(wrong, "token").select("token", "left", "right", F.posexplode("candidates").alias("rank", "word"))
    pairs = spots.select(F.col("left").alias("a"), F.col("word").alias("b")).unionByName(spots.select(F.col("word").alias("a"), F.col("right").alias("b"))).filter("a <> '' and b <> ''")
    n = checkpoint(neighbours(texts, column, pairs))
    left = n.select(F.col("a").alias("left"), F.col("b").alias("word"), F.col("n").alias("n_left"))
    right = n.select(F.col("a").alias("word"), F.col("b").alias("right"), F.col("n").alias("n_right"))
    scored = spots.join(left, ["left", "word"], "left").join(right, ["word", "right"], "left").withColumn("n", F.coalesce("n_left", F.lit(0)) + F.coalesce("n_right", F.lit(0)))
    best = scored.groupBy("token", "left", "right").agg(F.max_by("word", F.struct("n", -F.col("rank"))).alias("word"))
    return places.join(best, ["token", "left", "right"])


def repaired(rows: DataFrame, whole: bool) -> DataFrame:
    """(key, text) of rows (key, text, headers, wrong, best): verdicts and chosen candidates of each text."""
    kind = dict(rows.dtypes)["key"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, headers, wrong, best in zip(*(c.to_pylist() for c in batch.columns[1:])):
                reader = Found({w["token"]: tuple(w["candidates"]) for w in wrong or ()})
                chosen = {(b["token"], b["left"], b["right"]): b["word"] for b in best or ()}
                out.append(repair(text, reader, chosen, set(headers or ()), whole))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.string())], names=["key", "text"])

    return rows.select("key", "text", "headers", "wrong", "best").mapInArrow(work, f"key {kind}, text string")


def running_headers(pages: DataFrame, doc: str, page: str, column: str) -> DataFrame:
    """(doc, headers): keys of the title lines that stand at the edge of two pages or more of a document."""
    rows = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(column).cast("string").alias("text")).filter("doc is not null and text <> ''")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, ids, keys = [], [], []
            for d, p, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = {k for _, line in edge_lines(text) for t in [split_line(line)[0]] if t and title(t) for k in header_keys(t)}
                docs += [d] * len(own)
                ids += [p] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(docs, type=pa.string()), pa.array(ids, type=pa.string()), pa.array(keys, type=pa.string())], names=["doc", "page", "key"])

    keys = rows.mapInArrow(keyed, "doc string, page string, key string")
    twice = keys.groupBy("doc", "key").agg(F.min("page").alias("a"), F.max("page").alias("b")).filter("a < b")
    return twice.groupBy("doc").agg(F.collect_set("key").alias("headers"))
