"""Language of texts and of their segments by nearest centroid.

A text is put into consistent form (look-alike characters, see ``lookalikes``), folded (case, accents)
and cut at sentence ends and separators. Every segment of at least ``MIN_WORDS`` words becomes a
TF-IDF vector of its words and character n-grams (one to three characters), of length one, and is compared by
cosine with several centroids per language, found by clustering that language's samples. The language
of the nearest centroid is taken unless the segment is too far from all of them (rejection by
distance). Neighbouring segments of one language are one segment of the result.

The classifier is fitted on at most ``MAX_SAMPLES`` labelled samples, chosen by the hash of their text;
this bounds what the driver holds and sends to the tasks: languages x CLUSTERS x DIMENSIONS floats.

Defined results
* null or empty text, or a text without letters: no language, no segment;
* no segment of enough words (names, references, stock phrases): no segment, but a ``guess`` from the
  whole text, whose confidence is halved; it never makes a case;
* positions of segments are those of the stored text, whatever its consistent form changes;
* labels: null, blank and names of no language (``und``, ``unknown``, ``xx`` ...) are missing labels;
  codes of two or three letters, regional codes and English or own names are one notation or another
  of a language;
* repeated rows: classified once each, the same every time; ties: the first language by code;
* very long texts: processed whole, segment by segment;
* empty tables: empty result; an empty sample table: every segment is rejected;
* extra columns: dropped, only the key columns named come through.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docan.llm.lookalikes import normalise

DIMENSIONS = 1 << 16
CLUSTERS = 3
MAX_SAMPLES = 20_000
MIN_WORDS = 4
MIN_HAN = 6
#: Cosine to the nearest centroid below which a segment is of no known language.
MIN_COSINE = 0.12
#: Segments vectorised at once; bounds a task's memory.
BATCH_CHARS = 200_000

# Notations of languages (ISO 639, English and own names).
NAMES = {
    "en": "eng english englisch anglais inglés",
    "de": "deu ger german deutsch allemand alemán",
    "fr": "fra fre french français francais französisch francés",
    "es": "spa spanish español espanol spanisch espagnol castellano castilian",
    "it": "ita italian italiano italienisch",
    "pt": "por portuguese português portugues portugiesisch",
    "nl": "nld dut dutch nederlands flemish niederländisch",
    "ru": "rus russian русский russisch",
    "zh": "zho chi chinese mandarin cmn 中文 chinesisch",
}
NO_LANGUAGE = {"", "und", "unknown", "xx", "xxx", "mul", "mis", "zxx", "none", "null", "n/a", "na", "?", "-", "undefined", "other"}
_BY_NAME = {n: code for code, names in NAMES.items() for n in [code, *names.split()]}
_WORD = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_CLUSTER = regex.compile(r"\P{M}\p{M}*|\p{M}+")
_CUT = re.compile(r"(?<=[.!?…;:])(?=\s)|(?<=[。！？；])|\n+|\s[/|•·–—-]+\s|\t+|\s{2,}")


def label_language(label: str | None) -> str | None:
    """Two-letter code of a label in any notation; None where it names no language."""
    if label is None:
        return None
    low = label.strip().lower()
    if low in NO_LANGUAGE:
        return None
    if low in _BY_NAME:
        return _BY_NAME[low]
    base = re.split(r"[-_ (]", low)[0]
    if base in NO_LANGUAGE:
        return None
    if base in _BY_NAME:
        return _BY_NAME[base]
    return base if re.fullmatch(r"[a-z]{2,3}", base) else None


def fold(text: str) -> str:
    """Small letters without accents."""
    flat = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in flat if not unicodedata.combining(c))


def cut(text: str | None) -> list[tuple[int, int]]:
    """Segments [begin, end) of a text that hold enough words to be a sentence."""
    if not text:
        return []
    edges = [0]
    for m in _CUT.finditer(text):
        edges += [m.start(), m.end()]
    edges.append(len(text))
    found = []
    for a, b in zip(edges[::2], edges[1::2]):
        part = text[a:b]
        if len(_WORD.findall(part)) >= MIN_WORDS or len(_HAN.findall(part)) >= MIN_HAN:
            found.append((a, b))
    return found


class _Words(dict):
    """Word to its spelling without accents and the numbers of its features; met once per worker."""

    def __missing__(self, word: str) -> tuple[str, tuple[int, ...]]:
        if len(self) > 300_000:
            self.clear()
        plain = fold(word)
        own = (crc32(plain.encode("utf-8", "surrogatepass")) % DIMENSIONS,)
        if plain != word:
            own += (crc32(b"'" + word.encode("utf-8", "surrogatepass")) % DIMENSIONS,)
        hit = self[word] = (plain, own)
        return hit


_FEATURES = _Words()


def _grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature number) of the folded texts' character n-grams and of the words, with and without accents.

    Digits and marks count as blanks.
    """
    who, what, runs, flat, sizes = [], [], [], [], []
    for text in texts:
        words = [_FEATURES[w] for w in _WORD.findall(text.lower())]
        runs.append(" " + " ".join(w[0] for w in words) + " \0")
        own = [f for w in words for f in w[1]]
        flat += own
        sizes.append(len(own))
    what.append(np.array(flat, dtype=np.int64))
    who.append(np.repeat(np.arange(len(texts)), sizes))
    codes = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    bounds = codes == 0
    owner = np.cumsum(bounds) - bounds
    value = np.zeros(len(codes), dtype=np.uint64)
    clean = ~bounds
    for n in range(1, 4):
        size = len(codes) - n + 1
        if size <= 0:
            break
        value = value[:size] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
        clean = clean[:size] & ~bounds[n - 1 :]
        mixed = value ^ (value >> np.uint64(29))
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        what.append(((mixed >> np.uint64(40)) % np.uint64(DIMENSIONS))[clean].astype(np.int64))
        who.append(owner[:size][clean])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(who + none), np.concatenate(what + none)


def _weights(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram number, 1 + log of its count), sorted by text."""
    who, what = _grams(texts)
    pair, count = np.unique(who * DIMENSIONS + what, return_counts=True)
    return pair // DIMENSIONS, pair % DIMENSIONS, 1 + np.log(count)


class _Vectors:
    """Sparse vectors of length one, one for each text."""

    def __init__(self, count: int, who: np.ndarray, what: np.ndarray, weight: np.ndarray) -> None:
        norm = np.sqrt(np.bincount(who, weights=weight * weight, minlength=count))
        self.count, self.who, self.what = count, who, what
        self.weight = (weight / np.maximum(norm, 1e-9)[who]).astype(np.float32)

    def __getitem__(self, rows: np.ndarray) -> _Vectors:
        new = np.full(self.count, -1)
        new[rows] = np.arange(len(rows))
        own = new[self.who] >= 0
        return _Vectors(len(rows), new[self.who[own]], self.what[own], self.weight[own])

    def dot(self, table: np.ndarray) -> np.ndarray:
        """Products with the columns of a dense table (feature, column)."""
        out = np.zeros((self.count, table.shape[1]), dtype=np.float32)
        start = np.flatnonzero(np.diff(self.who, prepend=-1))
        for a in range(0, len(start), 256):
            lo, hi = start[a], start[a + 256] if a + 256 < len(start) else len(self.who)
            out[self.who[start[a : a + 256]]] = np.add.reduceat(table[self.what[lo:hi]] * self.weight[lo:hi, None], start[a : a + 256] - lo, axis=0)
        return out

    def sums(self, group: np.ndarray, groups: int) -> np.ndarray:
        """Sum of the vectors of each group, as dense rows of length one; zero for none."""
        flat = np.bincount(group[self.who] * DIMENSIONS + self.what, weights=self.weight, minlength=groups * DIMENSIONS)
        rows = flat.reshape(groups, DIMENSIONS).astype(np.float32)
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)

    def row(self, k: int) -> np.ndarray:
        out = np.zeros(DIMENSIONS, dtype=np.float32)
        out[self.what[self.who == k]] = self.weight[self.who == k]
        return out


class Centroids:
    """Languages, their centroids (rows of length one) and the inverse document frequencies."""

    def __init__(self, samples: Sequence[tuple[str, str]], clusters: int = CLUSTERS) -> None:
        texts, labels = [], []
        for language, text in sorted(samples):
            whole = normalise(text)[0]
            texts.append(whole)
            labels.append(language)
        who, what, weight = _weights(texts)
        # the languages are the documents of the inverse document frequency: what all of them use tells nothing
        names = sorted(set(labels))
        code = np.array([names.index(x) for x in labels], dtype=np.int64)
        held = np.bincount(np.unique(code[who] * DIMENSIONS + what) % DIMENSIONS, minlength=DIMENSIONS) if len(names) else np.zeros(DIMENSIONS)
        self.idf = np.log((0.5 + len(names)) / np.maximum(held, 1))
        rows = _Vectors(len(texts), who, what, weight * self.idf[what])
        self.idf = self.idf.astype(np.float32)
        self.languages: list[str] = []
        parts = []
        for language in sorted(set(labels)):
            own = rows[np.array([i for i, x in enumerate(labels) if x == language])]
            for centre in _cluster(own, clusters):
                self.languages.append(language)
                parts.append(centre)
        self.table = np.array(parts, dtype=np.float32).reshape(-1, DIMENSIONS).T.copy()

    def nearest(self, texts: Sequence[str], least: float = MIN_COSINE) -> list[tuple[str | None, float]]:
        """Language and confidence of each text; language None where all centroids are farther than ``least``.

        The confidence is the cosine's share against that of the nearest other language.
        """
        if not texts or not self.languages:
            return [(None, 0.0)] * len(texts)
        who, what, weight = _weights(texts)
        score = _Vectors(len(texts), who, what, weight * self.idf[what]).dot(self.table)
        names = sorted(set(self.languages))
        by = np.stack([score[:, [i for i, x in enumerate(self.languages) if x == n]].max(axis=1) for n in names], axis=1)
        best = by.argmax(axis=1)
        top = by[np.arange(len(texts)), best].astype(float)
        by[np.arange(len(texts)), best] = 0
        second = by.max(axis=1).astype(float)
        return [(names[b], round(t / (t + max(u, 0.0)), 4)) if t >= least and t > 0 else (None, 0.0) for b, t, u in zip(best.tolist(), top.tolist(), second.tolist())]


def _cluster(rows: _Vectors, clusters: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from far-apart beginnings; centroids of length one."""
    centres = rows.row(0)[None]
    near = rows.dot(centres.T)[:, 0]
    while len(centres) < min(clusters, rows.count):
        centres = np.vstack([centres, rows.row(int(near.argmin()))])
        near = np.maximum(near, rows.dot(centres[-1:].T)[:, 0])
    for _ in range(rounds):
        own = rows.dot(centres.T).argmax(axis=1)
        held = np.bincount(own, minlength=len(centres)) > 0
        centres = np.where(held[:, None], rows.sums(own, len(centres)), centres)
    return centres


def fit(samples: DataFrame, language_column: str = "language", text_column: str = "text") -> Centroids:
    """Centroids from labelled samples, of which at most ``MAX_SAMPLES`` are taken, by the hash of their text."""
    rows = samples.select(F.col(language_column).alias("language"), F.col(text_column).alias("text")).filter("language is not null and text <> ''")
    if rows.count() > MAX_SAMPLES:
        rows = rows.orderBy(F.xxhash64("text"), "language").limit(MAX_SAMPLES)
    return Centroids([(label_language(r["language"]) or r["language"], r["text"]) for r in rows.collect()])


class _Verdicts(dict):
    """Segments that were classed in this worker; those that recur are not classed again."""

    def __init__(self, model: Centroids) -> None:
        super().__init__()
        self.model, self.size = model, 0

    def fill(self, parts: Sequence[str]) -> None:
        new = list(dict.fromkeys(p for p in parts if p not in self))
        if self.size > 20_000_000:
            self.clear()
            self.size, new = 0, list(dict.fromkeys(parts))
        self.size += sum(map(len, new))
        self.update(zip(new, self.model.nearest(new)))


def _lengths(text: str, plain: str) -> list[int] | None:
    """Place in ``text`` of every character of its consistent form and of its end; None where they are the same."""
    if len(text) == len(plain):
        return None
    at: list[int] = []
    for m in _CLUSTER.finditer(text):
        at += [m.start()] * len(normalise(m.group())[0])
    if len(at) != len(plain):  # parts that join across clusters: the nearest place
        at = [min(i, len(text)) for i in range(len(plain))]
    return [*at, len(text)]


def segments(records: DataFrame, keys: Sequence[str], text_column: str, model: Centroids, label_column: str | None = None) -> DataFrame:
    """Key columns, ``declared`` (the language that the label names), ``segments``: array of (begin, end, language, confidence), and ``guess``."""
    label = F.col(label_column).cast("string") if label_column else F.lit(None).cast("string")
    picked = records.select(*(F.col(k) for k in keys), F.col(text_column).cast("string").alias("__text"), label.alias("__label"))
    kinds = dict(picked.dtypes)
    shape = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("language", pa.string()), ("confidence", pa.float64())]))
    pair = pa.struct([("language", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Verdicts(model)
        for batch in batches:
            out, guesses, waiting, size = [], [], [], 0

            def flush() -> None:
                known.fill([plain[a:b] for _, plain, spans in waiting for a, b in spans])
                found = []
                for text, plain, spans in waiting:
                    at = _lengths(text, plain) if spans else None
                    place = (lambda i: i) if at is None else at.__getitem__
                    found.append(_join([(place(a), place(b), *known[plain[a:b]]) for a, b in spans]))
                short = [plain for (_, plain, _), f in zip(waiting, found) if not f and _WORD.search(plain)]
                guess = iter(model.nearest(short, 0.0))
                for (_, plain, _), f in zip(waiting, found):
                    language, confidence = next(guess) if not f and _WORD.search(plain) else (None, 0.0)
                    guesses.append({"language": language, "confidence": round(confidence / 2, 4)} if language else None)
                out.extend(found)
                waiting.clear()

            for text in batch.column(len(keys)).to_pylist():
                plain = normalise(text)[0] or ""
                waiting.append((text or "", plain, cut(plain)))
                size += len(plain)
                if size > BATCH_CHARS:
                    flush()
                    size = 0
            flush()
            declared = pa.array([label_language(x) for x in batch.column(len(keys) + 1).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], declared, pa.array(out, type=shape), pa.array(guesses, type=pair)], names=[*keys, "declared", "segments", "guess"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "declared string, segments array<struct<begin: int, end: int, language: string, confidence: double>>, guess struct<language: string, confidence: double>"])
    return picked.mapInArrow(run, schema)


def _join(parts: list[tuple[int, int, str | None, float]]) -> list[dict]:
    """Neighbouring segments of one language as one, its confidence weighted by length."""
    out: list[dict] = []
    for a, b, language, confidence in parts:
        if language is None:
            continue
        if out and out[-1]["language"] == language:
            last = out[-1]
            n, m = last["n"], b - a
            last["confidence"] = (last["confidence"] * n + confidence * m) / (n + m)
            last["end"], last["n"] = b, n + m
        else:
            out.append({"begin": a, "end": b, "language": language, "confidence": confidence, "n": b - a})
    return [{"begin": o["begin"], "end": o["end"], "language": o["language"], "confidence": round(o["confidence"], 4)} for o in out]


def verdicts(records: DataFrame, keys: Sequence[str], label_column: str, text_column: str, model: Centroids) -> DataFrame:
    """Keys, declared language, segments, languages, guess, and the kind: ``missing``, ``wrong``, ``mixed``, ``right`` or ``no sentence``.

    ``mixed`` goes before ``missing``. Repeated rows come out as often as they are stored.
    """
    rows = records.select(*keys, F.col(label_column).alias("__name"), F.col(text_column).alias("__source"))
    languages = F.array_sort(F.array_distinct(F.transform("segments", lambda s: s["language"])))
    out = segments(rows, keys, "__source", model, "__name").withColumn("languages", languages)
    kind = (
        F.when(F.size("languages") == 0, "no sentence")
        .when(F.size("languages") > 1, "mixed")
        .when(F.col("declared").isNull(), "missing")
        .when(F.col("declared") != F.col("languages")[0], "wrong")
        .otherwise("right")
    )
    return out.withColumn("kind", kind).select(*keys, "declared", "kind", "languages", "segments", "guess")
