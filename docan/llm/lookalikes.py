"""One consistent form for text whose characters only look the same.

Script sets follow Unicode Technical Standard 39: a token's resolved script set is the intersection of
its characters' script sets; where it is empty, the token mixes scripts. A mixed token is spelled in
the script that can spell it whole, each foreign letter replaced by its look-alike; of several such
scripts the one with most of the token's letters wins, then the text's leading script, then Latin.
A token of one script all of whose letters look like Latin ones is a whole-script confusable. Such
words may be genuine (``он``, ``то``), so it is the text's script that says which spelling is consistent:
it is spelled in Latin letters where most of the text's letters are Latin and no word of the text is
surely of the other script (single Greek letters stay, as they are signs). All are counted.

Then compatibility variants of Latin letters, digits, hyphens and spaces take their plain form,
invisible characters go, and accents join their letters where a joint code exists. Line feeds and
everything else, such as full-width punctuation of Chinese text, stay as they are.

Defined results
* null text: null text and zero counts; empty text: empty;
* repeated rows: one result row each; ties between scripts: see above;
* very long texts: processed whole, in one pass;
* extra columns: dropped, only the key columns named come through; empty table: empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Look-alikes after the public confusables list of Unicode (capitals and small letters).
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜЬаеѕіјорсухһԁԛԝӏгпкмтнвьѵү"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTYXYGQWbaesijopcyxhdqwlrnkmtHBbvy"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγεικνορτυχωϲϳ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXayeikvoptuxwcj"
CHEROKEE = "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏎᏒᏔᏚᏙᏞᏟᏢᏦᏴ"
CHEROKEE_AS_LATIN = "DRTiAJEWMHGZ4RWSVLCPKB"
ARMENIAN = "ՍՕԼոսօհզցյ"
ARMENIAN_AS_LATIN = "UOLnuohqgj"
#: Characters that show nothing, besides those of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"
HYPHENS = "-‐"
#: Dashes that are variants of the hyphen though Unicode does not decompose them to it.
HYPHEN_VARIANTS = "‑﹣－"

_LATIN = regex.compile(r"\p{Script=Latin}")
_SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Thai", "Georgian", "Hangul", "Hiragana", "Katakana", "Bopomofo", "Han", "Cherokee")
#: Scripts written together count as one writing system.
_SYSTEMS = {"Han": {"Han", "Hanb", "Jpan", "Kore"}, "Hiragana": {"Hiragana", "Jpan"}, "Katakana": {"Katakana", "Jpan"}, "Hangul": {"Hangul", "Kore"}, "Bopomofo": {"Bopomofo", "Hanb"}}
_ALL = frozenset({"*"})
_TESTS = [(s, regex.compile(rf"\p{{scx={s}}}")) for s in _SCRIPTS]
_OPEN = regex.compile(r"\p{Script=Common}|\p{Script=Inherited}")


@lru_cache(maxsize=65536)
def scripts(char: str) -> frozenset[str]:
    """Script set of a character; the set of all scripts for common and inherited ones."""
    if _OPEN.match(char):
        return _ALL
    found: set[str] = set()
    for name, test in _TESTS:
        if test.match(char):
            found |= _SYSTEMS.get(name, {name})
    return frozenset(found or {"other"})


def resolved(token: str) -> frozenset[str]:
    """Resolved script set of a token: empty where it mixes scripts."""
    left = _ALL
    for char in token:
        own = scripts(char)
        if own is not _ALL and own != _ALL:
            left = own if left == _ALL else left & own
    return left


def _twins() -> dict[str, dict[str, str]]:
    """Letter to its look-alike, by script of the look-alike."""
    to: dict[str, dict[str, str]] = {"Latin": {}, "Cyrillic": {}, "Greek": {}}
    for name, own, latin in (("Cyrillic", CYRILLIC, CYRILLIC_AS_LATIN), ("Greek", GREEK, GREEK_AS_LATIN)):
        for a, b in zip(own, latin, strict=True):
            to["Latin"][a] = b
            to[name].setdefault(b, a)
    for own, latin in ((CHEROKEE, CHEROKEE_AS_LATIN), (ARMENIAN, ARMENIAN_AS_LATIN)):
        to["Latin"].update({a: b for a, b in zip(own, latin, strict=True) if b.isalpha()})
    for a, b in list(to["Cyrillic"].items()):
        if a in to["Greek"]:
            to["Greek"].setdefault(b, to["Greek"][a])
    for a, b in list(to["Greek"].items()):
        if len(a) == 1 and a in to["Cyrillic"] and _LATIN.match(a):
            to["Cyrillic"].setdefault(b, to["Cyrillic"][a])
    return to


TWINS = _twins()


def _plain() -> dict[str, str]:
    """Compatibility variants of Latin letters, digits, hyphens and spaces, and their plain form."""
    found = {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        flat = unicodedata.normalize("NFKC", char)
        if flat == char or unicodedata.category(char) in ("Cn", "Co", "Cs"):
            continue
        if all((c.isalpha() and _LATIN.match(c)) or c in "0123456789 " or c in HYPHENS for c in flat):
            found[char] = flat.replace("‐", "-")
    for char in HYPHEN_VARIANTS:
        found[char] = "-"
    for code in range(0x2000, 0x200B):
        found[chr(code)] = " "
    return found


PLAIN = _plain()


def _invisible() -> set[str]:
    chars = set(INVISIBLE)
    for code in range(0x80, sys.maxunicode + 1):
        if unicodedata.category(chr(code)) == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            chars.add(chr(code))
    # signs that show or have a meaning of their own in Arabic and Syriac
    return chars - {chr(c) for c in (*range(0x600, 0x606), 0x6DD, 0x70F, 0x8E2)}


UNSEEN = _invisible()
_DROP = dict.fromkeys(map(ord, UNSEEN))
_FLAT = {ord(k): v for k, v in PLAIN.items()}


def _class(chars: set[str]) -> str:
    codes = sorted(map(ord, chars))
    parts, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        parts.append(f"\\U{codes[i]:08x}" + (f"-\\U{codes[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(parts)


# characters of which a text alone has nothing to be made consistent: ASCII, joint letters and signs of
# Latin-1 that are no variants, common punctuation, Chinese
_SAFE = "".join(chr(c) for c in range(0xA1, 0x100) if unicodedata.normalize("NFKC", chr(c)) == chr(c) and c != 0xAD) + "‘’“”„–—•€、。，"
_ANYTHING = re.compile(f"[^\x00-\x7f{re.escape(_SAFE)}\u4e00-\u9fff]")
_VARIANT = regex.compile(f"[{_class(set(PLAIN))}]")
_UNSEEN = regex.compile(f"[{_class(UNSEEN)}]")
_APART = regex.compile(r"[^\p{M}]\p{M}+")
_OTHER = regex.compile(r"[\p{Script=Greek}\p{Script=Cyrillic}\p{Script=Cherokee}\p{Script=Armenian}]")
_GREEK = regex.compile(r"\p{Script=Greek}")
_TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_MIXABLE = frozenset({"Latin", "Greek", "Cyrillic"})
_ALL_MIXABLE = _MIXABLE | {"Cherokee", "Armenian"}


def _spell(token: str, lead: str) -> str | None:
    """``token`` in the script that can spell it whole, or None where none can."""
    letters = Counter()
    for char in token:
        own = scripts(char)
        if own != _ALL:
            letters.update(own & _MIXABLE)
    best = None
    letters.setdefault("Latin", 0)
    for script in sorted(letters, key=lambda s: (-letters[s], s != lead, s != "Latin", s)):
        twins, out = TWINS[script], []
        for char in token:
            own = scripts(char)
            if own == _ALL or script in own:
                out.append(char)
            elif char in twins:
                out.append(twins[char])
            else:
                break
        else:
            best = "".join(out)
            break
    return best


def _scripts_of(token: str) -> set[str]:
    """Scripts of a token's letters, as far as they have look-alikes of Latin ones."""
    kinds: set[str] = set()
    for char in token:
        own = scripts(char)
        if own != _ALL:
            kinds |= own & _ALL_MIXABLE
    return kinds


def _as_latin(token: str) -> str | None:
    """``token`` in Latin letters, where all its letters look like such."""
    twins = TWINS["Latin"]
    return "".join(twins.get(c, c) for c in token) if all(c in twins or scripts(c) == _ALL for c in token) else None


def normalise(text: str | None) -> tuple[str | None, int, int, int, int, int, int]:
    """Consistent form and the counts of variants, accents apart, invisible characters, mixed words (Latin with Greek or Cyrillic), whole-script confusables and words mixed with other scripts."""
    if not text or text.isascii() or not _ANYTHING.search(text):
        return text, 0, 0, 0, 0, 0, 0
    unseen = len(_UNSEEN.findall(text))
    if unseen:
        text = text.translate(_DROP)
    variants = len(_VARIANT.findall(text))
    if variants:
        text = text.translate(_FLAT)
    apart = 0
    if not unicodedata.is_normalized("NFC", text):
        for match in _APART.findall(text):
            apart += len(unicodedata.normalize("NFC", match)) < len(match)
        text = unicodedata.normalize("NFC", text)
    mixed = whole = other = 0
    if _OTHER.search(text):
        latin = len(_LATIN.findall(text))
        lead = "Latin" if 2 * latin >= sum(c.isalpha() for c in text) else "Cyrillic"
        changes: list[tuple[int, int, str]] = []
        alike: list[tuple[int, int, str, set[str]]] = []
        genuine: set[str] = set()
        for match in _TOKEN.finditer(text):
            token = match.group()
            if not _OTHER.search(token):
                continue
            kinds = _scripts_of(token)
            if "Latin" in kinds and len(kinds) > 1 and not resolved(token):
                if kinds <= _MIXABLE:
                    mixed += 1
                else:
                    other += 1
                spelled = _spell(token, lead)
                if spelled is not None:
                    changes.append((match.start(), match.end(), spelled))
                continue
            spelled = _as_latin(token)
            if spelled is None:
                genuine |= kinds
            elif lead == "Latin":
                whole += 1
                if len(token) > 1 or not _GREEK.match(token):
                    alike.append((match.start(), match.end(), spelled, kinds))
        changes += [(a, b, spelled) for a, b, spelled, kinds in alike if not kinds & genuine]
        out, at = [], 0
        for a, b, spelled in sorted(changes):
            out += [text[at:a], spelled]
            at = b
        if out:
            text = "".join([*out, text[at:]])
    return text, variants, apart, unseen, mixed, whole, other


COUNTS = ("variants", "accents_apart", "invisible", "mixed_words", "whole_script", "mixed_other")


def consistent(records: DataFrame, keys: Sequence[str], text_column: str, with_text: bool = True) -> DataFrame:
    """Key columns, the consistent ``text`` (unless not wanted) and the counts of what was met."""
    picked = records.select(*(F.col(k) for k in keys), F.col(text_column).cast("string").alias("__text"))
    kinds = dict(picked.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [normalise(t) for t in batch.column(len(keys)).to_pylist()]
            columns = list(zip(*results)) if results else [()] * 7
            arrays = list(batch.columns[: len(keys)]) + ([pa.array(columns[0], type=pa.string())] if with_text else [])
            arrays += [pa.array(c, type=pa.int32()) for c in columns[1:]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *(["text"] if with_text else []), *COUNTS])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(["text string"] if with_text else []), *(f"{c} int" for c in COUNTS)])
    return picked.mapInArrow(run, schema)
