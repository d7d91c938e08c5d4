"""Variant spellings of names of persons and organisations, linked to entities.

Distinct values are parsed (titles, order, initials, particles, legal forms, trade words), their tokens
coded by sound, and blocked by those codes: by the first letter of the given name with the family
name's code and all its forms with one symbol less (so that codes one edit apart meet; firms: the trade with the distinctive part's), and by the
family name's code with the given name's code less its first symbol. Pairs of a block are compared by
Jaro-Winkler and edit distance of the folded tokens and by the table of nicknames; accepted pairs are
clustered by connected components.

Values that could mean several entities (initials only, nicknames of several names) never join two
clusters: each goes to the one cluster that fits it, to none where several do.

Defined results
* null or blank text, placeholders, values without two parts: not linked;
* null entity type: skipped; types other than those asked for: skipped;
* repeated rows: values are made distinct first;
* ties between clusters: the value stays unlinked; very long texts: parsed whole;
* empty table: empty result; other columns are never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docan.llm.components import components
from docan.session import checkpoint

# Common short forms of given names.
NICKNAMES = {
    "abigail": "abby abbie gail", "albert": "bert al", "alexander": "alex sasha sandy alec xander", "alexandra": "alex sasha sandra", "andrew": "andy drew",
    "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny benji", "catherine": "cathy cate", "charles": "charlie chuck", "christine": "chris tina chrissy",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "donald": "don donny", "dorothy": "dot dolly dottie",
    "edward": "ed eddie ted ned", "eleanor": "nell ellie nora", "elizabeth": "liz beth betty eliza lizzie ellie", "esther": "essie hettie", "frances": "fran fanny frankie", "francis": "frank fran",
    "frederick": "fred freddie", "gabriel": "gabe", "gerald": "gerry jerry", "gregory": "greg", "harold": "hal harry", "helen": "nell", "henry": "hank harry hal",
    "isabella": "bella izzy isa", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jenny jen", "jessica": "jess jessie", "john": "jack johnny", "jonathan": "jon jonny",
    "joseph": "joe joey", "joshua": "josh", "judith": "judy jude", "katherine": "kate kathy katie kitty", "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len lenny leo",
    "margaret": "meg peggy maggie marge greta", "matthew": "matt matty", "michael": "mike mick mickey", "nathaniel": "nate nat", "nicholas": "nick nicky", "pamela": "pam",
    "patricia": "pat trish patty tricia", "patrick": "pat paddy", "peter": "pete", "philip": "phil pip", "rebecca": "becky becca", "richard": "dick rick rich ricky", "robert": "bob rob bobby robbie bert",
    "ronald": "ron ronnie", "samuel": "sam sammy", "samantha": "sam", "sarah": "sally sadie", "stephen": "steve stevie", "steven": "steve", "susan": "sue susie suzy", "theodore": "ted theo teddy",
    "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky tori vic", "virginia": "ginny ginger", "walter": "walt wally", "william": "bill will billy willy", "zachary": "zach zack",
}
# Further common given names.
GIVEN = "agnes boris clara conrad dieter fiona greta hugo ingrid ivan karin lucia marta nadia olga oscar paula quentin rosa simon ursula vera yvonne anna maria jan lars erik hans carlos luis pierre paul mark george emma julia laura martin stefan victor".split()
TITLES = frozenset("mr mrs ms miss dr prof professor capt captain sir dame rev hon herr frau mme mlle jr sr ii iii esq phd md sra srta señor señora don doña".split())
PARTICLES = frozenset("van von de der den di da del la le du ter zu zum".split())
LEGAL = {
    "incorporated": "inc", "inc": "inc", "corporation": "corp", "corp": "corp", "company": "co", "co": "co", "limited": "ltd", "ltd": "ltd", "brothers": "bros", "bros": "bros", "holdings": "hldgs", "hldgs": "hldgs",
    "international": "intl", "intl": "intl", "sons": "sons", "gmbh": "gmbh", "mbh": "gmbh", "gesellschaft": "gmbh", "ag": "ag", "sa": "sa", "plc": "plc", "llc": "llc", "llp": "llp", "group": "group", "partners": "partners",
}
# Common words for trades in the names of firms.
TRADES = (
    "apothecaries bakeries brewing breweries cables carriers ceramics chemicals coatings construction dairies drydocks electronics engineering farms fisheries foods forestry foundry freight furniture glassworks hotels instruments "
    "insurance ironworks locksmiths logistics machinery mills mining motors optics orchards packaging papermills pharmaceuticals plastics printing publishing quarries railways refineries shipping shipyards software steelworks "
    "surveyors tanneries textiles timber tools trading transport turbines vineyards warehousing wines woodworks"
).split()
PLACEHOLDERS = frozenset("unknown|see cover sheet|as above|illegible|n/a|na|none|tbd|to be determined|not stated|not available|anonymous|redacted|same as above|ditto|various|xxx|unbekannt|inconnu|desconocido|see above|no name|not applicable".split("|"))
NOT_NAMES = frozenset("see as above not the of cover sheet page unknown illegible none same".split())

#: Symbols beyond which a code is blocked by its halves.
LONG_CODE = 24

_TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*\.?")
_OCR = str.maketrans("015", "ols")


def plain(token: str) -> str:
    """Small letters without accents and marks, digits read as letters."""
    flat = unicodedata.normalize("NFKD", token.lower().replace("ß", "ss"))
    return re.sub(r"[^a-zа-яα-ω一-鿿]", "", "".join(c for c in flat if not unicodedata.combining(c)).translate(_OCR))


@lru_cache(maxsize=200_000)
def fold(token: str) -> str:
    """Spelling reduced to its sound and shape: letters that are written for each other become one."""
    s = plain(token)
    for a, b in (("rn", "m"), ("ph", "f"), ("ck", "k"), ("w", "v"), ("y", "i"), ("q", "k"), ("x", "ks")):
        s = s.replace(a, b)
    return s


@lru_cache(maxsize=200_000)
def single(folded: str) -> str:
    """Without doubled letters."""
    return re.sub(r"(.)\1+", r"\1", folded)


@lru_cache(maxsize=200_000)
def sound(token: str) -> str:
    """Phonetic code: first letter and the consonants after it, with like sounds as one."""
    s = single(fold(token))
    if not s:
        return ""
    body = re.sub(r"[aeiouh]", "", s[1:])
    code = (s[0] if s[0] not in "aeiou" else "a") + body
    return re.sub(r"(.)\1+", r"\1", code.translate(str.maketrans("czdgj", "kstkk")))


def _canonical() -> dict[str, frozenset[str]]:
    names: dict[str, set[str]] = {}
    for formal, short in NICKNAMES.items():
        names.setdefault(fold(formal), set()).add(formal)
        for nick in short.split():
            names.setdefault(fold(nick), set()).add(formal)
    for given in GIVEN:
        names.setdefault(fold(given), set()).add(given)
    for formal in (*NICKNAMES, *GIVEN):  # a formal name means itself only
        names[fold(formal)] = {formal}
    return {k: frozenset(v) for k, v in names.items()}


CANONICAL = _canonical()
_TRADES = {fold(t): t for t in TRADES}


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    if not first:
        return 0.0
    second = [b[j] for j in range(len(b)) if used[j]]
    m, swaps = len(first), sum(x != y for x, y in zip(first, second)) / 2
    score = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        start += 1
    return score + start * 0.1 * (1 - score)


def within_one(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or swap of neighbours turns a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    return max(len(x), len(y)) <= 1 or len(x) == len(y) == 2 and x == y[::-1]


def alike(a: str, b: str, least: float = 0.9) -> bool:
    """Folded tokens that are spellings of one: one edit apart, or sounding the same; Jaro-Winkler at least ``least``."""
    if a == b or single(a) == single(b):
        return True
    return jaro_winkler(a, b) >= least and (within_one(a, b) or within_one(single(a), single(b)) or sound(a) == sound(b))


def _blank(text: str) -> bool:
    low = re.sub(r"[\[\]().]", "", text.strip().lower()).strip()
    return not low or low in PLACEHOLDERS


def parse_person(text: str | None) -> tuple[str, str, str, bool] | None:
    """(family, given or initial, middle initial, given is an initial); None where it is no name of a person."""
    if text is None or _blank(text):
        return None
    head, comma, tail = text.partition(",")
    parts = [_TOKEN.findall(head), _TOKEN.findall(tail) if comma else []]
    tokens: list[tuple[str, bool]] = []  # folded or initial, and whether it is an initial
    family_first = bool(comma)
    for side, found in enumerate(parts):
        for raw in found:
            bare = raw.rstrip(".")
            low = plain(bare)
            if not low or low in PARTICLES or (low in TITLES and (raw.endswith(".") or len(low) > 1)):
                continue
            if low in NOT_NAMES:
                return None
            if len(low) == 1:
                tokens.append((low, True, side))
            else:
                tokens.append((fold(bare), False, side))
    names = [t for t in tokens if not t[1]]
    initials = [t[0] for t in tokens if t[1]]
    if not names:
        return None
    if family_first and any(t[2] == 0 for t in names):
        family = max((t[0] for t in names if t[2] == 0), key=len)
        given = [t[0] for t in names if t[2] == 1]
    elif len(names) == 1:
        family, given = names[0][0], []
    else:
        order = [t[0] for t in names]
        if order[-1] in CANONICAL and order[0] not in CANONICAL:
            family, given = order[0], order[1:][::-1][:1]
        elif order[0] in CANONICAL and order[-1] not in CANONICAL:
            family, given = order[-1], order[:1]
        else:
            family = max(order, key=len)
            given = [t for t in order if t != family][:1] or order[:1]
    if given:
        return family, given[0], initials[0] if initials else "", False
    if initials:
        return family, initials[0], initials[1] if len(initials) > 1 else "", True
    return None


def parse_firm(text: str | None) -> tuple[str, str, str, bool] | None:
    """(distinctive part, trade, legal form, False); None where nothing distinctive is left."""
    if text is None or _blank(text):
        return None
    flat = re.sub(r"\b([A-Za-z])\.(?=[A-Za-z]\.)", r"\1", text)  # G.m.b.H. is one word
    core, trade, legal = [], "", ""
    for raw in re.findall(r"[^\W_]+(?:['’][^\W_]+)*\.?", flat):
        low = plain(raw)
        if low in ("the", "and", "und", "et", "y", "") or low in NOT_NAMES:
            continue
        if low in LEGAL:
            legal = LEGAL[low]
            continue
        own = fold(raw)
        match = _trade(own, low if raw.endswith(".") else "")
        if match and not trade:
            trade = match
        else:
            core.append(own)
    if not core:
        return None
    return "".join(sorted(core)), trade, legal, False


@lru_cache(maxsize=100_000)
def _trade(own: str, cut: str) -> str:
    """Trade of a folded word; ``cut``: its letters as written, where it ends in a full stop."""
    if own in _TRADES:
        return _TRADES[own]
    if cut and len(own) >= 3:
        fits = [t for t in TRADES if t.startswith(cut)] or [t for f, t in _TRADES.items() if f.startswith(own)]
        return fits[0] if len(fits) == 1 else (own + "." if fits else "")
    if len(own) >= 5:
        for f, t in _TRADES.items():
            if within_one(own, f):
                return t
    return ""


def _given_set(given: str) -> frozenset[str]:
    return CANONICAL.get(given, frozenset())


#: Verdicts on a pair: strong link, weak value fits (2: middle initials agree too), conflict, nothing.
STRONG, FITS, FITS_WELL, CONFLICT, NO = 3, 1, 2, -1, 0


def weak(kind: str, name: tuple[str, str, str, bool]) -> bool:
    """Whether a value may mean several entities: initials, nicknames of several names, cut words of several trades."""
    if kind != "PERSON":
        return name[1].endswith(".")
    return name[3] or len(_given_set(name[1])) > 1


def compare_persons(a: tuple[str, str, str, bool], b: tuple[str, str, str, bool]) -> int:
    if not alike(a[0], b[0]):
        return NO
    if a[3] or b[3]:
        if a[3] and b[3]:
            fit = a[1] == b[1]
        else:
            initial, full = (a[1], b[1]) if a[3] else (b[1], a[1])
            fit = initial in {n[0] for n in _given_set(full)} or not _given_set(full) and initial == full[0]
    else:
        one, two = _given_set(a[1]), _given_set(b[1])
        fit = bool(one & two) or a[1] == b[1] or (not (one and two) and min(len(a[1]), len(b[1])) >= 3 and _near_given(a[1], b[1]))
    if not fit:
        return NO
    if a[2] and b[2]:
        return FITS_WELL if a[2] == b[2] else CONFLICT
    return FITS


def _near_given(a: str, b: str) -> bool:
    """Spellings of one given name, known or not: a misspelt one is near a known one or one of its short forms."""
    return alike(a, b, 0.85)


def _stem(trade: str) -> str:
    """A trade, or what is left of it where it is cut, as it is folded."""
    return trade[:-1] if trade.endswith(".") else fold(trade)


def _trade_keys(trade: str) -> set[str]:
    """First letters of a trade, folded; of all trades it fits where it is cut."""
    if trade.endswith("."):
        return {f[:4] for f in _TRADES if f.startswith(_stem(trade))}
    return {fold(trade)[:4]}


def compare_firms(a: tuple[str, str, str, bool], b: tuple[str, str, str, bool]) -> int:
    if not alike(a[0], b[0]):
        return NO
    trades = a[1] == b[1] or (a[1].endswith(".") and _stem(b[1]).startswith(_stem(a[1]))) or (b[1].endswith(".") and _stem(a[1]).startswith(_stem(b[1])))
    return STRONG if trades and (a[2] == b[2] or not a[2] or not b[2]) else NO


def near_codes(code: str) -> set[str]:
    """Forms of a code of which two codes one edit apart share at least one.

    The code and its forms with one symbol less; for long codes the halves, one of which an edit spares.
    """
    out = set()
    if len(code) <= LONG_CODE:
        out |= {code, *(code[:i] + code[i + 1 :] for i in range(len(code)))}
    if len(code) >= LONG_CODE:  # at the limit both, as an edit may cross it
        for h in {len(code) // 2, (len(code) - 1) // 2}:
            out |= {"<" + blake2b(code[:h].encode(), digest_size=12).hexdigest(), ">" + blake2b(code[-h:].encode(), digest_size=12).hexdigest()}
    return out


def keys(kind: str, name: tuple[str, str, str, bool]) -> list[str]:
    """Blocking keys of a parsed value."""
    code = sound(name[0])
    near = near_codes(code)
    if kind != "PERSON":
        return sorted({f"{kind}|{t}|{c}" for t in _trade_keys(name[1]) for c in near})  # firms of different trades are never one
    known = _given_set(name[1])
    initials = {n[0] for n in known} if known and not name[3] else {name[1][0]}
    out = {f"{i}|{c}" for i in initials for c in near}
    if not name[3]:
        out |= {f"*|{code}|{sound(g)[1:]}" for g in (known or {name[1]})}
        out |= {f"*|{code}|{sound(name[1])[1:]}"}
    return sorted(f"{kind}|{k}" for k in out)


_PARSERS = {"PERSON": (parse_person, compare_persons), "ORG": (parse_firm, compare_firms)}


def parsed(values: DataFrame) -> DataFrame:
    """(kind, name, a, b, c, initial, weak, keys) of the distinct values that parse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = _PARSERS[kind][0](text)
                if own is not None:
                    rows.append((kind, text, *own, weak(kind, own), keys(kind, own)))
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.string()] * 5 + [pa.bool_(), pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["kind", "name", "a", "b", "c", "initial", "weak", "keys"])

    return values.mapInArrow(run, "kind string, name string, a string, b string, c string, initial boolean, weak boolean, keys array<string>")


def compared(pairs: DataFrame) -> DataFrame:
    """(kind, x, y, weak_x, weak_y, verdict) of the pairs that are not unlike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, x, ax, bx, cx, ix, wx, y, ay, by, cy, iy, wy = (c.to_pylist() for c in batch.columns)
            verdict = [_PARSERS[k][1]((p, q, r, s), (t, u, v, w)) for k, p, q, r, s, t, u, v, w in zip(kind, ax, bx, cx, ix, ay, by, cy, iy)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(7), batch.column(6), batch.column(12), pa.array(verdict, type=pa.int32())], names=["kind", "x", "y", "weak_x", "weak_y", "verdict"])

    out = pairs.mapInArrow(run, "kind string, x string, y string, weak_x boolean, weak_y boolean, verdict int")
    return out.filter("verdict <> 0")


def entities(rows: DataFrame, type_column: str, text_column: str, types: Sequence[str] = ("PERSON", "ORG")) -> DataFrame:
    """(kind, name, entity): every value of the given types that is linked, and the least name of its entity."""
    values = rows.select(F.col(type_column).alias("kind"), F.col(text_column).alias("name")).filter(F.col("kind").isin(*types) & (F.trim("name") != "")).distinct()
    names = checkpoint(parsed(values))
    # blocks of equal keys are paired by their parses, of which a block has few, not by their values
    shapes = checkpoint(names.groupBy("kind", "a", "b", "c", "initial", "weak").agg(F.min("name").alias("head"), F.first("keys").alias("keys")))
    at = shapes.withColumn("key", F.explode("keys")).drop("keys")
    left = at.select("key", *(F.col(c).alias(f"{c}_x") for c in ("kind", "head", "a", "b", "c", "initial", "weak")))
    right = at.select("key", *(F.col(c).alias(f"{c}_y") for c in ("head", "a", "b", "c", "initial", "weak")))
    side = lambda s: [f"head_{s}", f"a_{s}", f"b_{s}", f"c_{s}", f"initial_{s}", f"weak_{s}"]
    pairs = left.join(right, "key").filter("head_x < head_y").select("kind_x", *side("x"), *side("y")).distinct()
    found = checkpoint(compared(pairs))
    node = lambda kind, name: F.concat(kind, F.lit("\x01"), name)
    found = found.select(node(F.col("kind"), F.col("x")).alias("x"), node(F.col("kind"), F.col("y")).alias("y"), "weak_x", "weak_y", "verdict")
    strong = found.filter("not weak_x and not weak_y and verdict > 0").select("x", "y")
    every = shapes.select(node(F.col("kind"), F.col("head")).alias("node"), "weak")
    clusters = components(strong, "x", "y")
    firm = every.filter("not weak").join(clusters, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    fits = found.filter("weak_x <> weak_y").select(F.when(F.col("weak_x"), F.col("x")).otherwise(F.col("y")).alias("node"), F.when(F.col("weak_x"), F.col("y")).otherwise(F.col("x")).alias("full"), "verdict")
    options = (
        fits.join(firm.toDF("full", "component"), "full")
        .groupBy("node", "component")
        .agg(F.min("verdict").alias("low"), F.max("verdict").alias("high"))
        .filter("low > 0")
    )
    per = options.groupBy("node", "high").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("component"))
    best = per.groupBy("node").agg(F.max(F.struct("high", "n", "component")).alias("o")).select("node", "o.n", "o.component")
    placed = checkpoint(best)
    # values that fit no full name may still be spellings of each other
    loose = every.filter("weak").join(placed, "node", "left_anti").select("node")
    among = found.filter("weak_x and weak_y and verdict > 0").select("x", "y")
    among = among.join(loose.withColumnRenamed("node", "x"), "x", "left_semi").join(loose.withColumnRenamed("node", "y"), "y", "left_semi")
    rest = components(among, "x", "y")
    label = firm.unionByName(placed.filter("n = 1").select("node", "component")).unionByName(rest)
    lone = every.join(label, "node", "left_anti").select("node", F.col("node").alias("component"))
    label = label.unionByName(lone)
    by_shape = shapes.select("kind", "a", "b", "c", "initial", "weak", node(F.col("kind"), F.col("head")).alias("node")).join(label, "node")
    uncertain = placed.filter("n > 1").select("node")
    by_shape = by_shape.join(uncertain, "node", "left_anti")
    return names.join(by_shape, ["kind", "a", "b", "c", "initial", "weak"]).select("kind", "name", F.split("component", "\x01")[1].alias("entity"))


def linked_pairs(found: DataFrame) -> DataFrame:
    """(kind, name_a, name_b), a < b, of all values of one entity."""
    x, y = found.alias("x"), found.alias("y")
    same = (F.col("x.kind") == F.col("y.kind")) & (F.col("x.entity") == F.col("y.entity")) & (F.col("x.name") < F.col("y.name"))
    return x.join(y, same).select("x.kind", F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b")).distinct()
