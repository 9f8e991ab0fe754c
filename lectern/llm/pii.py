"""Personal data by weak supervision (native).

Base patterns find what is certain.  Wider patterns find candidates; on each,
labelers vote for, against or not at all: its form, gazetteers, the words
before it, its shape.  The candidates' votes and features are counted over the
whole corpus (their number of different rows is bounded, whatever its size);
expectation-maximisation on the counts estimates each labeler's reliability
by kind, and a logistic span classifier on votes and span features is trained
on the resulting soft labels.  Candidates that it accepts are added to the
base spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.expr import let
from lectern.llm.shared import others, quoted, same_name, unused

KINDS = ["email", "ip", "card", "phone", "secret"]
LABELERS = ["form", "gazetteer", "context", "shape"]
#: Features of a span besides its votes, and how many values each has.
FEATURES = {"length": 4, "digits": 4, "before": 4}

# Patterns of the base and wider spans.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": ("", rf"(?<![{LOCAL}])[{LOCAL}]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++"),
    "ip": ("", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "phone": ("", r"(?<![0-9(+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "secret": (r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\x22\x27]?\x20?[=:]\x20?[\x22\x27]?", r"[A-Za-z0-9+/_-]{12,}+"),
}
#: What a text must hold for a pattern to be tried on it.
GATE = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"(?:[0-9][\x20-]?){12}[0-9]",
    "phone": r"\+[0-9]",
    "wide_email": r"\(at\)|\[at\]",
    "wide_ip": "[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:",
    "wide_phone": r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]",
    "wide_secret": WIDE["secret"][0],
}

# Gazetteers.
#: Top-level domains in common use.
TOP_DOMAINS = "com org net edu gov mil int info biz name pro io dev app ai co me tv us ca mx br ar cl uk ie fr de at ch it es pt nl be lu dk no se fi is pl cz sk hu ro bg gr tr ru ua il ae sa in pk cn jp kr tw hk sg my th id ph vn au nz za ng ke eg eu".split()
#: Domains kept for documents and tests, which nobody's address has.
RESERVED_DOMAINS = "test invalid localhost local example".split()
#: Calling codes of countries and zones.
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 221 225 233 234 237 241 243 244 249 250 251 254 255 256 260 263 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 380 381 382 385 386 387 389 420 421 423 502 503 504 505 506 507 509 591 592 593 595 597 598 670 673 675 679 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 992 993 994 995 996 998".split()
#: Area codes that no number has: services.
SERVICE_CODES = "211 311 411 511 611 711 811 911".split()
#: First digits of payment cards, and the number's length.
CARD_PREFIXES = [("4", 13), ("4", 16), ("4", 19), ("51", 16), ("52", 16), ("53", 16), ("54", 16), ("55", 16), ("34", 15), ("37", 15), ("36", 14), ("38", 14), ("6011", 16), ("64", 16), ("65", 16), ("35", 16), ("62", 16), ("62", 19), ("50", 16), ("56", 16), ("57", 16), ("58", 16)]
#: First numbers of address blocks that no host on the internet has.
SPECIAL_BLOCKS = "0 127 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 245 246 247 248 249 250 251 252 253 254 255".split()
#: How issued tokens begin.
TOKEN_PREFIXES = "ghp_ gho_ ghs_ glpat- sk_live_ sk_test_ sk- pk_live_ rk_live_ xoxb- xoxp- AKIA ASIA AIza eyJ npm_ hf_".split()
#: What stands in for a secret.
PLACEHOLDERS = "changeme password example placeholder yourpassword yourtoken xxxxxxxx undefined".split()
CONTEXT = {
    "email": "mail contact write schreib escrib contacto",
    "ip": "ip server host address login",
    "card": "card visa credit karte carte tarjeta",
    "phone": "call phone tel mobil fax ruf",
    "secret": "password passwd pwd secret token key",
}
AGAINST = r"(?i)version|isbn|invoice|order|chapter|section|page|part\s+no"

#: Marks where matches begin and end; in the text itself it is taken for another control character.
MARK, OTHER = "\x01", "\x02"
#: Elements folded at a time, so that long arrays don't cost their length squared.
BLOCK = 512


@dataclass(frozen=True)
class Params:
    iterations: int = 40
    steps: int = 600
    rate: float = 1.0
    l2: float = 1e-3
    accept: float = 0.9
    #: Characters before a candidate that the context labeler sees.
    reach: int = 32


# --- spans -----------------------------------------------------------------

def scan(items: Column, zero: Column, ahead: Callable[[Column, Column], Column], step: Callable[[Column, Column], Column], made: Column) -> Column:
    """Array that a fold over ``items`` makes, with a state from left to right.

    ``ahead(state, block)`` is the state behind a block of items, and
    ``step(state, x)`` a struct (state, out) of one item, ``out`` being the
    array that it adds.  ``made`` is an empty array of the result's type.
    Linear in the number of items.
    """
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))

    def states(blocks: Column) -> Column:
        first = F.struct(zero.alias("state"), F.filter(F.array(zero), lambda x: F.lit(False)).alias("all"))
        return F.aggregate(blocks, first, lambda a, b: F.struct(ahead(a["state"], b).alias("state"), F.concat(a["all"], F.array(a["state"])).alias("all")), lambda a: a["all"])

    def fold(start: Column, block: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            return let(step(a["state"], x), lambda y: F.struct(y["state"].alias("state"), F.concat(a["out"], y["out"]).alias("out")))

        return F.aggregate(block, F.struct(start.alias("state"), made.alias("out")), one, lambda a: a["out"])

    whole = let(cut, lambda c: F.flatten(F.transform(F.arrays_zip(states(c).alias("start"), c.alias("block")), lambda z: fold(z["start"], z["block"]))))
    return F.when(F.size(items) > 0, whole).otherwise(made)


SPANS = "array<struct<kind:string,s:int,e:int,t:string,ctx:string>>"


def _spans(text: Column, kind: str, pattern: str, gate: Column, before: str = "", reach: int = 32) -> Column:
    """Array of (kind, s, e, t, ctx) of the leftmost matches that don't overlap.

    One search puts a mark before and behind each match; between the marks
    the text falls apart into gaps and matches, whose lengths add up to the
    positions (code points, end exclusive).
    """
    marked = F.regexp_replace(text, F.lit(f"({before})({pattern})" if before else pattern), F.lit(f"$1{MARK}$2{MARK}" if before else f"{MARK}$0{MARK}"))
    nothing = F.array().cast(SPANS)

    def pairs(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 3) / 2).cast("int")), lambda i: F.struct(F.get(parts, 2 * i).alias("g"), F.get(parts, 2 * i + 1).alias("m")))

    def step(at: Column, p: Column) -> Column:
        s = at + F.length(p["g"])
        e = s + F.length(p["m"])
        one = F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"), p["m"].alias("t"), F.right(p["g"], F.lit(reach)).alias("ctx"))
        return F.struct(e.alias("state"), F.array(one).alias("out"))

    ahead = lambda at, block: F.aggregate(block, at, lambda a, x: a + F.length(x["g"]) + F.length(x["m"]))
    found = let(F.split(marked, MARK), lambda parts: F.when(F.size(parts) >= 3, let(pairs(parts), lambda p: scan(p, F.lit(0), ahead, step, nothing))).otherwise(nothing))
    return F.when(gate, found).otherwise(nothing)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(twice(c.cast("int"))))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(t: Column) -> Column:
    """All parts of a dotted number are at most 255, leading zeros aside."""
    bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(t, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.substring(bare(p), 1, 3).cast("int") <= 255))


def _certain(x: Column, kind: str) -> Column:
    """Whether a raw match of a base pattern is a base span."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _small_parts(x["t"])
    n = F.length(_digits(x["t"]))
    return (n >= 16) & (n <= 19) & luhn(_digits(x["t"])) if kind == "card" else (n >= 8) & (n <= 15)


def raw_matches(text: Column, reach: int) -> Column:
    """Struct of the raw matches: <kind> by base pattern, wide_<kind> by wider pattern."""
    text = F.when(text.contains(MARK), F.translate(text, MARK, OTHER)).otherwise(text)
    gate = lambda name: text.contains(GATE[name]) if name == "email" else text.rlike(GATE[name])
    fields = [_spans(text, kind, pattern, gate(kind), reach=reach).alias(kind) for kind, pattern in BASE.items()]
    fields += [_spans(text, kind, pattern, gate(f"wide_{kind}"), before, reach).alias(f"wide_{kind}") for kind, (before, pattern) in WIDE.items()]
    return F.struct(*fields)


def _clear(base: Column, wide: Column) -> Column:
    """The wide spans that overlap no base span, by start.

    Both are merged by start.  One pass remembers how far the base spans
    before have reached, one pass back where the next one begins.
    """
    kind = "array<struct<s:int,own:int,e:int,kind:string,t:string,ctx:string>>"
    flat = lambda spans, own: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(own).alias("own"), x["e"].alias("e"), x["kind"].alias("kind"), x["t"].alias("t"), x["ctx"].alias("ctx")))
    nothing = F.array().cast(kind)
    ends = lambda block: F.transform(F.filter(block, lambda x: x["own"] == 0), lambda x: x["e"])
    begins = lambda block: F.transform(F.filter(block, lambda x: x["own"] == 0), lambda x: x["s"])

    def after(state: Column, x: Column) -> Column:
        keep = (x["own"] == 0) | (state <= x["s"])
        return F.struct(F.when(x["own"] == 0, F.greatest(state, x["e"])).otherwise(state).alias("state"), F.when(keep, F.array(x)).otherwise(nothing).alias("out"))

    def before(state: Column, x: Column) -> Column:
        keep = (x["own"] == 1) & (state >= x["e"])
        return F.struct(F.when(x["own"] == 0, F.least(state, x["s"])).otherwise(state).alias("state"), F.when(keep, F.array(x)).otherwise(nothing).alias("out"))

    merged = F.sort_array(F.concat(flat(base, 0), flat(wide, 1)))
    far = F.lit((1 << 31) - 1)
    forward = lambda m: scan(m, F.lit(0), lambda state, b: F.greatest(state, F.array_max(ends(b))), after, nothing)
    back = lambda m: scan(F.reverse(m), far, lambda state, b: F.least(state, F.array_min(begins(b))), before, nothing)
    left = let(let(merged, forward), back)
    plain = F.transform(F.reverse(left), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), x["ctx"].alias("ctx")))
    return F.when((F.size(base) == 0) | (F.size(wide) == 0), wide).otherwise(plain)


def base_and_candidates(raw: Column) -> Column:
    """Struct (base, more): base spans by kind and start, and candidates that overlap none of them."""
    sure = lambda kind: F.filter(raw[kind], lambda x: _certain(x, kind))
    n = lambda x: F.length(_digits(x["t"]))
    unsure = F.concat(F.filter(raw["ip"], lambda x: ~_certain(x, "ip")), F.filter(raw["card"], lambda x: (n(x) >= 13) & (n(x) <= 19) & ~_certain(x, "card")))
    both = F.struct(F.concat(*[sure(k) for k in BASE]).alias("base"), F.concat(unsure, *[raw[f"wide_{k}"] for k in WIDE]).alias("wide"))
    return let(both, lambda b: F.struct(b["base"].alias("base"), _clear(b["base"], b["wide"]).alias("more")))


# --- labelers and features --------------------------------------------------

def _one_of(words: list[str]) -> str:
    return "|".join(w.replace("-", r"\-") for w in words)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, F.lit(-1)).when(yes, F.lit(1)).otherwise(F.lit(0))


def _gazetteers(t: Column) -> dict[str, Column]:
    """Votes of the gazetteers by kind."""
    digits, low = _digits(t), F.lower(t)
    issuer = F.lit(False)
    for prefix, length in CARD_PREFIXES:
        issuer = issuer | (digits.startswith(prefix) & (F.length(digits) == length))
    top = F.regexp_extract(low, r"([a-z0-9-]+)$", 1)
    local = F.regexp_extract(t, r"([0-9]{3})\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$", 1)
    return {
        "email": _vote(top.isin(TOP_DOMAINS), top.isin(RESERVED_DOMAINS)),
        "ip": _vote(~t.contains(":") & _small_parts(t) | t.contains(":"), F.substring_index(t, ".", 1).isin(SPECIAL_BLOCKS)),
        "card": _vote(issuer, ~issuer),
        "phone": F.when(t.startswith("+"), _vote(t.rlike(rf"^\+(?:{_one_of(CALLING_CODES)})"), F.lit(False))).otherwise(_vote(local.rlike("^[2-9]"), local.rlike("^[01]") | local.isin(SERVICE_CODES))),
        "secret": _vote(t.rlike(rf"^(?:{_one_of(TOKEN_PREFIXES)})") | t.rlike("[0-9]"), low.rlike(rf"^(?:{_one_of(PLACEHOLDERS)})")),
    }


def votes(x: Column) -> Column:
    """Array of the labelers' votes (1, 0, -1) on one candidate."""
    by_kind = lambda of: F.coalesce(*[F.when(x["kind"] == k, of[k]) for k in KINDS], F.lit(0))
    sign = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(-1))
    t, digits = x["t"], _digits(x["t"])
    n = F.length(digits)
    form = {
        "email": sign(t.rlike(rf"^[{LOCAL}]+(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]+(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]+)+$")),
        "ip": sign(F.when(t.contains(":"), F.lit(True)).otherwise(_small_parts(t))),
        "card": sign((n >= 13) & luhn(digits)),
        "phone": F.when((t.startswith("+") | x["ctx"].rlike(r"\+[0-9]{1,3}\x20?$")) & (n >= 8) & (n <= 15), F.lit(1)).otherwise(F.lit(0)),
        "secret": sign(t.rlike("[0-9]") & t.rlike("[A-Za-z]") & (F.length(t) >= 16)),
    }
    words = {k: F.when(x["ctx"].rlike(rf"(?i){'|'.join(w if w != 'ip' else r'\bip\b' for w in CONTEXT[k].split())}"), F.lit(1)).otherwise(F.lit(0)) for k in KINDS}
    context = F.when(x["ctx"].rlike(AGAINST), F.lit(-1)).otherwise(by_kind(words))
    several = sign(F.size(F.array_distinct(F.split(digits, ""))) >= 4)
    shape = by_kind({k: sign(t.rlike(r"^[^@(\[]{2,}")) if k == "email" else several for k in KINDS})
    return F.array(by_kind(form), by_kind(_gazetteers(t)), context, shape)


def features(x: Column) -> Column:
    """Array of a candidate's features, each from 0 to its number of values less 1."""
    n, digits = F.length(x["t"]), F.length(_digits(x["t"]))
    length = F.when(n <= 12, 0).when(n <= 19, 1).when(n <= 32, 2).otherwise(3)
    share = F.when(digits == 0, 0).when(2 * digits < n, 1).when(digits < n, 2).otherwise(3)
    last = F.right(x["ctx"], F.lit(1))
    before = F.when(last == "", 0).when(last.rlike(r"[\s]"), 1).when(last.rlike(r"[=:\x22\x27(<\[+]"), 2).otherwise(3)
    return F.array(length, share, before)


# --- label model and classifier -----------------------------------------------

@dataclass(frozen=True)
class Model:
    """``trust``: {(kind, labeler, class, vote): probability}; ``weights``: a (kinds x values) table for each vote and feature; ``bias`` by kind."""

    trust: dict[tuple[str, int, int, int], float]
    weights: list[np.ndarray]
    bias: np.ndarray

    def score(self, kind: int, columns: list[int]) -> float:
        z = self.bias[kind] + sum(w[kind, c] for w, c in zip(self.weights, columns, strict=True))
        return 1 / (1 + math.exp(-z))


#: Values of each column that the classifier sees: votes (plus 1), then features.
VALUES = [3] * len(LABELERS) + list(FEATURES.values())


def label_model(counts: list[tuple[str, tuple[int, ...], int]], p: Params) -> tuple[dict, list[float]]:
    """EM over (kind, votes, count): each labeler's reliability by kind, and each row's probability.

    A labeler is taken to be right more often than not, by two votes of evidence.
    """
    likely = [1 / (1 + math.exp(-sum(v))) for _, v, _ in counts]
    trust: dict = {}
    for _ in range(p.iterations if counts else 0):
        prior = {k: [1.0, 1.0] for k in KINDS}
        seen: dict = {}
        for (kind, v, n), q in zip(counts, likely, strict=True):
            for y, share in ((1, q), (0, 1 - q)):
                prior[kind][y] += n * share
                for j, vote in enumerate(v):
                    seen[kind, j, y, vote] = seen.get((kind, j, y, vote), 0.0) + n * share
        for kind in KINDS:
            for j in range(len(LABELERS)):
                for y in (0, 1):
                    each = [seen.get((kind, j, y, t), 0.0) + (2.0 if t == (1 if y else -1) else 1.0) for t in (-1, 0, 1)]
                    trust |= {(kind, j, y, t): e / sum(each) for t, e in zip((-1, 0, 1), each, strict=True)}
        likely = []
        for kind, v, _ in counts:
            log = [math.log(prior[kind][y] / sum(prior[kind])) + sum(math.log(trust[kind, j, y, t]) for j, t in enumerate(v)) for y in (0, 1)]
            likely.append(1 / (1 + math.exp(max(-500.0, min(500.0, log[0] - log[1])))))
    return trust, likely


def fit(counts: list[tuple[str, tuple[int, ...], tuple[int, ...], int]], p: Params) -> Model:
    """Reliabilities by EM, then the span classifier, from (kind, votes, features, count) rows.

    The bounded rows are worked on in a fixed order, so equal counts give
    equal weights.  Each kind has its own weights; a kind without rows has
    none and accepts nothing.
    """
    counts = sorted(counts)
    together: dict = {}
    for kind, v, _, n in counts:
        together[kind, v] = together.get((kind, v), 0) + n
    rows = [(kind, v, n) for (kind, v), n in sorted(together.items())]
    trust, likely = label_model(rows, p)
    soft = {(kind, v): q for (kind, v, _), q in zip(rows, likely, strict=True)}
    weights, bias = [np.zeros((len(KINDS), n)) for n in VALUES], np.full(len(KINDS), -20.0)
    for at, kind in enumerate(KINDS):
        own = [r for r in counts if r[0] == kind]
        if not own:
            continue
        x = np.zeros((len(own), sum(VALUES)))
        starts = np.cumsum([0, *VALUES[:-1]])
        for i, (_, v, f, _) in enumerate(own):
            x[i, starts + np.array([*(t + 1 for t in v), *f])] = 1
        q = np.array([soft[kind, v] for _, v, _, _ in own])
        share = np.array([n for *_, n in own], float) / sum(n for *_, n in own)
        w, b = np.zeros(x.shape[1]), 0.0
        for _ in range(p.steps):
            gap = (q - 1 / (1 + np.exp(-(x @ w + b)))) * share
            w, b = w + p.rate * (x.T @ gap - p.l2 * w), b + p.rate * gap.sum()
        bias[at] = b
        for table, a in zip(weights, starts, strict=True):
            table[at] = w[a : a + table.shape[1]]
    return Model(trust, weights, bias)


def _counts(found: DataFrame) -> list[tuple[str, tuple[int, ...], tuple[int, ...], int]]:
    """Counts of (kind, votes, features) over base spans and candidates: at most 5 x 81 x 64 rows come back."""
    x = found.select(F.explode(F.concat("f.base", "f.more")).alias("x"))
    x = x.select(F.col("x.kind").alias("kind"), votes(F.col("x")).alias("v"), features(F.col("x")).alias("f"))
    names = [f"v{j}" for j in range(len(LABELERS))], [f"f{j}" for j in range(len(FEATURES))]
    x = x.select("kind", *[F.col("v")[j].alias(n) for j, n in enumerate(names[0])], *[F.col("f")[j].alias(n) for j, n in enumerate(names[1])])
    rows = x.groupBy("kind", *names[0], *names[1]).count().collect()
    return [(r["kind"], tuple(r[n] for n in names[0]), tuple(r[n] for n in names[1]), r["count"]) for r in rows]


def _accepts(model: Model, p: Params) -> Callable[[Column], Column]:
    """Whether the classifier accepts a candidate; more labelers have to be for it than against."""
    kind = lambda x: F.coalesce(*[F.when(x["kind"] == k, F.lit(i)) for i, k in enumerate(KINDS)])

    def score(y: Column) -> Column:
        z = F.get(F.array(*[F.lit(float(b)) for b in model.bias]), y["kind"])
        for j, (table, n) in enumerate(zip(model.weights, VALUES, strict=True)):
            value = y["v"][j] + 1 if j < len(LABELERS) else y["f"][j - len(LABELERS)]
            z = z + F.get(F.array(*[F.lit(float(w)) for w in table.ravel()]), y["kind"] * n + value)
        return (1 / (1 + F.exp(-z)) >= p.accept) & (F.aggregate(y["v"], F.lit(0), lambda a, t: a + t) > 0)

    return lambda x: let(F.struct(kind(x).alias("kind"), votes(x).alias("v"), features(x).alias("f")), score)


# --- the operator -------------------------------------------------------------

def found_spans(text: Column, p: Params) -> Column:
    """Struct (base, more) of a text's base spans and candidates; a null text has none."""
    return let(raw_matches(F.coalesce(text, F.lit("")), p.reach), base_and_candidates)


def learn(df: DataFrame, text: str = "text", params: Params | None = None) -> Model:
    """The model of df's own base spans and candidates."""
    p = params or Params()
    return fit(_counts(df.select(found_spans(quoted(text), p).alias("f"))), p)


def detect(df: DataFrame, text: str = "text", params: Params | None = None, base: str = "base", spans: str = "spans", model: Model | None = None) -> DataFrame:
    """df with base and spans: arrays of (kind, s, e), by kind as in KINDS, then start.

    ``base`` holds what the base patterns are certain of; ``spans`` also what
    the classifier accepts.  Positions are code points, the end exclusive.  A
    null or empty text has no spans; repeated rows are found alike; an empty
    table gives an empty table; columns named like an output are replaced.
    Work is in proportion to a text's length and its matches.
    """
    p = params or Params()
    model = model or learn(df, text, p)
    accepted = _accepts(model, p)
    bare = lambda some: F.transform(some, lambda s: F.struct(s["kind"].alias("kind"), s["s"].alias("s"), s["e"].alias("e")))

    def both(f: Column) -> Column:
        more = F.filter(f["more"], accepted)
        of = lambda k: F.sort_array(bare(F.filter(F.concat(f["base"], more), lambda s: s["kind"] == k)))
        return F.struct(bare(f["base"]).alias("base"), F.when(F.size(more) > 0, F.concat(*[of(k) for k in KINDS])).otherwise(bare(f["base"])).alias("spans"))

    held = unused(df, "_both")
    x = df.withColumn(held, let(found_spans(quoted(text), p), both))
    return x.select(*[quoted(c) for c in others(df, base, spans)], F.col(f"{held}.base").alias(base), F.col(f"{held}.spans").alias(spans))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", params: Params | None = None) -> DataFrame:
    """df with each span of its texts replaced by <KIND>; of spans that overlap, the first names the place.

    A null text stays null; all other columns stay as they are.
    """
    p = params or Params()
    accepted = _accepts(learn(df, text, p), p)
    value = quoted(text)

    def cut(f: Column) -> Column:
        spans = F.array_sort(F.concat(f["base"], F.filter(f["more"], accepted)), lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"]))
        nothing = F.array().cast("array<struct<at:int,s:int,mark:string>>")

        def step(at: Column, x: Column) -> Column:
            mark = F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))
            one = F.struct(at.alias("at"), x["s"].alias("s"), mark.alias("mark"))
            return F.struct(F.greatest(at, x["e"]).alias("state"), F.when(x["s"] >= at, F.array(one)).otherwise(nothing).alias("out"))

        ahead = lambda at, block: F.greatest(at, F.array_max(F.transform(block, lambda x: x["e"])))
        kept = lambda s: scan(s, F.lit(0), ahead, step, nothing)
        end = lambda s: F.array_max(F.transform(s, lambda x: x["e"]))
        return let(spans, lambda s: F.when(F.size(s) > 0, F.struct(kept(s).alias("cuts"), end(s).alias("end"))))

    def joined(y: Column) -> Column:
        """The gaps before each mark, in blocks: a block's text is cut out once, and its gaps from that."""
        cuts = y["cuts"]
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / BLOCK).cast("int")), lambda b: F.slice(cuts, b * BLOCK + 1, BLOCK))

        def part(b: Column) -> Column:
            low, high = b[0]["at"], F.element_at(b, -1)["s"]
            own = F.substring(value, low + 1, high - low)
            return let(own, lambda o: F.array_join(F.transform(b, lambda x: F.concat(F.substring(o, x["at"] - low + 1, x["s"] - x["at"]), x["mark"])), ""))

        return F.concat(F.array_join(F.transform(blocks, part), ""), F.substring(value, y["end"] + 1, F.length(value)))

    found = let(found_spans(value, p), cut)
    out = F.when(value.isNull(), value).otherwise(let(found, lambda y: F.when(y.isNull(), value).otherwise(joined(y))))
    return df.select(*[out.alias(c) if same_name(df.sparkSession)(c) == same_name(df.sparkSession)(text) else quoted(c) for c in df.columns])
