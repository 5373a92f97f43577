"""Secret scan: fixed patterns, and strings that a Markov model of secrets explains better than one of ordinary identifiers.

A candidate is a run of TOKEN (LEAST or more characters) that no pattern's match overlaps.  Two character bigram models are compared by the
log-likelihood ratio of a candidate's transitions: it is reported as `markov` when the ratio's mean is MIN_MEAN or more and its sum MIN_SUM or more,
so that a short string needs more evidence for each character.

Each model is made of shipped samples and, to half at most, of the corpus's own.  Shipped random strings are digests in base 64, base 62, hexadecimal and upper-case base 32; shipped
ordinary ones are words joined the way identifiers, paths, hosts and constants are, with numbers.  The corpus's candidates are labelled by
the patterns: what a match overlaps is random, the others are ordinary.  The counts are bounded by the
square of the alphabet, and the models become a literal of ratios.  Spans count code points, the end is exclusive, and a span is a pattern's whole match.

Defined results: null text counts as empty and has no spans (the SHA-256 is that of the empty string).  An empty table is scanned by the shipped samples.  Very
long texts are scanned as a whole; the places of n matches are summed in chunks, in about n steps.  Matches of one kind don't overlap; spans of the same start are
ordered by kind.  Repeated rows get the same spans.  Other columns are carried; one with the name of a result column gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import let, packed, unpacked, whole

# fixed values: the patterns and the least length of what they must find
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGNED = 12
KINDS = ["assign", "access", "hex", "markov"]
LEAST = 12
TOKEN = rf"[A-Za-z0-9+/_=.-]{{{LEAST},}}"
MIN_MEAN, MIN_SUM, SMOOTHING = 0.55, 12.0, 0.5
TRUSTED = 2000  # transitions from a character at which the corpus's own model has half of what it can weigh
CHUNK = 128  # matches whose places are summed together
# fixed values: words of the shipped ordinary samples
WORDS = """account action active address admin agent array async author backup balance batch before binary branch bridge browser bucket buffer builder button cache calendar callback camera
category change channel character chart check client cluster column command comment commit common company component config connect container content context control convert cookie copy
counter country create currency current customer data database date default delete delivery department deploy design detail device dialog directory discount display document domain download
driver editor element email employee engine entity error event example execute export external factory failed feature field file filter folder format function gateway general generate global
graph group handler header height history image import index information input instance interface internal invoice item journal kernel keyboard label language large layer layout length level
library license limit link list loader local location login machine manager market master matrix measure member memory menu message method metric middle mobile model module monitor network node
notification number object offset option order output package page parameter parent partner password payment people performance person picture pixel platform player plugin pointer policy
position power preview price print private process product profile program project property protocol provider public query queue random range reader record reference region register release
remote report request resource response result return review right role route sample schedule schema screen script search second section select sender sequence server service session
setting shared shipping signal single snapshot socket source static status storage stream string structure student style subject summary support switch symbol system table target
template terminal thread ticket timeout title token total track transaction transfer translate trigger update upload user utility validation value variable vendor version video view
visible volume warning website weight width window worker world wrapper writer""".split()
MODEL_SIZE = 128  # code points of the alphabet: TOKEN has ASCII only
RESULTS = ["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]
_EMPTY = "array<struct<s:int,k:int,e:int,v:string>>"


def _matches(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """(s, k, e, v) of each match, leftmost and without overlap.  What lies between the matches gives their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        def walk(gaps: Column) -> Column:
            steps = F.transform(m, lambda v, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(v).alias("len"), v.alias("v")))
            chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / CHUNK).cast("int")), lambda c: F.slice(steps, c * CHUNK + 1, F.lit(CHUNK)))
            return let(chunks, in_chunks)

        def in_chunks(chunks: Column) -> Column:
            sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["gap"] + x["len"]))
            first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            starts = F.aggregate(sums, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
            return F.flatten(F.zip_with(chunks, starts, along))

        def along(chunk: Column, at: Column) -> Column:
            start = F.struct(at.alias("at"), F.expr(f"cast(array() as {_EMPTY})").alias("out"))

            def step(acc: Column, x: Column) -> Column:
                s = acc["at"] + x["gap"]
                e = s + x["len"]
                return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["v"].alias("v")))).alias("out"))

            return F.aggregate(chunk, start, step, lambda acc: acc["out"])

        return F.when(F.size(m) == 0, F.expr(f"cast(array() as {_EMPTY})")).otherwise(let(F.split(text, pattern, -1), walk))

    spans = let(found, placed)
    return spans if keep is None else F.filter(spans, keep)


def _scanned(docs: DataFrame, text: str, carry: list[str] | None) -> DataFrame:
    t = whole(text)
    long_enough = lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 2)) >= MIN_ASSIGNED
    return docs.select(packed(docs, carry).alias("row"), _matches(t, ASSIGN, 0, long_enough).alias("assign"), _matches(t, ACCESS, 1).alias("access"),
                       _matches(t, HEX, 2).alias("hex"), _matches(t, TOKEN, 3).alias("tokens"))


def _touched(token: Column, base: Column) -> Column:
    return F.exists(base, lambda b: (b["s"] < token["e"]) & (token["s"] < b["e"]))


def _apart(tokens: Column, base: Column) -> Column:
    return F.when(F.size(base) == 0, tokens).otherwise(F.filter(tokens, lambda t: ~_touched(t, base)))


def _codes(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.ascii(c))


def labelled_samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, random) of every identifier-like string of the corpus, labelled by whether a pattern's match overlaps it."""
    rows = _scanned(docs, text, []).select(F.concat("assign", "access", "hex").alias("base"), "tokens").filter(F.size("tokens") > 0)
    one = F.transform("tokens", lambda t: F.struct(t["v"].alias("token"), _touched(t, F.col("base")).alias("random")))
    return rows.select(F.explode(one).alias("x")).select("x.*")


def shipped_samples() -> list[tuple[str, bool]]:
    """(token, random), made by rule from digests of numbers and from WORDS."""
    base62 = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)]))
    out: list[tuple[str, bool]] = []
    for i in range(600):
        d = hashlib.sha256(str(i).encode()).digest()
        size = LEAST + d[0] % 29
        forms = [base64.b64encode(d), base64.urlsafe_b64encode(d), d.hex().encode(), base64.b32encode(d), bytes(ord(base62[x % 62]) for x in d * 2), bytes(ord(base62[x % 36].lower()) for x in d * 2)]
        out += [(f.decode()[:size], True) for f in forms]
        a, b, c = (WORDS[(d[k] * 256 + d[k + 1]) % len(WORDS)] for k in (0, 2, 4))
        n, year = str(d[6] % 100), f"20{d[7] % 40:02d}"
        named = [f"{a}_{b}_{c}", f"{a}{b.title()}{c.title()}", f"{a.title()}{b.title()}{n}", f"{a}-{b}-{c}", f"www.{a}{b}.com/{c}", f"{a.upper()}_{b.upper()}", f"{a}/{b}/{c}.html", f"{a}.{b}.{c}.org",
                 f"{a}{b}{c}", f"{year}-{d[8] % 12 + 1:02d}-{d[9] % 28 + 1:02d}_{a}", f"{a}_v{n}.{d[8] % 10}.{d[9] % 10}", f"+{d[8]}-{year}-{d[9]}-{n}", f"{a}s.{b}=={c}", f"----{a}----{b}"]
        out += [(x, False) for x in named]
    return out


def _pairs(tokens: list[str]) -> Counter:
    return Counter(ord(x) * MODEL_SIZE + ord(y) for t in tokens for x, y in zip(t, t[1:]))


def _log_model(shipped: Counter, own: Counter) -> list[float]:
    """Log probability of each second character behind each first one: the shipped model, smoothed, and with up to half of the weight the corpus's own,
    by how often it has the first character."""
    of_shipped, of_own = [0] * MODEL_SIZE, [0] * MODEL_SIZE
    for total, counts in ((of_shipped, shipped), (of_own, own)):
        for pair, n in counts.items():
            total[pair // MODEL_SIZE] += n
    out = []
    for pair in range(MODEL_SIZE**2):
        first = pair // MODEL_SIZE
        p = (shipped.get(pair, 0) + SMOOTHING) / (of_shipped[first] + SMOOTHING * MODEL_SIZE)
        if of_own[first]:
            weight = 0.5 * of_own[first] / (of_own[first] + TRUSTED)
            p = (1 - weight) * p + weight * own.get(pair, 0) / of_own[first]
        out.append(math.log(p))
    return out


def train(samples: DataFrame | None = None) -> list[float]:
    """samples(token, random) -> log-likelihood ratio of each character pair, by code points: row of the first, column of the second.  At most
    2 * MODEL_SIZE^2 counts are collected.  The shipped samples keep half of the weight at least."""
    found: dict[bool, Counter] = {True: Counter(), False: Counter()}
    if samples is not None:
        pairs = samples.select("random", _codes(F.col("token")).alias("c")).filter(F.size("c") > 1)
        pairs = pairs.select("random", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1),
                                                            lambda a, b: a * MODEL_SIZE + b)).alias("pair"))
        for r in pairs.groupBy("random", "pair").count().collect():
            found[r["random"]][r["pair"]] = r["count"]
    shipped = shipped_samples()
    models = {kind: _log_model(_pairs([t for t, k in shipped if k is kind]), found[kind]) for kind in (True, False)}
    return [round(r - o, 6) for r, o in zip(models[True], models[False])]


def _ratio(value: Column, table: Column) -> Column:
    """Sum of the log-likelihood ratios over a string's character pairs."""
    def of(c: Column) -> Column:
        pairs = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.get(table, a * MODEL_SIZE + b))
        return F.aggregate(pairs, F.lit(0.0), lambda x, y: x + y)

    return let(_codes(value), of)


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_spans(docs: DataFrame, text: str = "text", carry: list[str] | None = None, model: list[float] | None = None) -> DataFrame:
    """Each row with its spans.  `model` is what `train` returned; by default it is trained on the labelled samples of `docs`."""
    model = train(labelled_samples(docs, text)) if model is None else model
    base = F.concat("assign", "access", "hex")
    rows = _scanned(docs, text, carry).select("row", base.alias("base"), _apart(F.col("tokens"), base).alias("tokens"), F.size("assign").cast("long").alias("n_assign"),
                                              F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"))
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    extra = F.filter("tokens", lambda t: let(_ratio(t["v"], table), lambda r: (r >= MIN_SUM) & (r >= MIN_MEAN * (F.length(t["v"]) - 1))))
    rows = rows.withColumn("extra", extra)
    rows = rows.select("row", "n_assign", "n_access", "n_hex", F.size("extra").cast("long").alias("n_markov"),
                       F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "extra")).alias("spans"))
    return unpacked(rows, "row", docs.columns if carry is None else carry, RESULTS)
