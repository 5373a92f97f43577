"""Quality rules: counts of a text, and how far its histograms diverge from language references.

A document has two histograms: its characters by class, and its words by the common words of the reference languages (all
other words in one bin).  The references are those histograms summed over all documents of a language that pass the base rules.
The Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) to the nearest reference decides; each of the two rules
has a minimum length below which it says nothing.  A text whose common words are rarer than in its nearest reference also goes when it is nearly as far from it as
a text without any (`MISSING_WORDS`).  All of it is column expressions; only the references, one row for each
language in `COMMON_WORDS`, come to the driver.

Defined results: null text has no words and fails the base rules.  A language that is null or has no reference is judged like any
other, by the nearest reference.  Without any reference (an empty table) only the base rules decide.  Repeated rows are judged
alike.  Other columns are carried; one with the name of a result column gives way to it.
"""

from __future__ import annotations

import math
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordworks.session import settled

from .base import SPACES, WORD, let, packed, unpacked, whole

# fixed values: frequent function words of each reference language
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
# fixed values: character classes that are told apart once lower-case letters are out; white space, symbols and all others are counted besides
LOWER = r"\p{Ll}+"
CLASSES = {"upper": r"\p{Lu}+", "letter": r"[\p{Lt}\p{Lm}\p{Lo}]+", "digit": r"\p{N}+", "mark": r"[.,;:!?'\"()-]+"}
LONGEST = max(len(w) for w in VOCABULARY)
MIN_WORDS, MAX_REPEATED_PCT = 50, 50
MAX_CHAR_DISTANCE, MIN_CHARS = 0.25, 200
MAX_WORD_DISTANCE, MIN_COUNTED_WORDS = 0.5, 100
MISSING_WORDS = 0.9  # of the distance that a text without common words has to its nearest reference; for texts with a lower share of them
BOTH_CHAR_DISTANCE, BOTH_WORD_DISTANCE = 0.13, 0.28  # a text that is somewhat far in both
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]


def _repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more.  Windows are hashed and sorted with their places; equal
    neighbours are repeated; each place then covers up to three words that no later place covers."""
    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 2),
                              lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("p")))

        def places(s: Column) -> Column:
            repeated = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
            return F.sort_array(F.transform(repeated, lambda x: x["p"]))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(3)), F.lit(3)))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return F.when(F.size(w) < 3, 0).otherwise(let(let(F.sort_array(windows), places), covered))

    return let(words, of).cast("long")


def _slots() -> tuple[int, list[str]]:
    """The least table size at which the words of VOCABULARY have slots of their own by CRC-32, and the words by slot."""
    size = len(VOCABULARY)
    while len({crc32(w.encode()) % size for w in VOCABULARY}) < len(VOCABULARY):
        size += 1
    words = [" "] * size  # no word, not even an empty one, equals an unused slot
    for w in VOCABULARY:
        words[crc32(w.encode()) % size] = w
    return size, words


def _word_counts(text: Column, n_words: Column) -> Column:
    """How often the word of each slot occurs, and then all other words.  Longer words than any of VOCABULARY go before the text is split.
    Slots are sorted together with a marker for each of them, so that a count is the distance between two changes of value."""
    size, slots = _slots()
    table = F.array(*[F.lit(w) for w in slots])
    short = F.split(F.regexp_replace(F.lower(text), rf"{WORD[:-1]}{{{LONGEST + 1},}}", " "), SPACES, -1)
    places = F.transform(short, lambda w: let(F.pmod(F.crc32(w.cast("binary")), F.lit(size)).cast("int"), lambda p: F.when(F.get(table, p) == w, p).otherwise(-1)))
    ordered = F.sort_array(F.concat(places, F.sequence(F.lit(-1), F.lit(size))))

    def ends(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda i: F.get(s, i) != F.get(s, i + 1))

    counts = let(let(ordered, ends), lambda e: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: (F.get(e, k) - F.get(e, k - 1) - 1).cast("long")))
    return let(counts, lambda c: F.concat(c, F.array(n_words - F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b))))


def _class_counts(odd: Column, n_chars: Column, word_chars: Column, symbols: Column) -> Column:
    """Lower-case letters, CLASSES, white space, symbols and all others.  `odd` is the text without white space and lower-case letters, so
    that the other classes are looked for in a small part of it."""
    n = F.length(odd).cast("long")
    counts = F.array(word_chars - n, *[n - F.length(F.regexp_replace(odd, pattern, "")) for pattern in CLASSES.values()], n_chars - word_chars, symbols)
    return let(counts, lambda c: F.concat(c, F.array(n_chars - F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b))))


def counted(docs: DataFrame, text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """The base counts and the histograms of each row."""
    t = whole(text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    words = F.filter(F.split(F.col("t"), SPACES, -1), lambda w: w != "")
    out = docs.select(packed(docs, carry).alias("row"), F.col(f"`{lang}`").alias("lang"), t.alias("t"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    out = out.withColumn("n_chars0", F.length("t").cast("long")).withColumn("solid", F.regexp_replace("t", SPACES, ""))
    out = out.withColumn("word_chars", F.length("solid").cast("long")).withColumn("odd", F.regexp_replace("solid", LOWER, ""))
    out = out.withColumn("n_symbols", (F.length("odd") - F.length(F.translate("odd", "#*$%&|<>", ""))).cast("long")).withColumn("n_words", F.regexp_count("t", F.lit(WORD)).cast("long"))
    out = out.select("row", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", _repeat_words(words).alias("n_repeat_words"), "n_chars0",
                     _class_counts(F.col("odd"), F.col("n_chars0"), F.col("word_chars"), F.col("n_symbols")).alias("classes"), _word_counts(F.col("t"), F.col("n_words")).alias("words"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PCT * F.col("n_words")))


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """counted rows -> histograms of each language over all its documents that pass the base rules: at most one row a reference language is
    collected."""
    rows = rows.filter(F.col("lang").isin(list(COMMON_WORDS)) & ~F.col("base_failed"))
    nc, nw = len(CLASSES) + 4, _slots()[0] + 1
    sums = rows.groupBy("lang").agg(*[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(nc)], *[F.sum(F.col("words")[i]).alias(f"w{i}") for i in range(nw)])
    found = {}
    for r in sums.collect():
        c, w = [float(r[f"c{i}"]) for i in range(nc)], [float(r[f"w{i}"]) for i in range(nw)]
        found[r["lang"]] = ([x / sum(c) for x in c], [x / sum(w) for x in w])
    return dict(sorted(found.items()))


def _distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a count array to a reference distribution."""
    q = F.array(*[F.lit(x) for x in reference])

    def of(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)

        def term(x: Column, y: Column) -> Column:
            mean = (x + y) / 2
            return F.when(x > 0, x * F.log2(x / mean)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / mean)).otherwise(0.0)

        parts = let(total, lambda n: F.zip_with(c, q, lambda x, y: term(x / F.greatest(n, F.lit(1)), y)))
        return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))

    return let(counts, of)


def _bare(other: float) -> float:
    """Distance of a text without common words to a reference in which all other words have the share `other`."""
    return math.sqrt(max((math.log2(2 / (1 + other)) + 1 - other + (other * math.log2(2 * other / (1 + other)) if other else 0)) / 2, 0))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """Each row with its counts, the verdict of the base rules, the distances to the nearest reference and whether it is kept.  The
    counts are written once, beside the carried columns, and serve both the references and the verdict."""
    rows = settled(counted(docs, text, lang, carry))
    known = references(rows)
    if known:
        near = lambda name, i: F.array_min(F.array(*[_distance(F.col(name), ref[i]) for ref in known.values()]))
        rows = rows.withColumn("char_distance", near("classes", 0)).withColumn("word_distance", near("words", 1))
        # each reference with its distance, the limit for missing words and its share of other words; the nearest counts
        refs = [F.struct(_distance(F.col("words"), w), F.lit(MISSING_WORDS * _bare(w[-1])).alias("limit"), F.lit(w[-1]).alias("other")) for _, w in known.values()]
        missing = let(F.array_min(F.array(*refs)), lambda m: (F.col("word_distance") > m["limit"]) & (F.element_at("words", -1) > m["other"] * F.col("n_words")))
    else:
        missing = F.lit(False)
        rows = rows.withColumn("char_distance", F.lit(None).cast("double")).withColumn("word_distance", F.lit(None).cast("double"))
    far = (((F.col("n_chars0") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE))
           | ((F.col("n_words") >= MIN_COUNTED_WORDS)
              & ((F.col("word_distance") > MAX_WORD_DISTANCE) | missing
                 | ((F.col("char_distance") > BOTH_CHAR_DISTANCE) & (F.col("word_distance") > BOTH_WORD_DISTANCE)))))
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    return unpacked(rows, "row", docs.columns if carry is None else carry, RESULTS)


def passing(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that the rules keep, with their own columns."""
    names = docs.columns
    return judged(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
                  .select("row", "text", "lang"), carry=["row"]).filter("kept").select("row.*")

_WORD_LIST = ", ".join(f"'{w}'" for w in VOCABULARY)
_LANG_LIST = ", ".join(f"'{w}'" for w in COMMON_WORDS)
OP7_SQL = rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS p, unnest(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) AS h
    FROM w WHERE len(words) >= 3),
r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g)
    WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, length(t)::BIGINT AS n_chars, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PCT} * n_words AS base_failed, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS upper,
    length(regexp_replace(t, '[^\p{{Ll}}]+', '', 'g')) AS lower, length(regexp_replace(t, '[^\p{{Lt}}\p{{Lm}}\p{{Lo}}]+', '', 'g')) AS letter, length(regexp_replace(t, '[^\p{{N}}]+', '', 'g')) AS digit,
    length(regexp_replace(t, '[^.,;:!?''"()-]+', '', 'g')) AS mark FROM w LEFT JOIN r USING (doc_id)),
hist AS (SELECT doc_id, lang, n_words, base_failed, 'char' AS kind, unnest(['upper', 'lower', 'letter', 'digit', 'mark', 'space', 'symbol', 'rest']) AS bin,
      unnest([upper, lower, letter, digit, mark, n_chars - word_chars, n_symbols, word_chars - n_symbols - upper - lower - letter - digit - mark]) AS n FROM c
    UNION ALL SELECT c.doc_id, c.lang, c.n_words, c.base_failed, 'word', x.bin, count(y.word) FROM c JOIN (SELECT unnest([{_WORD_LIST}]) AS bin) x ON true
      LEFT JOIN (SELECT doc_id, unnest(list_transform(words, lambda v: lower(v))) AS word FROM w) y ON y.doc_id = c.doc_id AND y.word = x.bin GROUP BY ALL),
h AS (SELECT * FROM hist UNION ALL SELECT doc_id, lang, n_words, base_failed, 'word', '', n_words - sum(n) FROM hist WHERE kind = 'word' GROUP BY doc_id, lang, n_words, base_failed),
ref AS (SELECT lang, kind, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang, kind) AS q FROM h WHERE lang IN ({_LANG_LIST}) AND NOT base_failed GROUP BY lang, kind, bin),
own AS (SELECT doc_id, kind, bin, n / greatest(sum(n) OVER (PARTITION BY doc_id, kind), 1) AS p FROM h),
bare AS (SELECT lang, q AS other, {MISSING_WORDS} * sqrt(greatest((log2(2 / (1 + q)) + 1 - q + CASE WHEN q > 0 THEN q * log2(2 * q / (1 + q)) ELSE 0 END) / 2, 0)) AS lim
    FROM ref WHERE kind = 'word' AND bin = ''),
d AS (SELECT doc_id, own.kind, ref.lang, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0))
    AS x FROM own JOIN ref ON own.kind = ref.kind AND own.bin = ref.bin GROUP BY ALL),
m AS (SELECT doc_id, min(x) FILTER (kind = 'char') AS char_distance, min(x) FILTER (kind = 'word') AS word_distance,
    arg_min(lim, x) FILTER (kind = 'word') AS lim, arg_min(other, x) FILTER (kind = 'word') AS other FROM d JOIN bare USING (lang) GROUP BY doc_id),
o AS (SELECT doc_id, n AS n_other FROM h WHERE kind = 'word' AND bin = ''),
v AS (SELECT c.*, char_distance, word_distance, coalesce(word_distance > lim AND n_other > other * n_words, false) AS missing FROM c LEFT JOIN m USING (doc_id)
    LEFT JOIN o USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance,
  NOT base_failed AND NOT (n_chars >= {MIN_CHARS} AND coalesce(char_distance, 0) > {MAX_CHAR_DISTANCE} OR n_words >= {MIN_COUNTED_WORDS} AND
    (coalesce(word_distance, 0) > {MAX_WORD_DISTANCE} OR missing OR coalesce(char_distance, 0) > {BOTH_CHAR_DISTANCE} AND coalesce(word_distance, 0) > {BOTH_WORD_DISTANCE})) AS kept FROM v"""
