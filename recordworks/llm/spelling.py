"""Spelling variants: words one edit apart, found by walking a trie level by level, and the frequent form that each stands for.

The trie is a table of edges, one level after the other.  Edges carry labels: below a node, the words that agree in the next character
share an edge up to the last character in which they all agree, so long words cost no levels; an edge of a single word
runs to that word's end.  States (word, node, rest of the word, edits) advance one edge a level by a join with that level's edges:

- without an edit a state is the word's own path, and these states also make the edges of the next level;
- two words one edit apart part at a node of the trie, so an edit happens only at a node, by going from there into another edge than the
  word's own: the character is replaced, one is inserted, or one is left out.  After it, a state must match labels exactly and has one way.  Of two
  words that part at a node, the one whose next character is less goes to the other;
- a state with an edit that arrives at the end of a word with nothing left names a neighbour.

An edit near the root would branch into everything.  Each word is therefore walked twice, through the trie of the words and through that of
their reversals, and may be edited only behind its middle: the words that differ from it before the middle are those whose reversals differ behind it.

States live in written tables; a node with very many words is a hot join key, which AQE splits, and counts and labels (least and greatest
rest of an edge) are combined before the shuffle.  The number of levels is that of the branching nodes on the deepest path.

Defined results: null and empty texts have no words; a null id counts as the empty text in the noise.  Repeated rows count each time.  Very long texts
are split into words as a whole, and very long words are compared along labels.  Ties between forms go to the least word in code-point order.
An empty table gives an empty result.  Columns other than id and text are not read, so no name of theirs can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordworks.session import Scratch

from .base import whole

LETTERS = "a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "$"  # no letter; makes every word end at a leaf
RESULTS = ["word", "form", "root", "n", "n_near", "form_n"]


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, noise: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words of `least_length` code points and `least_count` occurrences at least.  Where `noise` divides the CRC of
    `<id>:<word>`, one character of the word, chosen by the same number, is missing; 0 means no noise."""
    runs = F.regexp_extract_all(F.translate(whole(text), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    if noise:
        h = F.crc32(F.concat("id", F.lit(":"), "word"))
        found = found.select("word", h.alias("h")).select(
            F.when(F.col("h") % noise != 0, F.col("word")).otherwise(_without("word", (F.col("h") % F.length("word")).cast("int"))).alias("word"))
    return (found.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= least_count))


def _without(word: str, place: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def _agreeing(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, from the greatest power of two down."""
    powers = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    longest = F.least(F.length(a), F.length(b))
    return F.aggregate(powers, F.lit(0), lambda n, p: F.when((n + p <= longest) & (F.left(a, n + p) == F.left(b, n + p)), n + p).otherwise(n))


def _tail(value: str, start: Column) -> Column:
    """What stands from place `start` (from 0) on."""
    return F.substring(value, start + 1, F.length(value))


def _start(words: DataFrame) -> DataFrame:
    """The states at the two roots: of each word (tree 0) and of its reversal (tree 1), with the depth from which it may be edited."""
    half = (F.length("word") / 2).cast("int")
    sides = [words.select("wid", F.lit(side - 2).cast("long").alias("node"), F.lit(0).alias("depth"), F.concat(s, F.lit(END)).alias("rest"),
                          F.lit(0).alias("edits"), free.cast("int").alias("free"), F.lit(False).alias("leaf"), F.lit(-1).cast("long").alias("word"))
             for side, s, free in ((0, F.col("word"), half), (1, F.reverse("word"), F.length("word") - half))]
    return sides[0].unionByName(sides[1])


def _edges(states: DataFrame) -> DataFrame:
    """The edges below the nodes of the exact states: (node, depth, ch), label, leaf, child, word; `ch` is how the label begins."""
    groups = (states.filter("edits = 0").groupBy("node", "depth", "ch")
              .agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.count(F.lit(1)).alias("words"), F.min("wid").alias("word")))
    label = F.when(F.col("words") == 1, F.col("low")).otherwise(F.left("low", _agreeing(F.col("low"), F.col("high"))))
    # a node is known by its least word, the tree and its depth: nodes of the same depth have no word in common
    side = F.when(F.col("node") < 0, F.col("node") + 2).otherwise(F.col("node") % 2)
    return groups.select("node", "depth", "ch", label.alias("label"), (F.col("words") == 1).alias("leaf"), (F.col("word") * 2 + side).alias("child"), "word")


def _edited() -> list[tuple[Column, Column]]:
    """For a state at a node and an edge that isn't its own: (whether it goes down the edge with one edit, what is left of it)."""
    r, s = F.col("rest"), F.col("label")
    n = F.length("label")
    after, below = _tail("rest", F.lit(1)), _tail("label", F.lit(1))
    has_r, has_s = F.left("rest", F.lit(1)) != END, F.left("label", F.lit(1)) != END
    return [(has_r & has_s & after.startswith(below), _tail("rest", n)),  # replaced
            (has_s & r.startswith(below), _tail("rest", n - 1)),  # inserted
            (has_r & after.startswith(s), _tail("rest", n + 1))]  # left out


def near_words(words: DataFrame, scratch: Scratch, least_length: int = 7) -> DataFrame:
    """words(wid, word) of `least_length` code points at least, wid distinct and 0 or more -> (wid, other), both ways, for all
    words that differ by exactly one inserted, deleted or replaced code point."""
    level, found = scratch.keep(_start(words)), []
    width = max(1, least_length // 2)  # no word is edited before this depth, so the first edges may be as wide
    ways = _edited()
    tests = [ok & (~F.col("leaf") | (left == "")) for ok, left in ways]  # at a word's end nothing may be left
    lefts = F.array(*[F.when(test, left) for test, (_, left) in zip(tests, ways)])
    while (states := level.filter("NOT leaf").drop("leaf", "word")).limit(1).count():
        states = states.withColumn("ch", F.left("rest", F.lit(width)))
        edges = scratch.keep(_edges(states))
        onward = (states.join(edges, ["node", "depth", "ch"]).filter("edits = 0 OR startswith(rest, label)")
                  .select("wid", "child", "depth", "label", _tail("rest", F.length("label")).alias("rest"), "edits", "free", "leaf", "word"))
        others = edges.withColumnsRenamed({"node": "at", "depth": "down", "ch": "other"})
        turned = (states.filter("edits = 0 AND depth >= free")
                  .join(others, (F.col("node") == F.col("at")) & (F.col("depth") == F.col("down")) & (F.col("ch") < F.col("other")) & (tests[0] | tests[1] | tests[2]))
                  .select("wid", "child", "depth", "label", F.explode(F.array_compact(lefts)).alias("rest"), F.lit(1).alias("edits"), "free", "leaf", "word"))
        moved = scratch.keep(onward.unionByName(turned).filter("edits = 1 OR NOT leaf")
                             .select("wid", F.col("child").alias("node"), (F.col("depth") + F.length("label")).alias("depth"), "rest", "edits", "free", "leaf", "word"))
        found.append(scratch.keep(moved.filter("leaf AND rest = ''").select("wid", F.col("word").alias("other"))))
        scratch.drop(level, edges)
        level, width = moved, 1
    scratch.drop(level)
    pairs = words.select("wid", F.col("wid").alias("other")).limit(0)
    for part in found:
        pairs = pairs.unionByName(part).unionByName(part.select(F.col("other").alias("wid"), F.col("wid").alias("other")))
    return scratch.step(pairs.distinct(), *found)


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """forms(word, form) -> (word, root): the last word along forms.  Each round doubles the way, and counts grow along it, so rounds are few."""
    ways = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = scratch.keep(ways.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        moved = longer.filter("moved").limit(1).count()
        scratch.drop(ways)
        ways = longer
        if not moved:
            return ways.drop("moved")


def variants(docs: DataFrame, ratio: int = 10, least_length: int = 7, least_count: int = 2, noise: int = 31, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word.  The form is the near word of largest n, if that is `ratio` times the word's n at least;
    the root is where forms lead to."""
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(word_counts(docs, least_length, least_count, noise, doc_id, text).withColumn("wid", F.monotonically_increasing_id()))
    pairs = near_words(words, scratch, least_length)
    named = words.select(F.col("wid").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = pairs.join(named, "other").groupBy("wid").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.join(best, "wid", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    fits = F.col("form_n") >= ratio * F.col("n")
    judged = scratch.step(judged.withColumns({c: F.when(fits, F.col(c)) for c in ("form", "form_n")}), pairs, words)
    roots = _roots(judged.filter("form IS NOT NULL"), scratch)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
