"""N-gram Jaccard self-join with signature trees, and the classes that its links form.

A document is the set of its distinct word shingles.  Equal sets are one node from the start.  The join has four steps.

1. Candidate groups without loss.  The hash space is cut into segments, as many as sets of a size class need.  Two sets that link differ
   in at most d shingles, so among the first d + 1 segments in which a set has shingles at least one is equal in the other.  Each set emits
   the hashes of those segments; sets that share one are a group.  Groups of the same members count once.  Hashes of one row are sorted out by themselves,
   before any set meets another.
2. Hubs.  The least set of each group is its hub.  A member whose signature (a bitmap of its shingles, 2 to 4 bits for each) leaves room for a link with
   hubs is joined with the least of them, together with that hub's other such members, in chunks of about CHUNK sets.  That settles groups of near copies.
3. Signature trees.  In each group whose members are not yet one component, sets are the leaves of trees, one for each width of bitmaps, whose nodes hold
   the OR of their bitmaps and the range of their sizes.  Two trees are traversed together from the roots down; a pair of nodes is dropped when its ranges
   of sizes or its greatest possible overlap can't reach the threshold, or when both lie in one component.  Members with a partner that
   is left go on, in groups of those that such pairs connect over all groups, or within one where they are more than CHUNK; the others (documents that share a passage, but not enough) are done without
   their texts having been read.
4. What goes on is joined by trees over the sets themselves, in which each pair that is left is decided, and pairs of one component are passed over.

Links inside a component are found only as far as components need them; no link between components is lost.  A group of more than CHUNK members is
cut in chunks; only pairs of chunks that aren't one component already are joined, which for a group that falls into many components is
quadratic in its chunks.  Tables between the steps are dropped as soon as the next is written.

Defined results: null or empty text and text without words give an empty set, linked with nothing (each such row is its own class).
With fewer words than a shingle has, the whole sequence is the one shingle.  Repeated rows are one node.  Very long texts are one set like any other; what a
task holds is CHUNK texts.  Of several documents of a class the least id names it; ties between rows of one id are of no consequence.  A null id takes no part in the
least id of a class; a class of null ids only has a null `component_id`.  Empty tables give empty results.  Other columns are carried;
one with the name of a result column gives way to it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordworks.session import Scratch

from .base import maybe_in, packed, row_keys, small_batches, unpacked, whole
from .components import components
from .hashing import Text, mix, sequences

CHUNK = 512
BITS = 4096
LEAF = 2  # children a node
RATIO = 2.0
RESULTS = ["n_shingles", "component_id"]
_ONE = np.uint64(1)


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes; A-Z count as a-z."""
    t = Text(text.encode("utf-8").lower())
    start, end = t.words()
    if not len(start):
        return np.zeros(0, np.uint64)
    words = t.spans(start, end)
    return np.unique(sequences(words, min(k, len(words))))


class Segments:
    """Cuts sets into the segments of their size class, for links of a Jaccard similarity of `pct` percent or more."""

    def __init__(self, pct: int, ratio: float = RATIO):
        self.pct, bounds = pct, [1]
        ratio = max(ratio, 100 / pct)
        while bounds[-1] < 1 << 31:
            bounds.append(max(bounds[-1] + 1, math.ceil(bounds[-1] * ratio)))
        self.bounds, self.parts = bounds, []
        for low, high in zip(bounds, bounds[1:]):
            d = self.differing(high - 1, high - 1)
            parts = d + 1
            while parts < 4 * (d + 1) and parts * (1 - math.exp(-low / parts)) < 1.05 * (d + 1):
                parts += max(1, parts // 50)
            self.parts.append(parts)

    def differing(self, n: int, m: int) -> int:
        """Most shingles in which linked sets of n and m can differ."""
        return (100 - self.pct) * (n + m) // (100 + self.pct)

    def keys(self, s: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.zeros(0, np.uint64)
        n, out = len(s), []
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(s ^ np.uint64(0xA0761D6478BD642F)), out=sums[1:])
        own = int(np.searchsorted(self.bounds, n, side="right")) - 1
        most = 100 * n // self.pct  # the largest set that it can link with
        for cls in (own, own + 1):
            if most < self.bounds[cls]:
                continue
            parts, d = self.parts[cls], self.differing(n, min(most, self.bounds[cls + 1] - 1))
            edges = np.searchsorted(s, np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)) if parts > 1 else np.zeros(0, np.int64)
            edges = np.concatenate([[0], edges, [n]])
            full = edges[1:] > edges[:-1]
            hashes = mix(sums[edges[1:]] - sums[edges[:-1]] + mix((np.arange(parts) + (cls << 32)).astype(np.uint64)))
            found = hashes[full][: d + 1]
            out.append(found)
            if len(found) <= d:  # too few: two such sets may have only empty segments in common
                out.append(hashes[~full])
        return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray, pct: int) -> bool:
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= pct * (len(a) + len(b) - both)


def signature(s: np.ndarray, bits: int = 0) -> np.ndarray:
    """Bitmap of a set; its width is the power of two from twice the set's size on, or `bits`."""
    bits = bits or 1 << max(6, (2 * len(s) - 1).bit_length())
    out = np.zeros(bits // 64, np.uint64)
    places = (s % np.uint64(bits)).astype(np.int64)
    np.bitwise_or.at(out, places >> 6, _ONE << (places & 63).astype(np.uint64))
    return out


def folded(bitmap: np.ndarray) -> np.ndarray:
    """The bitmap of the same set at half the width."""
    half = bitmap.shape[-1] // 2
    return bitmap[..., :half] | bitmap[..., half:]


class Tree:
    """A signature tree: level 0 are the sets; a node of level i + 1 has LEAF nodes of level i below it."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, bits: np.ndarray, sets: list[np.ndarray] | None = None):
        self.nodes, self.sets = nodes, sets
        extra = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)  # shingles that share a bit with another
        self.levels = [(bits, sizes, sizes, extra)]
        while len(self.levels[-1][0]) > 1:
            b, low, high, more = self.levels[-1]
            at = np.arange(0, len(b), LEAF)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(more, at)))

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], nodes: list[int]) -> "Tree":
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
        sets = [sets[i] for i in order]
        return cls(np.asarray(nodes)[order], np.array([len(s) for s in sets], np.int64), np.stack([signature(s, BITS) for s in sets]), sets)


def _possible(left: Tree, right: Tree, la: int, lb: int, a: np.ndarray, b: np.ndarray, pct: int) -> np.ndarray:
    """Which pairs of nodes may have a pair of linked sets below them."""
    (bits_a, low_a, high_a, more_a), (bits_b, low_b, high_b, more_b) = left.levels[la], right.levels[lb]
    fits = (100 * high_a[a] >= pct * low_b[b]) & (100 * high_b[b] >= pct * low_a[a])
    common = np.bitwise_count(bits_a[a] & bits_b[b]).sum(1, dtype=np.int64) + np.minimum(more_a[a], more_b[b])
    least_a = np.maximum(low_a[a], -(-pct * low_b[b] // 100))  # smallest sizes of a linked pair
    least_b = np.maximum(low_b[b], -(-pct * low_a[a] // 100))
    return fits & ((100 + pct) * common >= pct * (least_a + least_b))


def leaf_pairs(left: Tree, right: Tree, pct: int, ra: np.ndarray, rb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that may link, of two trees or of a tree with itself, in blocks.  `ra` and `rb` are the components of the leaves; the caller
    may join components between blocks."""
    same = left is right
    stack = [(len(left.levels) - 1, len(right.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]

    def one(component: np.ndarray, level: int, nodes: np.ndarray) -> np.ndarray:
        """The component that all sets below each node are in, or -1."""
        low = high = component
        for _ in range(level):
            at = np.arange(0, len(low), LEAF)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
        return np.where(low == high, low, -1)[nodes]

    while stack:
        la, lb, a, b = stack.pop()
        ca, cb = one(ra, la, a), one(rb, lb, b)
        keep = ~((ca == cb) & (ca != -1)) if la or lb else ra[a] != rb[b]
        a, b = a[keep], b[keep]
        if len(a) > 1024:  # one block after the other, so that memory stays bounded and joined components spare later work
            for i in range(0, len(a), 1024):
                stack.append((la, lb, a[i : i + 1024], b[i : i + 1024]))
            continue
        keep = _possible(left, right, la, lb, a, b, pct)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if la == 0 and lb == 0:
            yield a, b
            continue
        down_a, down_b = la >= lb, lb >= la
        sides = []
        for level, nodes, down, tree in ((la, a, down_a, left), (lb, b, down_b, right)):
            if down and level:
                sides.append((nodes[:, None] * LEAF + np.arange(LEAF), len(tree.levels[level - 1][0])))
            else:
                sides.append((nodes[:, None], len(tree.levels[level][0])))
        (x, nx), (y, ny) = sides
        xx, yy = np.broadcast_arrays(x[:, :, None], y[:, None, :])
        xx, yy = xx.ravel(), yy.ravel()
        na, nb = la - (down_a and la > 0), lb - (down_b and lb > 0)
        keep = (xx < nx) & (yy < ny)
        if same and na == nb:
            keep &= xx <= yy
            if na == 0:
                keep &= xx < yy
        stack.append((na, nb, xx[keep], yy[keep]))


def join_trees(left: Tree, right: Tree, pct: int, root: dict) -> list[tuple[int, int]]:
    """The links between two trees of sets (or of a tree with itself) that join components; `root` is the component of each set so far."""
    same, out = left is right, []
    ra = np.array([root[int(x)] for x in left.nodes])
    rb = ra if same else np.array([root[int(x)] for x in right.nodes])
    for a, b in leaf_pairs(left, right, pct, ra, rb):
        for i, j in zip(a.tolist(), b.tolist()):
            if ra[i] != rb[j] and linked(left.sets[i], right.sets[j], pct):
                out.append((int(left.nodes[i]), int(right.nodes[j])))
                old, new = max(ra[i], rb[j]), min(ra[i], rb[j])
                ra[ra == old] = new
                if not same:
                    rb[rb == old] = new
    root.update(zip(left.nodes.tolist(), ra.tolist()))
    root.update(zip(right.nodes.tolist(), rb.tolist()))
    return out


def with_partners(sides: list[list[tuple[int, int, int, bytes]]], inside: bool, pct: int) -> dict[int, int]:
    """Of sets (node, component, size, bitmap) on one or two sides, those that may link with a set of another component, on their own side
    (`inside`) or on the other, each with the least node that it is connected with by such pairs."""
    trees: list[dict[int, tuple[Tree, np.ndarray]]] = []
    for rows in sides:
        by_width: dict[int, list] = {}
        for row in sorted(rows, key=lambda x: (x[2], x[3])):
            by_width.setdefault(len(row[3]), []).append(row)
        trees.append({w: (Tree(np.array([x[0] for x in part]), np.array([x[2] for x in part], np.int64), np.stack([np.frombuffer(x[3], np.uint64) for x in part])),
                          np.array([x[1] for x in part])) for w, part in by_width.items()})
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def run(left: tuple[Tree, np.ndarray], right: tuple[Tree, np.ndarray]) -> None:
        for a, b in leaf_pairs(left[0], right[0], pct, left[1], right[1]):
            for x, y in zip(left[0].nodes[a].tolist(), right[0].nodes[b].tolist()):
                x, y = top(x), top(y)
                parent[max(x, y)] = min(x, y)

    def narrowed(tree: Tree, steps: int) -> Tree:
        bits, sizes, *_ = tree.levels[0]
        for _ in range(steps):
            bits = folded(bits)
        return Tree(tree.nodes, sizes, bits)

    pairs = [(s, s) for s in range(len(trees)) if inside or len(trees) == 1] + ([(0, 1), (1, 0)] if len(trees) > 1 else [])
    for x, y in pairs:
        for w, tree in trees[x].items():
            for steps in range((x, y) == (1, 0), math.ceil(math.log2(100 / pct)) + 1):  # wider bitmaps are folded to the width of the narrower
                if (wide := trees[y].get(w << steps)) is not None:
                    run(tree, (narrowed(wide[0], steps), wide[1]) if steps else wide)
    return {x: top(x) for x in parent}


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _sets(docs: DataFrame, text: str, k: int, pct: int, carry: list[str] | None, doc_id: str) -> DataFrame:
    """row, id, k1, k2, n, sid (the set as one number; null for an empty set), its signature and the keys of its segments."""
    rows = docs.select(packed(docs, carry).alias("row"), F.col(doc_id).alias("id"), *row_keys(doc_id, text), whole(text).alias("text"))
    schema = T.StructType([*[f for f in rows.schema if f.name != "text"], T.StructField("n", T.LongType()), T.StructField("sid", T.LongType()),
                           T.StructField("bits", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    segments = Segments(pct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid, bits, keys = [], [], [], []
            for value in batch.column("text"):
                s = shingles(value.as_py(), k)
                n.append(len(s))
                with np.errstate(over="ignore"):
                    number = mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]))
                sid.append(int(_signed(number)[0]) if len(s) else None)
                bits.append(signature(s).tobytes() if len(s) else None)
                keys.append(_signed(segments.keys(s)))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            kept = [batch.column(c) for c in ("row", "id", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(bits, pa.binary()), arrays],
                                             names=["row", "id", "k1", "k2", "n", "sid", "bits", "keys"])

    return rows.mapInArrow(run, schema)


def _by_group(groups: DataFrame, handle: Callable[[list], list[tuple]], columns: list[str], schema: str) -> DataFrame:
    """`handle` over the rows of each (g1, g2), one group after the other in a task; the rows come in order of (side, sid)."""
    ordered = groups.repartition("g1", "g2").sortWithinPartitions("g1", "g2", "side", "sid")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group = None, []
        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                if (row.g1, row.g2) != key:
                    out += handle(group) if len(group) > 1 else []
                    key, group = (row.g1, row.g2), []
                group.append(row)
            yield pd.DataFrame(out, columns=columns, dtype="int64")
        if len(group) > 1:
            yield pd.DataFrame(handle(group), columns=columns, dtype="int64")

    return ordered.mapInPandas(run, schema)


def _joined_chunks(groups: DataFrame, k: int, pct: int) -> DataFrame:
    """groups(g1, g2, side, sid, known, text, inside), several rows of a group -> the links (u, v) found in it.  A side is joined with itself when it is
    the only one or `inside` says so; sides 0 and 1 with each other.  `known` is the component so far."""

    def done(group: list) -> list[tuple[int, int]]:
        root = {x.sid: x.known for x in group}
        trees = [Tree.of_sets([shingles(x.text, k) for x in part], [x.sid for x in part]) for side in (0, 1) if (part := [x for x in group if x.side == side])]
        links = [link for tree in trees if group[0].inside or len(trees) == 1 for link in join_trees(tree, tree, pct, root)]
        links += join_trees(trees[0], trees[1], pct, root) if len(trees) > 1 else []
        # as stars, which is all that components need: every set of a joined component with its least set
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for u, v in links:
            a, b = top(u), top(v)
            parent[max(a, b)] = min(a, b)
        return [(x, top(x)) for x in {x for link in links for x in link} if top(x) != x]

    return _by_group(groups, done, ["u", "v"], "u long, v long")


def _active(groups: DataFrame, pct: int) -> DataFrame:
    """groups(g1, g2, side, sid, known, n, bits, inside) -> (g1, g2, part, side, sid, known, inside) of the members whose signature leaves room for a link,
    in smaller groups: members that such pairs connect, of which `part` is the least."""

    def done(group: list) -> list[tuple]:
        sides = [[(x.sid, x.known, x.n, x.bits) for x in part] for side in (0, 1) if (part := [x for x in group if x.side == side])]
        found = with_partners(sides, group[0].inside, pct)
        return [(x.g1, x.g2, found[x.sid], x.side, x.sid, x.known, int(x.inside)) for x in group if x.sid in found]

    columns = ["g1", "g2", "part", "side", "sid", "known", "inside"]
    rows = _by_group(groups, done, columns, ", ".join(f"{c} long" for c in columns))
    return rows.select("g1", F.xxhash64("g2", "part").alias("g2"), "part", "side", "sid", "known", (F.col("inside") == 1).alias("inside"))


def _near_hubs(pairs: DataFrame, pct: int) -> DataFrame:
    """pairs(sid, hub, n, bits, n2, bits2) -> those (sid, hub) whose signatures leave room for a link."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = []
            for x in frame.itertuples(index=False):
                if 100 * x.n >= pct * x.n2 and 100 * x.n2 >= pct * x.n:
                    a, b = np.frombuffer(x.bits, np.uint64), np.frombuffer(x.bits2, np.uint64)
                    while len(a) > len(b):
                        a = folded(a)
                    while len(b) > len(a):
                        b = folded(b)
                    more = min(x.n - int(np.bitwise_count(a).sum()), x.n2 - int(np.bitwise_count(b).sum()))
                    if (100 + pct) * (int(np.bitwise_count(a & b).sum()) + more) >= pct * (x.n + x.n2):
                        kept.append((x.sid, x.hub))
            yield pd.DataFrame(kept, columns=["sid", "hub"], dtype="int64")

    return pairs.mapInPandas(run, "sid long, hub long")


def _classes(docs: DataFrame, k: int, pct: int, doc_id: str, text: str, carry: list[str] | None, scratch: Scratch) -> DataFrame:
    """row, id, k1, k2, n, sid and the component's root of each row; sid and root are null for an empty set."""
    small_batches(docs.sparkSession)
    sets = scratch.keep(_sets(docs, text, k, pct, carry, doc_id))
    keyed = sets.filter("sid IS NOT NULL").select("sid", F.explode("keys").alias("key"))
    # most keys are of one row; they are told apart by the keys alone, and only the rest meets with its sets
    again = scratch.keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key"))
    shared = scratch.step(maybe_in(keyed, "key", again, again.count()).join(again, "key").select("key", "sid").distinct(), again)
    groups = (shared.groupBy("key").agg(F.min("sid").alias("hub"), F.max("sid").alias("last"), F.count(F.lit(1)).alias("sets"), F.bit_xor("sid").alias("mark"))
              .filter("hub <> last"))
    groups = scratch.keep(groups.dropDuplicates(["hub", "last", "sets", "mark"]).select("key", "hub"))
    members = scratch.step(shared.join(groups, "key").select("key", "sid", "hub"), shared)
    own = maybe_in(sets.filter("sid IS NOT NULL").select("sid", "k1", "k2", "n", "bits"), "sid", members.select("sid"), members.count())
    sigs = scratch.keep(own.groupBy("sid").agg(F.min(F.struct("k1", "k2", "n", "bits")).alias("x")).select("sid", "x.*"))
    rows = scratch.step(sets.drop("keys", "bits"), sets, groups)

    def with_texts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """`df` with the text of each sid, and the table of those texts."""
        wanted = scratch.keep(df.select("sid").distinct().join(sigs.select("sid", "k1", "k2"), "sid"))
        texts = maybe_in(docs.select(*row_keys(doc_id, text), whole(text).alias("text")), "k2", wanted.select("k2"), wanted.count())
        texts = scratch.step(texts.join(wanted, ["k1", "k2"]).groupBy("sid").agg(F.first("text").alias("text")), wanted)  # repeated rows once
        return df.join(texts, "sid"), texts

    # hubs
    right = sigs.select(F.col("sid").alias("hub"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    stars = members.filter("sid <> hub").select("sid", "hub").distinct().join(sigs.select("sid", "n", "bits"), "sid").join(right, "hub")
    # of a set's hubs the least: hubs have hubs of their own, and a set in many groups isn't joined in each of them
    stars = scratch.keep(_near_hubs(stars, pct).groupBy("sid").agg(F.min("hub").alias("hub")))
    hubs = scratch.keep(stars.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")))
    chunk = stars.join(hubs, "hub").select(F.col("hub").alias("g1"), F.pmod(F.xxhash64("sid"), "chunks").alias("g2"), "sid")
    chunk = chunk.unionByName(hubs.select(F.col("hub").alias("g1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("g2"), F.col("hub").alias("sid")))
    chunk, texts = with_texts(chunk.withColumns({"side": F.lit(0), "known": F.col("sid"), "inside": F.lit(True)}))
    links = scratch.step(_joined_chunks(chunk, k, pct), stars, hubs, texts)

    # groups that aren't one component yet
    known = components(links, scratch)
    named = scratch.step(members.join(known.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", F.coalesce("root", "sid").alias("known")), members, known)
    sizes = named.groupBy("key").agg(F.min("known").alias("a"), F.max("known").alias("b"), F.count(F.lit(1)).alias("m")).filter("a <> b")
    opened = named.join(sizes.select("key", F.ceil(F.col("m") / CHUNK).alias("chunks")), "key").withColumn("chunk", F.pmod(F.xxhash64("sid"), "chunks"))
    opened = scratch.step(opened, named)
    single = opened.filter("chunks = 1").select(F.col("key").alias("g1"), F.lit(-1).cast("long").alias("g2"), F.lit(0).alias("side"), "sid", "known", F.lit(True).alias("inside"))
    active = scratch.keep(_active(single.unionByName(_chunk_pairs(opened, scratch)).join(sigs.select("sid", "n", "bits"), "sid"), pct))
    # what such pairs connect over all groups: up to CHUNK sets are one group, and a text goes on once however many groups it is in
    joined = components(active.select(F.col("sid").alias("u"), F.col("part").alias("v")), scratch)
    sizes = scratch.keep(joined.groupBy("root").agg(F.count(F.lit(1)).alias("m")))
    active = scratch.step(active.join(joined.join(sizes, "root").withColumnRenamed("node", "sid"), "sid"), active, joined, sizes)
    once = active.filter(F.col("m") <= CHUNK).groupBy("root", "sid").agg(F.min("known").alias("known"))
    once = once.select(F.col("root").alias("g1"), F.lit(-2).cast("long").alias("g2"), F.lit(0).cast("long").alias("side"), "sid", "known", F.lit(True).alias("inside"))
    # larger ones stay in their groups, of which those with the same members left count once
    large = active.filter(F.col("m") > CHUNK).drop("part", "root", "m")
    marks = large.groupBy("g1", "g2").agg(F.sum(F.xxhash64("sid", "side").cast("decimal(38,0)")).alias("mark"), F.min("sid").alias("a"), F.max("sid").alias("b"), F.count(F.lit(1)).alias("m"))
    large = large.join(scratch.keep(marks.dropDuplicates(["mark", "a", "b", "m"]).select("g1", "g2")), ["g1", "g2"])
    last, texts = with_texts(once.unionByName(large))
    links = scratch.step(links.unionByName(_joined_chunks(last, k, pct)), links, opened, active, texts, sigs)
    roots = components(links, scratch)
    return scratch.step(rows.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), rows, links, roots)


def _chunk_pairs(opened: DataFrame, scratch: Scratch) -> DataFrame:
    """Large groups as pairs of chunks, a chunk with itself included, apart from pairs that are one component already."""
    large = opened.filter("chunks > 1")
    chunk = scratch.keep(large.groupBy("key", "chunk").agg(F.min("known").alias("low"), F.max("known").alias("high")))
    other = chunk.select("key", *[F.col(c).alias(f"{c}2") for c in ("chunk", "low", "high")])
    pairs = scratch.keep(chunk.join(other, "key").filter("chunk <= chunk2 AND NOT (low = high AND low2 = high2 AND low = low2)").select("key", "chunk", "chunk2"))
    pair = F.col("chunk") * (1 << 24) + F.col("chunk2")
    sides = [large.join(pairs.select("key", F.col(c).alias("chunk"), pair.alias("g2"), (F.col("chunk") == F.col("chunk2")).alias("same")), ["key", "chunk"])
             .filter(F.lit(side == 0) | ~F.col("same"))
             .select(F.col("key").alias("g1"), "g2", F.lit(side).alias("side"), "sid", "known", F.col("same").alias("inside")) for side, c in enumerate(("chunk", "chunk2"))]
    return sides[0].unionByName(sides[1])


def similar_groups(docs: DataFrame, k: int = 5, pct: int = 80, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Each row with the size of its set and the least id of its component under links of a Jaccard similarity of `pct` percent or more."""
    scratch = Scratch(docs.sparkSession)
    rows = _classes(docs, k, pct, doc_id, text, carry, scratch)
    least = scratch.keep(rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times")).filter("times > 1"))
    out = rows.join(least, "root", "left").withColumn("component_id", F.when(F.col("times").isNull(), F.col("id")).otherwise(F.col("least")))
    return unpacked(out.withColumnRenamed("n", "n_shingles"), "row", docs.columns if carry is None else carry, RESULTS)


def one_of_each(docs: DataFrame, k: int = 5, pct: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that of the least id (without ids, of the least key), with its own columns.  Rows that repeat an id and
    its text are one document: they stay or go together."""
    scratch = Scratch(docs.sparkSession)
    rows = _classes(docs, k, pct, doc_id, text, [], scratch)
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("k2"))
    first = scratch.keep(rows.filter("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("first"), F.max(order).alias("last")).filter("first <> last").select("root", "first"))
    gone = scratch.step(rows.join(first, "root").filter(order != F.col("first")).select("k1", "k2").distinct(), rows, first)
    kept = docs.select(packed(docs).alias("row"), *row_keys(doc_id, text)).join(gone, ["k1", "k2"], "left_anti")
    return unpacked(kept, "row", docs.columns, [])


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL) p
    JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 90 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT r.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""
