"""Hard negatives from embeddings: inner-product search in R-trees packed by sort-tile-recursive, inside score windows.

1. Packing.  Rows are range-partitioned and sorted by (label, first axis, id); runs of one label are tiled by a second and a third axis into pages of
   PAGE rows.  The axes are the coordinates of greatest variance.  A page keeps its minimum bounding box; PAGES_PER_TREE pages in a row are a tree,
   whose upper nodes (FAN children each) join the boxes below them.  Pages are a written table, trees live in a task.
2. Search.  The stated query set, the anchors, goes in blocks against each tree.  For an anchor each box gives an interval of inner products, coordinate by
   coordinate.  A best-first queue takes the box of the greatest upper bound; boxes that lie outside all score windows, or whose upper bound is strictly
   below the k-th score so far, are left out (an equal bound may hide a tie of a smaller id).  The k best of each tree then meet in a ranking
   that Spark limits before its shuffle.
3. Positives are the K_POSITIVE best of an anchor's label, without a window.  Each positive makes a window for negatives of other labels; the windows
   of an anchor share one walk through a tree.

A task holds one tree (TREE_BYTES) and one block of anchors.  Pages are copied to as many groups of anchors as it takes to keep the cluster busy,
and anchors once to each tree.  Scores are integers and exact.

Defined results: rows with a null id, label or vector, or with a null, infinite or undefined component take no part; nor do rows with a component of
LARGEST or more in magnitude, whose scores may not fit a long.  Shorter vectors count as filled up with zeros.  Rows that repeat an id are candidates of their own, but
as an anchor an id counts once, by its least label and vector, and none of its rows is a positive of it.  Ties go to the smaller id.  Very long vectors
make smaller trees.  An empty table, or one without anchors, gives an empty result.  Texts play no part, and no column but the three named is
read, so no other name can clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordworks.session import Scratch

from .base import small_batches

K_POSITIVE, K_NEGATIVE = 5, 10
PAGE, FAN = 128, 16
SLAB = PAGE * 64  # rows that are tiled together
BLOCK = 64  # anchors that go to a tree in one row
TREE_BYTES = 64 << 20  # of components as float32
LARGEST = 1 << 19  # of components before they are scaled by 256
EXACT = 1 << 53  # whole numbers below it are exact as double
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vectors(embeddings: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v): the rows that take part, with components floor(scale * x)."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float(LARGEST), F.lit(False)))
    return (embeddings.filter(fine & F.col(vec_id).isNotNull() & F.col(label).isNotNull())
            .select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v")))


def _matrix(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.int32)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def _summary(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Number of rows, greatest length, and the coordinates by falling variance.  Each task reports its sums; one row per coordinate reaches the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, squares = 0, np.zeros(0), np.zeros(0)
        for frame in frames:
            dim = max(len(sums), max((len(v) for v in frame["v"]), default=0))
            sums, squares = (np.pad(x, (0, dim - len(x))) for x in (sums, squares))
            m = _matrix(frame["v"], dim).astype(np.float64)
            n, sums, squares = n + len(m), sums + m.sum(0), squares + (m * m).sum(0)
        yield pd.DataFrame({"place": np.arange(-1, len(sums)), "s": np.append([float(n)], sums), "q": np.append([0.0], squares)})

    parts = rows.select("v").mapInPandas(run, "place long, s double, q double").groupBy("place").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("place").collect()
    n = int(parts[0]["s"]) if parts else 0
    spread = [r["q"] / n - (r["s"] / n) ** 2 for r in parts[1:]] if n else []
    return n, len(spread), sorted(range(len(spread)), key=lambda i: -spread[i])


def _tiles(m: np.ndarray, axes: list[int]) -> list[np.ndarray]:
    """The rows of one slab as pages: strips along one axis, pages along the next."""
    pages = -(-len(m) // PAGE)
    strips = max(1, round(pages**0.5))
    order = np.argsort(m[:, axes[0]], kind="stable")
    out = []
    for strip in np.array_split(order, strips):
        strip = strip[np.argsort(m[strip, axes[-1]], kind="stable")]
        out += [strip[i : i + PAGE] for i in range(0, len(strip), PAGE)]
    return out


def _pages(rows: DataFrame, parts: int, dim: int, axes: list[int], scratch: Scratch) -> DataFrame:
    """part, seq, label, n, ids, m: the pages in packing order."""
    axes = (axes * 3)[:3]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, label, ids, vectors = 0, None, [], []

        def slab() -> pd.DataFrame:
            nonlocal seq, ids, vectors
            m, number, out = _matrix(vectors, dim), np.array(ids, np.int64), []
            for tile in _tiles(m, axes[1:]) if len(m) else []:
                out.append((part, seq, label, len(tile), number[tile].tobytes(), m[tile].tobytes()))
                seq += 1
            ids, vectors = [], []
            return pd.DataFrame(out, columns=["part", "seq", "label", "n", "ids", "m"])

        for frame in frames:
            for i, own, v, part in zip(frame["id"], frame["label"], frame["v"], frame["part"]):
                if own != label or len(ids) == SLAB:
                    yield slab()
                    label = own
                ids.append(i)
                vectors.append(v)
        if ids:
            yield slab()

    first = F.coalesce(F.get("v", F.lit(axes[0])), F.lit(0)).alias("first")
    placed = rows.select("id", "label", "v", first).repartitionByRange(parts, "label", "first", "id").sortWithinPartitions("label", "first", "id")
    return scratch.keep(placed.select("id", "label", "v", F.spark_partition_id().alias("part")).mapInPandas(run, "part int, seq long, label long, n int, ids binary, m binary"))


class Tree:
    """An R-tree over pages; level 0 are the pages' boxes, a node of level i + 1 has FAN nodes of level i below it."""

    def __init__(self, pages: list[tuple[int, bytes, bytes]], dim: int):
        """pages: (label, ids, components)."""
        self.labels = np.array([p[0] for p in pages])
        self.ids = [np.frombuffer(p[1], np.int64) for p in pages]
        self.rows = [np.frombuffer(p[2], np.int32).reshape(-1, dim) for p in pages]
        self.largest = max((int(np.abs(m).max(initial=0)) for m in self.rows), default=0)
        if self.largest < 1 << 24:
            self.rows = [m.astype(np.float32) for m in self.rows]  # exact
        low = np.array([m.min(0) for m in self.rows], np.float64)
        high = np.array([m.max(0) for m in self.rows], np.float64)
        self.levels = [(low, high, self.labels, self.labels)]
        while len(self.levels[-1][0]) > 1:
            low, high, least, most = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def scores(self, page: int, a: np.ndarray) -> np.ndarray:
        if len(a) * self.largest * int(np.abs(a).max(initial=0)) < EXACT:
            return (self.rows[page].astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
        return self.rows[page].astype(np.int64) @ a.astype(np.int64)

    def search(self, a: np.ndarray, label: int, same: bool, own: int | None, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (low, high) the k best (score, id) of the rows of the label, or of all other labels, apart from the id `own`."""
        best: list[list[tuple[int, int]]] = [[] for _ in windows]
        lows, highs = (np.array(x, np.float64) for x in zip(*windows))
        floor = lows.copy()  # what a score must reach to matter: the window's low end, then the k-th score
        up, down = np.maximum(a, 0).astype(np.float64), np.minimum(a, 0).astype(np.float64)
        exact = len(a) * self.largest * int(np.abs(a).max(initial=0)) < EXACT

        def wanted(level: int, nodes: np.ndarray) -> list[tuple[float, int, int]]:
            low, high, least, most = (x[nodes] for x in self.levels[level])
            fits = (least <= label) & (label <= most) if same else (least != label) | (most != label)
            if not exact:  # such bounds may be off: leave nothing out but by label
                return [(-np.inf, level, int(i)) for i in nodes[fits]]
            upper, lower = high @ up + low @ down, low @ up + high @ down
            fits &= ((upper[:, None] >= floor) & (lower[:, None] <= highs)).any(1)
            return [(-float(u), level, int(i)) for u, i in zip(upper[fits], nodes[fits])]

        queue = wanted(len(self.levels) - 1, np.zeros(1, np.int64))
        while queue:
            bound, level, node = heapq.heappop(queue)
            if -bound < floor.min():
                break
            if level:
                children = np.arange(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1][0])))
                for child in wanted(level - 1, children):
                    heapq.heappush(queue, child)
                continue
            if -bound < np.inf and not (-bound >= floor).any():
                continue
            scores, ids = self.scores(node, a), self.ids[node]
            for w, (least, most) in enumerate(windows):
                hits = np.flatnonzero((scores >= floor[w]) & (scores <= most) & (scores >= least))
                if own is not None:
                    hits = hits[ids[hits] != own]
                if len(hits):
                    merged = best[w] + list(zip(scores[hits].tolist(), ids[hits].tolist()))
                    best[w] = sorted(merged, key=lambda x: (-x[0], x[1]))[:k]
                    if len(best[w]) == k:
                        floor[w] = best[w][-1][0]
        return best


def _blocks(anchors: DataFrame, dim: int, groups: int, scratch: Scratch) -> DataFrame:
    """anchors(id, label, v, found) in rows of BLOCK: grp, seq, ids, m, labels, found."""
    schema = "grp int, seq long, label long, n int, ids binary, m binary, labels binary, found array<array<long>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i in range(0, len(frame), BLOCK):
                x = frame.iloc[i : i + BLOCK]
                out.append((int(x["grp"].iloc[0]), int(x["id"].iloc[0]), 0, len(x), x["id"].to_numpy(np.int64).tobytes(), _matrix(x["v"], dim).tobytes(),
                            x["label"].to_numpy(np.int64).tobytes(), [list(map(int, f)) for f in x["found"]]))
            yield pd.DataFrame(out, columns=["grp", "seq", "label", "n", "ids", "m", "labels", "found"])

    # the group of a row is that of its block's first anchor, which only spreads the work
    grouped = anchors.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    return scratch.keep(grouped.select("grp", "id", "label", "v", "found").mapInPandas(run, schema))


def _searched(trees: DataFrame, blocks: DataFrame, n_trees: int, groups: int, dim: int, negatives: tuple[int, int] | None, k: int) -> DataFrame:
    """The k best of each tree: (anchor_id, positive_id, positive_score, other_id, score); without `negatives` (the window in percent of a
    positive's score) for an anchor's own label, and positive_id is null."""
    empty = [F.lit(None).cast("binary").alias("labels"), F.lit(None).cast("array<array<long>>").alias("found")]
    cell = lambda tree, grp: (tree * groups + grp).alias("cell")
    pages = trees.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        cell(F.col("tree"), F.col("grp")), F.lit(0).alias("kind"), "seq", "label", "ids", "m", *empty)
    asked = blocks.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).select(
        cell(F.col("tree"), F.col("grp")), F.lit(1).alias("kind"), "seq", "label", "ids", "m", "labels", "found")
    dealt = pages.unionByName(asked).repartition(n_trees * groups, "cell").sortWithinPartitions("cell", "kind", "seq")

    def found(tree: Tree, row) -> list[tuple]:
        ids, m, labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.m, np.int32).reshape(-1, dim), np.frombuffer(row.labels, np.int64)
        out = []
        for own, a, label, positives in zip(ids.tolist(), m.astype(np.int64), labels.tolist(), row.found):
            if negatives is None:
                out += [(own, None, None, i, s) for s, i in tree.search(a, label, True, own, [(-(1 << 62), 1 << 62)], k)[0]]
                continue
            low, high = negatives
            pairs = [(int(positives[j]), int(positives[j + 1])) for j in range(0, len(positives), 2)]
            pairs = [(p, s, -(-low * s // 100), high * s // 100) for p, s in pairs if low * s <= high * s]
            if pairs:
                best = tree.search(a, label, False, None, [x[2:] for x in pairs], k)
                out += [(own, p, s, i, score) for (p, s, _, _), rows in zip(pairs, best) for score, i in rows]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pages, tree = None, [], None
        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.cell != at:
                    at, pages, tree = row.cell, [], None
                if row.kind == 0:
                    pages.append((row.label, row.ids, row.m))
                    continue
                if pages:
                    tree, pages = Tree(pages, dim), []
                if tree is not None and len(out := found(tree, row)):
                    yield pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "other_id", "score"]).astype("Int64")

    return dealt.mapInPandas(run, "anchor_id long, positive_id long, positive_score long, other_id long, score long")


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("other_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column | str = "id % 100 = 0", window: tuple[int, int] = (30, 90), positives: int = K_POSITIVE, negatives: int = K_NEGATIVE) -> DataFrame:
    """rows(id, label, v) as of `whole_vectors` -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  `anchors` says which rows are
    anchors; `window` bounds a negative's score in percent of the positive's."""
    spark = rows.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    asked = rows.filter(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    asked = scratch.keep(asked)
    n, dim, axes = _summary(rows)
    if not n or not dim or not asked.limit(1).count():
        return spark.createDataFrame([], RESULT)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_tree = max(1, TREE_BYTES // (4 * dim * PAGE))  # pages
    pages = _pages(rows, width, dim, axes, scratch)
    # pages are numbered through, so that trees don't depend on how many partitions there are; one count a partition reaches the driver
    counts, before = {r["part"]: r["count"] for r in pages.groupBy("part").count().collect()}, {}
    total = 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    starts = spark.createDataFrame(list(before.items()), "part int, start long")
    n_trees = -(-total // per_tree)
    trees = pages.join(F.broadcast(starts), "part").withColumn("seq", F.col("start") + F.col("seq")).withColumn("tree", (F.col("seq") / per_tree).cast("int"))
    trees = scratch.step(trees.select("tree", "seq", "label", "ids", "m"), pages)
    groups = max(1, -(-width // n_trees))
    blocks = _blocks(asked.withColumn("found", F.array().cast("array<long>")), dim, groups, scratch)
    near = scratch.keep(_first(_searched(trees, blocks, n_trees, groups, dim, None, positives), ["anchor_id"], positives))
    lists = near.groupBy("anchor_id").agg(F.flatten(F.collect_list(F.array("other_id", "score"))).alias("found"))  # `positives` pairs at most
    with_windows = asked.join(lists, asked["id"] == lists["anchor_id"]).select("id", "label", "v", "found")
    blocks = _blocks(with_windows, dim, groups, scratch)
    hard = _first(_searched(trees, blocks, n_trees, groups, dim, window, negatives), ["anchor_id", "positive_id"], negatives)
    return hard.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


OP13_SQL = """
WITH rows AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM rows a JOIN rows b ON a.id <> b.id WHERE a.id % 100 = 0),
positives AS (SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other)::INT AS rank, s.other AS negative_id,
    p.score AS positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10"""
