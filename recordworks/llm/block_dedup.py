"""Substring deduplication with fixed-block anchors: word runs that an earlier document has are removed.

Reference blocks are the non-overlapping runs of BLOCK words at the places 0, BLOCK, 2 * BLOCK, ... of every document.  A window of
`window` >= 2 * BLOCK - 1 words contains at least one whole block of the document it is taken from, so whatever repeats must
hit a block somewhere.

1. Index and probe.  Every rolling run of BLOCK words is hashed to a cell.  Two bits per cell say that a reference block lies there, and
   that two or more rolling runs do.  The two bitmaps have a fixed size of `2 ** cell_bits` bits each.
2. Extend.  A hit is a rolling run in a cell with both bits; it is extended to the left and to the right while the runs repeat.  What
   is shorter than `window` words is no candidate.  All windows of the maximal runs go on, each as a 64-bit hash of its words.
3. Decide.  The least document of each window is a minimum that is combined before the shuffle.  A window whose least document is
   smaller than its own is removed.

Full bitmaps let more windows through to step 3; the result is the same.

Defined results: null text counts as empty; texts without words keep the empty string (its SHA-256).  A document with a null id is later
than all others, and among such documents nothing is removed.  Rows that repeat an id are one document in order, so they don't remove each
other's words.  Empty tables give empty results.  Other columns are carried; one with the name of a result column gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordworks.session import settled

from .base import flagged, packed, row_keys, small_batches, unpacked, whole
from .hashing import Text, sequences

BLOCK = 7
CELL_BITS = 28
RESULTS = ["n_words", "n_removed", "kept_sha256"]
LATE = (1 << 63) - 1


def _words(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    data = text.encode("utf-8")
    t = Text(data)
    start, end = t.words()
    return data, start, end, t.spans(start, end)


SLICE = 1 << 12  # bytes of a bitmap that travel together


def _set_bits(plane: np.ndarray, cells: np.ndarray) -> None:
    """Sets the bits of sorted distinct cells."""
    at = cells >> 3
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    plane[at[first]] |= np.bitwise_or.reduceat((1 << (cells & 7)).astype(np.uint8), first)


def _is_set(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def _cells(words: np.ndarray, cell_bits: int) -> np.ndarray:
    return (sequences(words, BLOCK) >> np.uint64(64 - cell_bits)).astype(np.int64)


def _bits(texts: DataFrame, cell_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bitmaps: cells with two rolling runs or more, and cells with a reference block.  Their size is fixed, so they may come to
    the driver and go to the workers.  Each task fills bitmaps of its own and sends their slices; equal slices are added up in one place."""
    size = 1 << (cell_bits - 3)
    names = ["part", "once", "twice", "block"]

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, block = (np.zeros(size, np.uint8) for _ in range(3))
        for batch in batches:
            runs = [_cells(_words(value.as_py())[3], cell_bits) for value in batch.column("text")]
            cells, times = np.unique(np.concatenate(runs), return_counts=True) if runs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if len(cells):
                again = cells[(times > 1) | _is_set(once, cells)]
                if len(again):
                    _set_bits(twice, again)
                _set_bits(once, cells)
                _set_bits(block, np.unique(np.concatenate([r[::BLOCK] for r in runs])))
        used = np.flatnonzero(once.reshape(-1, SLICE).any(1))
        for at in range(0, len(used), 256):
            parts = used[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), *[pa.array([x[p * SLICE : (p + 1) * SLICE].tobytes() for p in parts.tolist()], pa.binary()) for x in (once, twice, block)]], names=names)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, *planes in zip(*[batch.column(n).to_pylist() for n in names]):
                once, twice, block = (np.frombuffer(x, np.uint8) for x in planes)
                if part in held:
                    old = held[part]
                    old[1] |= twice | (old[0] & once)
                    old[0] |= once
                    old[2] |= block
                else:
                    held[part] = np.stack([once, twice, block])
        for part, (_, twice, block) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([twice.tobytes()], pa.binary()), pa.array([block.tobytes()], pa.binary())], names=["part", "twice", "block"])

    slices = texts.select("text").mapInArrow(filled, "part long, once binary, twice binary, block binary")
    merged = settled(slices.repartition("part").mapInArrow(added, "part long, twice binary, block binary"))
    twice, block = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    for row in merged.toLocalIterator():
        at = slice(row["part"] * SLICE, (row["part"] + 1) * SLICE)
        twice[at], block[at] = np.frombuffer(row["twice"], np.uint8), np.frombuffer(row["block"], np.uint8)
    return twice, block


def candidates(words: np.ndarray, twice: np.ndarray, block: np.ndarray, window: int, cell_bits: int) -> np.ndarray:
    """Starts of the windows that lie in a maximal run of repeated BLOCK-word runs with a hit in it."""
    cells = _cells(words, cell_bits)
    if len(words) < window:
        return np.zeros(0, np.int64)
    repeated = _is_set(twice, cells)
    hit = repeated & _is_set(block, cells)
    inside = window - BLOCK + 1  # rolling runs in a window
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    r, h = sums(repeated), sums(hit)
    return np.flatnonzero((r[inside:] - r[:-inside] == inside) & (h[inside:] - h[:-inside] > 0))


def without_repeats(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None,
                    cell_bits: int = CELL_BITS, with_text: bool = False) -> DataFrame:
    """Each row with its number of words, how many of them are removed, and the SHA-256 of the others joined by spaces; `with_text` adds
    these as `kept_text`."""
    if window < 2 * BLOCK - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(_place(doc_id), row_keys(doc_id, text)[1], whole(text).alias("text"))
    bits = spark.sparkContext.broadcast(_bits(keyed, cell_bits))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, block = bits.value
        for batch in batches:
            hashes, rows = [], []
            for i, value in enumerate(batch.column("text")):
                words = _words(value.as_py())[3]
                at = candidates(words, twice, block, window, cell_bits)
                if len(at):
                    hashes.append(np.unique(sequences(words, window)[at]))
                    rows.append(np.full(len(hashes[-1]), i))
            if hashes:
                rows = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), *[batch.column(c).take(rows) for c in ("place", "k2")]], names=["h", "place", "k2"])

    found = settled(keyed.mapInArrow(windows, "h long, place long, k2 long"))
    first = settled(found.groupBy("h").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first < last").select("h", "first"))
    late = found.join(first, "h").filter("place > first")
    gone = settled(late.groupBy("place", "k2").agg(F.collect_set("h").alias("gone")))  # at most the windows of one document
    return _cut(docs, gone, window, doc_id, text, carry, with_text)


def _place(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LATE)).alias("place")


def _cut(docs: DataFrame, gone: DataFrame, window: int, doc_id: str, text: str, carry: list[str] | None, with_text: bool) -> DataFrame:
    """Only rows that may lose words are shuffled to their windows."""
    rows = docs.select(packed(docs, carry).alias("row"), _place(doc_id), row_keys(doc_id, text)[1], whole(text).alias("text"))
    rows = flagged(rows, "k2", gone.select("k2"), gone.count())
    whole_rows = rows.filter("NOT _maybe").select("row", "text", F.lit(None).cast("array<bigint>").alias("gone"))
    rows = whole_rows.unionByName(rows.filter("_maybe").join(gone, ["place", "k2"], "left").select("row", "text", "gone"))
    results = RESULTS + ["kept_text"] * with_text
    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
                          + [T.StructField("kept_text", T.StringType())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests, texts = [], [], [], []
            for value, hashes in zip(batch.column("text"), batch.column("gone")):
                if hashes.is_valid:
                    data, start, end, words = _words(value.as_py())
                    bad = np.isin(sequences(words, window).view(np.int64), hashes.values.to_numpy())
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.flatnonzero(bad)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    kept = b" ".join([data[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist())])
                    counts.append(len(words))
                    removed.append(int((~keep).sum()))
                else:
                    words = value.as_py().encode("utf-8").translate(_TO_SPACE).split(b" ")
                    words = [w for w in words if w]
                    kept = b" ".join(words)
                    counts.append(len(words))
                    removed.append(0)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8"))
            columns = [batch.column("row"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=["row", *results])

    return unpacked(rows.mapInArrow(run, schema), "row", docs.columns if carry is None else carry, results)


_TO_SPACE = bytes(32 if 9 <= i <= 13 else i for i in range(256))

OP9_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS p, unnest(list_transform(range(1, len(words) - 11), lambda i: md5(array_to_string(words[i:i + 12], ' ')))) AS h
    FROM w WHERE len(words) >= 13),
b AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first FROM s) WHERE doc_id > first),
g AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(p, p + 13))))) AS gone FROM b GROUP BY doc_id),
k AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, words, gone FROM w LEFT JOIN g USING (doc_id)),
u AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, gone, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM k) x
    WHERE gone IS NULL OR NOT list_contains(gone, i) GROUP BY doc_id)
SELECT k.doc_id, n_words, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN u USING (doc_id)"""
