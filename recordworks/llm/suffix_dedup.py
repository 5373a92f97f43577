"""Suffix-array dedup of bytes by threshold-bounded interval expansion.

Every byte that a `length`-byte string covers is removed when that string also starts anywhere else, in any document.

1. Anchors.  A window of `length` bytes has one anchor: the first of its ANCHOR-byte grams with the least hash.  Equal windows have equal
   anchors at equal places, so windows with different anchor hashes never need to be compared.  A piece is the text under all
   consecutive windows of one anchor.  Pieces travel as hashes: (anchor hash, piece hash, place).
2. Equal pieces.  All windows of a piece that occurs twice are repeats.  Such pieces need no text.
3. Different pieces of one anchor.  One text of each goes to a bin with the others of its anchor.  There a Burrows-Wheeler transform of the
   bin is made, and the intervals of its suffixes are expanded backward, breadth first: the intervals of the strings of l bytes give
   those of l + 1 bytes, and the bounds that appear in round l are the places where neighbours share exactly l bytes.  The
   rounds stop at `length`; what has no bound by then lies between suffixes that share `length` bytes or more.
   Equal windows have their anchor at the same place, so before that pieces are laid over each other at the anchor: windows whose core, some STEP bytes
   shorter, no other piece has can't be repeats and are cut off, which spares the bins most of the text and loses nothing.
   An anchor with more than MOST_PIECES different pieces (a passage that very many documents share) doesn't go to one bin: its
   windows are counted by hash, combined before the shuffle, which is exact as well.

Defined results: null text counts as empty, loses nothing and keeps the empty string (its SHA-256).  Texts shorter than `length` lose
nothing.  Rows that repeat an id and its text are repeats of each other like any other two rows.  Empty tables give empty results.  Other columns
are carried; one with the name of a result column gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordworks.session import settled

from .base import flagged, maybe_in, packed, row_keys, small_batches, unpacked, whole
from .hashing import Text

ANCHOR = 64
CHUNK = 1 << 19  # places that are handled at once; less than 2 ** 20
MOST_PIECES = 256
BIN_BYTES = 2 << 20
TASK_BYTES = 4 << 20  # of pieces, before what no other piece has is cut off
RESULTS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def pieces(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, piece hash, first window, number of windows) of each piece of a text."""
    if len(data) < length:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    text = Text(data)
    grams = text.grams(ANCHOR)
    width = length - ANCHOR + 1  # grams in a window
    windows = len(data) - length + 1
    anchor = np.zeros(windows, np.int64)
    for base in range(0, windows, CHUNK):  # hash above, place below: the least is the first of the least hash
        part = grams[base : base + CHUNK + width - 1]
        key = (part & ~np.uint64((1 << 20) - 1)) | np.arange(len(part), dtype=np.uint64)
        pad = -len(key) % width
        rows = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - width + 1
        least = np.minimum(after[:n], before[width - 1 : width - 1 + n])
        anchor[base : base + n] = (least & np.uint64((1 << 20) - 1)).astype(np.int64) + base
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.concatenate([first, [windows]]))
    return grams[anchor[first]], text.spans(first, first + count + length - 1), first, count


def suffix_order(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes by their first `length` bytes or more, place of each suffix among them).  Eight bytes are sorted at once, and then groups that
    are still equal by twice as many bytes each round."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)

    def group(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Ranks for suffixes at sorted slots with sorted keys; the slots of groups of two and more."""
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        alone = fresh & np.concatenate([fresh[1:], [True]])
        return slots[~alone]

    slots, step = group(np.arange(n), key[order]), 8
    while step < length and len(slots):
        at = order[slots]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key)
        order[slots] = at[by]
        slots, step = group(slots, key[by]), step * 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


SMALL = 48  # intervals up to this size are expanded suffix by suffix, larger ones symbol by symbol


def unshared(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, whether neighbours i - 1 and i in it share fewer than `length` bytes)."""
    order, place = suffix_order(data, length)
    n = len(data)
    before, back = data[order - 1], place[order - 1]  # the transform, and where the suffix with that symbol in front is
    symbols = np.unique(data)
    of = {int(c): np.flatnonzero(before == c) for c in symbols}
    start = {int(c): int((data < c).sum()) for c in symbols}
    bound = np.zeros(n + 1, bool)
    bound[0] = bound[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)  # the interval of the empty string
    for _ in range(length):
        large = high - low > SMALL
        lows, highs = [], []
        for c in symbols.tolist() if large.any() else ():  # backward: the interval of c + w from that of w
            a, b = np.searchsorted(of[c], low[large]), np.searchsorted(of[c], high[large])
            some = b > a
            lows.append(a[some] + start[c])
            highs.append(b[some] + start[c])
        if not large.all():
            a, size = low[~large], (high - low)[~large]
            owner = np.repeat(np.arange(len(a)), size)
            slot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
            key = owner * 256 + before[slot]
            by = np.argsort(key, kind="stable")
            key = key[by]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lows.append(np.minimum.reduceat(back[slot][by], first))
            highs.append(lows[-1] + np.diff(np.concatenate([first, [len(key)]])))
        low, high = np.concatenate(lows), np.concatenate(highs)
        fresh = ~bound[high]  # an interval that ends where a shorter string's interval ended brings nothing new
        low, high = low[fresh], high[fresh]
        bound[high] = True
        if not len(low):
            break
    return order, bound[:n]


def repeated_in(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, the starts of its `length`-byte windows that occur in the texts more than once."""
    joined = np.frombuffer(b"".join([t + b"\xff" for t in texts]), np.uint8)  # FF is in no UTF-8 text, so no window of one has it
    order, apart = unshared(joined, length)
    shared = ~apart
    shared[:-1] |= ~apart[1:]
    places = np.sort(order[shared])
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    out = []
    for i, t in enumerate(texts):
        own = places[np.searchsorted(places, edges[i]) : np.searchsorted(places, edges[i + 1])] - edges[i]
        out.append(own[own <= len(t) - length])
    return out


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places as runs (first, one after the last)."""
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1] + 1]))
    last = np.concatenate([first[1:] - 1, [len(places) - 1]])
    return places[first], places[last] + 1


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _pieces_of(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pieces(value.as_py().encode("utf-8"), length) for value in batch.column("text")]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            h, p, s, n = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([_signed(h), _signed(p), batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array(s), pa.array(n)], names=["h", "p", "k1", "k2", "s", "n"])

    return docs.mapInArrow(run, "h long, p long, k1 long, k2 long, s long, n long")


def _cut_pieces(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted(h, p, k1, k2, s, n) -> (h, p, bytes) cut out of the texts.  Only rows that may have a wanted piece are shuffled."""
    lists = settled(wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "p", "s", "n")).alias("wanted")))  # at most the pieces of one document
    texts = maybe_in(docs, "k2", lists.select("k2"), lists.count()).dropDuplicates(["k1", "k2"]).join(lists, ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, want in zip(batch.column("text"), batch.column("wanted")):
                data = value.as_py().encode("utf-8")
                out += [(x["h"], x["p"], data[x["s"] : x["s"] + x["n"] + length - 1]) for x in want.as_py()]
            for at in range(0, len(out), 4096):
                h, p, b = zip(*out[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(p, pa.int64()), pa.array(b, pa.binary())], names=["h", "p", "bytes"])

    return texts.select("text", "wanted").mapInArrow(run, "h long, p long, bytes binary")


STEP = 21


def cores_shared(texts: list[bytes], anchor: int, length: int) -> list[tuple[int, int]]:
    """For each of the different pieces of one anchor (its hash as a signed number) the range of bytes that holds all windows which another piece may
    have too; an empty one for none.  A window with l bytes in front of the anchor has at least STEP * (l // STEP) there, and behind it what
    all windows of that class have: this core is what pieces are compared by."""
    grams = Text(b"".join(texts)).grams(ANCHOR).view(np.int64)
    places, edges = np.flatnonzero(grams == anchor), np.cumsum([0] + [len(t) for t in texts])
    found = np.searchsorted(places, edges[:-1])
    at = [int(places[i] - a) if i < len(places) else -1 for i, a in zip(found.tolist(), edges.tolist())]
    low, high = [-1] * len(texts), [-1] * len(texts)
    spare = length - ANCHOR
    for left in range(0, spare + 1, STEP):
        right, seen = max(0, spare - left - STEP + 1) + ANCHOR, {}
        for i, (data, o) in enumerate(zip(texts, at)):
            if left <= o and o + right <= len(data):
                first = seen.setdefault(data[o - left : o + right], i)
                if first != i:
                    for k in (first, i):
                        low[k], high[k] = left if low[k] < 0 else low[k], left
    out = []
    for data, o, a, b in zip(texts, at, low, high):
        start, end = max(0, o - b - STEP + 1), min(len(data), o - a + length)
        out.append((0, 0) if a < 0 or end - start < length else (start, end))
    return out


def _binned(cut: DataFrame, length: int, bytes_in_all: int) -> DataFrame:
    """(h, p, bytes) -> (h, p, a, b): runs of windows that occur in another piece of the same anchor.  Pieces of an anchor follow each other;
    a bin ends at the first change of anchor after BIN_BYTES.  There are as many tasks as the pieces need: what a task sorts and expands does not
    grow with the input, and an anchor has at most MOST_PIECES pieces of less than twice `length` bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []  # (h, p, first byte, bytes)
        group: list[tuple[int, int, bytes]] = []  # of one anchor, at most MOST_PIECES
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for (h, p, start, _), at in zip(held, repeated_in([x[3] for x in held], length)):
                if len(at):
                    rows += [(h, p, a, b) for a, b in zip(*(x.tolist() for x in _runs(at + start)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["h", "p", "a", "b"])

        def close() -> int:
            """The group's part of the bin; its size."""
            before = len(held)
            for (h, p, data), (start, end) in zip(group, cores_shared([x[2] for x in group], group[0][0], length)):
                if end:
                    held.append((h, p, start, data[start:end]))
            return sum(len(x[3]) for x in held[before:])

        for batch in batches:
            for h, p, data in zip(*(batch.column(c).to_pylist() for c in ("h", "p", "bytes"))):
                if group and h != group[0][0]:
                    size += close()
                    group = []
                    if size >= BIN_BYTES:
                        yield from flush()
                        held, size = [], 0
                group.append((h, p, data))
        if group:
            close()
        if held:
            yield from flush()

    return cut.repartition(bytes_in_all // TASK_BYTES + 1, "h").sortWithinPartitions("h", "p").mapInArrow(run, "h long, p long, a long, b long")


_ENTRY = np.dtype([("w", "<u8"), ("h", "<i8"), ("p", "<i8"), ("a", "<i8")])
WINDOWS_PER_TASK = 500_000


def _hashed_windows(cut: DataFrame, length: int, pieces_in_all: int) -> DataFrame:
    """The same by comparing window hashes, for anchors with very many different pieces.  Windows that a batch of pieces has twice are told at
    once; one of each hash travels, packed with the others of its range of hashes, to where ranges of all batches meet."""
    parts = max(int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions")), pieces_in_all * length // WINDOWS_PER_TASK)
    names = ["range", "entries", "h", "p", "a", "b"]

    def rows(ranges: list, packed_entries: list, found: np.ndarray) -> pa.RecordBatch:
        """Packed entries, then windows found to be repeated, as runs of each piece."""
        found = np.sort(found, order=["h", "p", "a"])
        fresh = np.flatnonzero(np.concatenate([[True], (found["h"][1:] != found["h"][:-1]) | (found["p"][1:] != found["p"][:-1]) | (found["a"][1:] != found["a"][:-1] + 1)])) if len(found) else np.zeros(0, np.int64)
        last = np.concatenate([fresh[1:], [len(found)]])[: len(fresh)] - 1
        none, k = [None] * len(ranges), len(fresh)
        longs = [pa.array(none + x.tolist(), pa.int64()) for x in (found["h"][fresh], found["p"][fresh], found["a"][fresh], found["a"][last] + 1)]
        return pa.RecordBatch.from_arrays([pa.array(ranges + [None] * k, pa.int64()), pa.array(packed_entries + [None] * k, pa.binary()), *longs], names=names)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for h, p, data in zip(*(batch.column(c).to_pylist() for c in ("h", "p", "bytes"))):
                grams = Text(data).grams(length)
                entries = np.empty(len(grams), _ENTRY)
                entries["w"], entries["h"], entries["p"], entries["a"] = grams, h, p, np.arange(len(grams))
                lists.append(entries)
            entries = np.concatenate(lists) if lists else np.empty(0, _ENTRY)
            entries = entries[np.argsort(entries["w"], kind="stable")]
            repeated = _repeated(entries["w"])
            single = entries[np.flatnonzero(np.concatenate([[True], entries["w"][1:] != entries["w"][:-1]]))] if len(entries) else entries
            edges = np.searchsorted(single["w"], np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)) if parts > 1 else np.zeros(0, np.int64)
            cuts = np.concatenate([[0], edges, [len(single)]])
            used = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            yield rows(used, [single[cuts[i] : cuts[i + 1]].tobytes() for i in used], entries[repeated])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = np.concatenate([np.empty(0, _ENTRY), *[np.frombuffer(x.as_py(), _ENTRY) for batch in batches for x in batch.column("entries")]])
        entries = entries[np.argsort(entries["w"], kind="stable")]
        yield rows([], [], entries[_repeated(entries["w"])])

    schema = "range long, entries binary, h long, p long, a long, b long"
    told = settled(cut.mapInArrow(local, schema))
    others = told.filter("range IS NOT NULL").repartition(parts, "range").mapInArrow(met, schema)
    return told.filter("range IS NULL").unionByName(others).select("h", "p", "a", "b")


def _repeated(ordered: np.ndarray) -> np.ndarray:
    """Which of the sorted values occur more than once."""
    same = np.concatenate([[False], ordered[1:] == ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
    return same | np.concatenate([same[1:], [False]]) if len(ordered) else same


def repeated_spans(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, spans): the byte spans of each row that repeated strings cover, in no order and overlapping."""
    texts = docs.select(*row_keys(doc_id, text), whole(text).alias("text"))
    found = settled(_pieces_of(texts, length))
    anchors = settled(found.groupBy("h").agg(F.count(F.lit(1)).alias("times"), F.min("p").alias("p0"), F.max("p").alias("p1"))
                      .filter("times > 1").select("h", (F.col("p0") != F.col("p1")).alias("differ")))
    rows = settled(found.join(anchors, "h"))
    classes = settled(rows.groupBy("h", "p").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n"), F.first("differ").alias("differ"), F.min(F.struct("k1", "k2", "s")).alias("at")))
    kinds = settled(classes.filter("differ").groupBy("h").agg(F.count(F.lit(1)).alias("kinds")))
    wanted = settled(classes.filter("differ").join(kinds, "h").select("h", "p", "kinds", "at.k1", "at.k2", "at.s", "n"))
    marks = classes.filter("times > 1").select("h", "p", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    few = wanted.filter(F.col("kinds") <= MOST_PIECES).drop("kinds")
    if size := few.agg(F.sum(F.col("n") + (length - 1))).first()[0]:
        marks = marks.unionByName(_binned(_cut_pieces(texts, few, length), length, size))
    many = wanted.filter(F.col("kinds") > MOST_PIECES).drop("kinds")
    if how_many := many.count():
        marks = marks.unionByName(_hashed_windows(_cut_pieces(texts, many, length), length, how_many))
    marks = settled(marks)
    spans = rows.join(marks, ["h", "p"]).select("k1", "k2", F.struct((F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b") + (length - 1)).alias("b")).alias("span"))
    return settled(spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans")))  # at most the windows of one document


def without_repeats(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, with_bytes: bool = False) -> DataFrame:
    """Each row with its bytes, how many of them are removed, in how many runs, and the SHA-256 of the others; `with_bytes` adds these as
    `kept_bytes` (a cut can fall inside a character)."""
    small_batches(docs.sparkSession)
    spans = repeated_spans(docs, length, doc_id, text)
    rows = docs.select(packed(docs, carry).alias("row"), *row_keys(doc_id, text), whole(text).alias("text"))
    rows = flagged(rows, "k2", spans.select("k2"), spans.count())
    intact = rows.filter("NOT _maybe").select("row", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    rows = intact.unionByName(rows.filter("_maybe").join(spans, ["k1", "k2"], "left").select("row", "text", "spans"))
    results = RESULTS + ["kept_bytes"] * with_bytes
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.LongType()) for c in RESULTS[:3]], T.StructField("kept_sha256", T.StringType())]
                          + [T.StructField("kept_bytes", T.BinaryType())] * with_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, found in zip(batch.column("text"), batch.column("spans")):
                data = value.as_py().encode("utf-8")
                kept, at, runs, removed = [], 0, 0, 0
                last = -1
                for x in sorted((s["a"], s["b"]) for s in found.as_py()) if found.is_valid else ():
                    if x[0] > last:
                        kept.append(data[at : x[0]])
                        runs += 1
                        removed += x[1] - x[0]
                        at = last = x[1]
                    elif x[1] > last:
                        removed += x[1] - last
                        at = last = x[1]
                rest = b"".join(kept) + data[at:]
                out.append((len(data), removed, runs, hashlib.sha256(rest).hexdigest(), rest))
            n, removed, runs, digests, rest = zip(*out) if out else ((),) * 5
            columns = [batch.column("row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(rest, pa.binary())] * with_bytes, names=["row", *results])

    return unpacked(rows.mapInArrow(run, schema), "row", docs.columns if carry is None else carry, results)
