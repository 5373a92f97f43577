"""Quality classifier: supervised subword embeddings.

A text's features are its words and the character n-grams (over UTF-8 bytes) of NGRAMS, hashed into BUCKETS.  Each bucket has a learned
vector; a text is the average of its features' vectors, and a softmax over a linear layer gives the class.  Training is stochastic
gradient descent in numpy on a sample of at most `max_rows` labelled rows, half of each class where there are as many, drawn by hash of
the id and weighted back to the classes' shares.  Because average and layer are linear, scoring needs one number for each
bucket: the model that goes to the tasks has BUCKETS floats whatever the input.

Defined results: null and empty texts have no features and get the score of the bias alone.  Rows with a null id are scored but never
learned from, and count as not held out.  Labels that are null, and ids without a document, are ignored.  An id is one sample, however many
rows repeat it: with its least label and least text.  Very long texts are read as a whole and weigh as much as short ones.  Ties don't arise.  Without labels of both classes every score is the share of class 1 among those there are (0.5 without any).
Other columns are carried; one with the name of a result column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import packed, small_batches, unpacked, whole
from .hashing import Text

BUCKETS, NGRAMS, DIMS = 1 << 17, (3, 4), 16
MAX_ROWS, EPOCHS, RATE, FOLDS, THRESHOLD = 4000, 6, 4.0, 5, 0.3
RESULTS = ["held_out", "score", "predicted"]


def features(data: bytes) -> np.ndarray:
    """Bucket of each feature of a text, repeats included."""
    text = Text(data)
    start, end = text.words()
    hashes = [text.spans(start, end), *[text.grams(n) + np.uint64(n) for n in NGRAMS]]
    return np.concatenate([(h >> np.uint64(40)).astype(np.int64) % BUCKETS for h in hashes])


@dataclass
class Model:
    """One number for each bucket and a bias; the score is the logistic function of their mean."""
    weights: np.ndarray
    bias: float

    def score(self, data: bytes) -> float:
        found = features(data)
        z = self.bias + (float(self.weights[found].mean(dtype=np.float64)) if len(found) else 0.0)
        return float(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], shares: tuple[float, float], seed: int = 11) -> Model:
    """samples (buckets, their shares of the text, class) -> model; `shares` are the classes' shares among all labelled rows."""
    counts = np.bincount([s[2] for s in samples], minlength=2) if samples else np.zeros(2, int)
    if not counts.all():
        p = min(max(shares[1] if sum(shares) else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    layer, bias = np.zeros((2, DIMS), np.float32), np.zeros(2, np.float32)
    weight = np.array(shares) * counts.sum() / counts  # back to the classes' shares
    weight = (weight / weight.max()).astype(np.float32)
    steps, total = 0, EPOCHS * len(samples)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            buckets, share, label = samples[i]
            rate = np.float32(RATE * (1 - steps / total)) * weight[label]
            steps += 1
            hidden = share @ vectors[buckets]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[label] -= 1
            back = layer.T @ error
            layer -= rate * np.outer(error, hidden)
            bias -= np.float32(0.05) * rate * error
            vectors[buckets] -= (rate * share)[:, None] * back
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """The model of the labelled rows outside the held-out fold."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).filter(
        F.col("id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("id")) != 0)).groupBy("id").agg(F.min("label").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [known.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(max_rows // 2) for c in (0, 1)]  # at most max_rows in all
    chosen = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(doc_id).alias("id"), whole(text).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))  # one text an id, chosen in the tasks first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("text"):
                buckets, n = np.unique(features(value.as_py().encode("utf-8")), return_counts=True)
                out.append((buckets.astype(np.int32).tobytes(), (n / max(n.sum(), 1)).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())],
                                             names=["key", "label", "buckets", "shares"])

    rows = rows.select(F.xxhash64("id", "text").alias("key"), "label", "text")
    got = sorted(rows.mapInArrow(run, "key long, label int, buckets binary, shares binary").collect(), key=lambda r: r["key"])  # max_rows rows of at most BUCKETS counts
    samples = [(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32), r["label"]) for r in got]
    all_rows = max(sum(totals.values()), 1)
    return fit([s for s in samples if len(s[0])], (totals.get(0, 0) / all_rows, totals.get(1, 0) / all_rows))


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Each row with its score, the class at THRESHOLD, and whether its id is in the held-out fold."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(packed(docs, carry).alias("row"), F.coalesce(fold(F.col(doc_id)) == 0, F.lit(False)).alias("held_out"), whole(text).alias("text"))
    schema = T.StructType([rows.schema["row"], rows.schema["held_out"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.score(v.as_py().encode("utf-8")) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["row", "held_out", "score"])

    out = rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    return unpacked(out, "row", docs.columns if carry is None else carry, RESULTS)
