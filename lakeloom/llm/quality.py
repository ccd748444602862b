"""Quality classifier of supervised subword embeddings.

Every word, every pair of neighbouring words and every run of 3 or 4 bytes inside a word (marked when it begins or ends the
word) is hashed to a bucket that has a learned vector. A document is the mean of its features' vectors; a softmax over that mean gives the classes. Vectors and
output weights are learned together by stochastic gradient descent in numpy, on a bounded sample of labelled rows. As the
document vector is a mean, a trained model scores a document by the mean of one number per bucket; only these go to the workers.

Null and empty texts have no features and get the score of the bias alone. Without labelled rows of both classes the score is
the share of label 1 (0.5 without any). Null doc_id: in no training fold. Several labels of one id: the least counts; several texts:
the one with the least hash. Very long texts: read whole. Empty table: no rows. Repeated rows: scored each.
Other columns, lang and source among them, are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

BUCKETS = 1 << 18
WIDTHS = (3, 4)
#: Labelled rows that one training reads at most, picked by a hash of the id.
TRAIN_ROWS = 3000
DIMENSION, EPOCHS, RATE = 8, 6, 0.4
#: Tasks that make the features of training rows.
TASKS = 32
#: Updates that one training makes at least; few rows are gone through more often.
STEPS = 6000

_AGAIN = np.uint64(0xB5297A4D3C6EF372)


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and row of each word and subword."""
    begin, end, row, hashed = common.words(raw, off)
    n = len(raw)
    # word pairs: a word after itself is one feature, whatever the word
    pair = np.flatnonzero(row[1:] == row[:-1]) + 1
    both = common.mix(hashed[pair] * np.uint64(3) + hashed[pair - 1])
    both[hashed[pair] == hashed[pair - 1]] = _AGAIN
    buckets, rows = [hashed, both], [row, row[pair]]
    if n:
        p, q = common.powers(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(common._TABLE[raw] * p, out=total[1:])
        length = end - begin
        for w in WIDTHS:
            has = length >= w
            count = np.where(has, length - w + 1, 0)
            first = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            edge = np.zeros(n, np.uint64)
            edge[begin] = 1
            h = (total[first + w] - total[first]) * q[first] + edge[first] * np.uint64(0x51ED27)
            last = np.zeros(n, np.uint64)
            last[end - 1] = np.uint64(0xA24BAE)
            buckets.append((h + last[first + w - 1] + np.uint64(w)) * np.uint64(0xFF51AFD7ED558CCD))
            rows.append(np.repeat(row, count))
    bucket = np.concatenate(buckets) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return bucket.astype(np.int32), np.concatenate(rows)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and how often each occurs."""
    bucket, _ = features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    found, n = np.unique(bucket, return_counts=True)
    return found, n


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> tuple[np.ndarray, float]:
    """Learns from (buckets, times, label). Gives a number per bucket and the bias; their mean and sum is the log-odds of label 1."""
    rng = np.random.default_rng(seed)
    y = np.array([label for _, _, label in rows])
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSION), np.float32), np.log(np.array([1 - y.mean(), y.mean()]))
    epochs = max(EPOCHS, -(-STEPS // len(rows)))
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            found, times, label = rows[i]
            share = times / np.float32(max(1, int(times.sum())))
            rate = RATE * (1 - step / steps)
            step += 1
            v = vectors[found]
            mean = share @ v
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            down = p @ out
            out -= (rate * p[:, None] * mean[None, :]).astype(np.float32)
            bias -= rate * p * 0.1
            # each feature's share of the mean, scaled so that long documents move their vectors as far as short ones
            vectors[found] = v - (rate * len(found) ** 0.5 * share[:, None] * down[None, :]).astype(np.float32)
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Trains on at most `most` labelled documents outside the held-out fold (crc32 of the id's text, modulo 5, is 0)."""
    picked = (
        labels.select(F.col("doc_id"), F.col(target).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # of several rows with one id the text with the least hash is read, so that no more rows come than labels
    once = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    once = once.repartition(TASKS)  # `most` rows; else one task would send all features to the driver in one piece

    @common.trimmed
    def bags(batches):
        for batch in batches:
            found = [bag((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f.astype("<i4").tobytes() for f, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary()), batch.column("label")], ["found", "times", "label"])

    rows = common.batched(once.select("doc_id", "text", "label")).mapInArrow(bags, "found binary, times binary, label int").collect()
    rows.sort(key=lambda r: zlib.crc32(r.found))
    return train([(np.frombuffer(r.found, "<i4"), np.frombuffer(r.times, "<u4"), r.label) for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs with `score`, last: the probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index("text")
    plain = [StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]  # names of the caller's may clash

    @common.trimmed
    def scored(batches):
        weight, bias = held.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, raw, off in common.slices(batch.column(at)):
                bucket, row = features(raw, off)
                n = len(off) - 1
                total = np.bincount(row, weight[bucket], n) / np.maximum(1, np.bincount(row, minlength=n))
                out[first : first + n] = 1 / (1 + np.exp(-np.clip(total + bias, -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [f"c{i}" for i in range(len(names) + 1)])

    schema = StructType([*plain, StructField(f"c{len(names)}", DoubleType())])
    return common.batched(docs.toDF(*(f.name for f in plain))).mapInArrow(scored, schema).toDF(*names, "score")
