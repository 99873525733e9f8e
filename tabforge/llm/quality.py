"""Quality classifier: supervised subword embeddings.

Every feature of a text (its words, pairs of neighbouring words, and the
GRAM-character pieces of words) hashes to a row of an embedding table.  A
document is the mean of its features' vectors; a softmax over two outputs gives the
probability of label 1.  Table and output layer are learned together by
stochastic gradient descent in numpy.

Scoring folds the output layer into the table: a document's logit difference is
the mean over its features of ``vector . (out_1 - out_0)`` plus the bias
difference, so each feature costs one number.

Defined results: null or empty text has no feature and scores the bias alone;
label rows without a document, with a null label, or whose document is longer
than MAX_BYTES are not used for training; repeated rows are scored each; extra
columns are ignored; without usable labels every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_remainder, text_or_empty

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Training bounds: labelled rows of each class, bytes of a text used for training.
MAX_ROWS = 2500
MAX_BYTES = 65_536
BUCKETS = 1 << 18
DIM = 16
GRAM = 4
EPOCHS, RATE = 8, 0.5
MEMO_WORDS = 400_000

TOKEN = re.compile(r"\S+")
REPEAT = zlib.crc32(b"<same word again>") % BUCKETS
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_features(word: str) -> list[int]:
    """Bucket of the word, then of the pieces of ``<word>``."""
    marked = f"<{word}>"
    pieces = [word, *(marked[i:i + GRAM] for i in range(len(marked) - GRAM + 1))]
    return [zlib.crc32(p.encode("utf-8")) % BUCKETS for p in pieces]


def pair_features(ids: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, from the words' own buckets; all pairs of a word
    with itself share one bucket."""
    a, b = ids[:-1].astype(np.uint64), ids[1:].astype(np.uint64)
    mixed = (((a * np.uint64(BUCKETS) + b + np.uint64(1)) * _MIX) >> np.uint64(64 - 18)).astype(np.int64)
    return np.where(a == b, REPEAT, mixed)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    memo: dict[str, list[int]] = {}
    found: list[int] = []
    own: list[int] = []
    for w in TOKEN.findall(text):
        f = memo.get(w)
        if f is None:
            f = memo[w] = word_features(w)
        own.append(f[0])
        found += f
    pairs = pair_features(np.asarray(own, np.int64)) if len(own) > 1 else np.zeros(0, np.int64)
    return np.unique(np.concatenate([np.asarray(found, np.int64), pairs]), return_counts=True)


@F.arrow_udf(T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("times", T.BinaryType())]))
def features(texts: pa.Array) -> pa.Array:
    pairs = [counts(t) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays(
        [pa.array([i.astype("<i4").tobytes() for i, _ in pairs], pa.binary()),
         pa.array([n.astype("<i4").tobytes() for _, n in pairs], pa.binary())], ["ids", "times"])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list:
    """A bounded sample of labelled rows outside the held-out fold: of each class the
    ``most`` with the smallest hash of their id, as (doc_id, label, buckets, counts)."""
    usable = labels.where((id_remainder(FOLDS) != HELD_OUT) & F.col("quality").isin(0, 1))
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("y")).distinct()
    low, high = (usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
                 for y in (0, 1))
    chosen = F.broadcast(low.unionAll(high))                 # at most 2 * most rows
    text = text_or_empty()
    texts = docs.select("doc_id", text.alias("text")).where(F.octet_length("text") <= max_bytes)
    rows = texts.join(chosen, "doc_id").select("doc_id", "y", features("text").alias("f")).select(
        "doc_id", "y", "f.ids", "f.times")
    return sorted((r["doc_id"], r["y"], bytes(r["ids"]), bytes(r["times"])) for r in rows.collect())


def fit(rows: list) -> tuple[np.ndarray, float]:
    """Weight of each bucket in the logit difference and the bias difference."""
    rng = np.random.default_rng(11)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    docs = [(y, np.frombuffer(i, "<i4"), np.frombuffer(n, "<i4").astype(np.float32)) for _, y, i, n in rows if i]
    if len({d[0] for d in docs}) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)):
            y, ids, times = docs[k]
            share = times / times.sum()
            mean = share @ table[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            rate = RATE * (1 - done / steps)
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            table[ids] -= rate * share[:, None] * back * len(ids) ** 0.5
            done += 1
    return table @ (out[1] - out[0]), float(bias[1] - bias[0])


def scorer(weights: np.ndarray, bias: float):
    """Column function text -> probability of label 1."""
    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # of each word: its own bucket, the sum of its features' weights, their number
        memo: dict[str, tuple[int, float, int]] = {}
        for texts in batches:
            scores = []
            for text in texts.to_pylist():
                tokens = TOKEN.findall(text)
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                for w in set(tokens).difference(memo):
                    f = word_features(w)
                    memo[w] = (f[0], float(weights[f].sum()), len(f))
                total, n = 0.0, 0
                if tokens:
                    own, value, size = zip(*map(memo.__getitem__, tokens))
                    total, n = sum(value), sum(size)
                    if len(own) > 1:
                        pairs = pair_features(np.asarray(own, np.int64))
                        total, n = total + float(weights[pairs].sum(dtype=np.float64)), n + len(pairs)
                z = total / max(n, 1) + bias
                scores.append(float(1 / (1 + np.exp(-z))))
            yield pa.array(scores, pa.float64())

    return judge


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    judge = scorer(*fit(training_rows(docs, labels)))
    judged = docs.select("doc_id", judge(text_or_empty()).alias("score"))
    return judged.select("doc_id", (id_remainder(FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
