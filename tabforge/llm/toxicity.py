"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function of
the words it has and of their 5-character pieces; the document's score is the
noisy-or of its sentences, ``1 - prod(1 - p_s)``.  Only documents carry labels: the gradient of the
noisy-or shares a document's label out among its sentences, so the sentence
model learns which sentences offend, and ``score`` can point to them.

Defined results: null or empty text, or text without any word, has no sentence
and scores 0.0; a label row without a document, with a null label, or whose
document is longer than ``max_bytes`` is not used for training; repeated rows
are scored each on its own; extra columns are ignored.  With no usable label
rows all weights are 0 and a sentence's score is ``sigmoid(BIAS)``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, id_remainder, text_or_empty

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Training bounds: labelled rows of each class, bytes of a text used for training.
MAX_CLEAN, MAX_TOXIC = 2500, 1500
MAX_BYTES = 65_536
BUCKETS = 1 << 18
GRAM = 5
BIAS = -6.0
EPOCHS, BATCH, RATE, SPARSITY = 12, 32, 0.5, 0.05
MIN_DOCS = 3                      # a feature of fewer training documents gets no weight

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W_]+")


def features(word: str) -> list[int]:
    """Buckets of a lower-case word and of the 5-character pieces of ``<word>``, which
    carry over to inflected forms that training has not seen."""
    marked = f"<{word}>"
    pieces = [word, *(marked[i:i + GRAM] for i in range(len(marked) - GRAM + 1))]
    return [zlib.crc32(p.encode("utf-8")) % BUCKETS for p in pieces]


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct words) of every sentence that has a word."""
    out = []
    for m in SENTENCE.finditer(text):
        words = WORD.findall(m.group().lower())
        if words:
            out.append((m.start(), m.end(), set(words)))
    return out


def bag(text: str) -> bytes:
    """A document as int32: for each sentence its number of features, then them."""
    out: list[int] = []
    for _, _, words in sentences(text):
        ids = [f for w in sorted(words) for f in features(w)]
        out.append(len(ids))
        out.extend(ids)
    return np.asarray(out, np.int32).tobytes()


@F.arrow_udf(T.BinaryType())
def bags(texts: pa.Array) -> pa.Array:
    held("toxicity")
    return pa.array([bag(t) for t in texts.to_pylist()], pa.binary())


def training_rows(docs: DataFrame, labels: DataFrame, max_clean: int = MAX_CLEAN,
                  max_toxic: int = MAX_TOXIC, max_bytes: int = MAX_BYTES) -> list:
    """A bounded sample of labelled rows outside the held-out fold: of each class those
    with the smallest hash of their id.  Features are made on the executors."""
    usable = labels.where((id_remainder(FOLDS) != HELD_OUT) & F.col("toxic").isin(0, 1))
    usable = usable.select("doc_id", F.col("toxic").cast("int").alias("y")).distinct()
    clean, toxic = (usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
                    for y, most in ((0, max_clean), (1, max_toxic)))
    chosen = F.broadcast(clean.unionAll(toxic))              # at most max_clean + max_toxic rows
    text = text_or_empty()
    texts = docs.select("doc_id", text.alias("text")).where(F.octet_length("text") <= max_bytes)
    rows = texts.join(chosen, "doc_id").select("doc_id", "y", bags("text").alias("bag"))
    return sorted((r["doc_id"], r["y"], bytes(r["bag"])) for r in rows.collect())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all sentences of a bag, and how many each sentence has."""
    a, at = np.frombuffer(blob, np.int32), 0
    words, lengths = [], []
    while at < len(a):
        k = int(a[at])
        words.append(a[at + 1:at + 1 + k])
        lengths.append(k)
        at += 1 + k
    return np.concatenate(words), np.asarray(lengths, np.int64)


def fit(rows: list) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias, from (doc_id, label, bag) rows: stochastic gradient
    descent on the documents' log loss with per-weight rates and soft thresholds."""
    weights, bias = np.zeros(BUCKETS), BIAS
    parsed = [(y, *unpack(b)) for _, y, b in rows if b]
    counts = np.zeros(BUCKETS, np.int64)
    for _, ids, _ in parsed:
        counts[np.unique(ids)] += 1
    known = counts >= MIN_DOCS
    squares, bias_square = np.full(BUCKETS, 1e-2), 1.0
    order = np.random.default_rng(7)
    for _ in range(EPOCHS if parsed else 0):
        for part in np.array_split(order.permutation(len(parsed)), -(-len(parsed) // BATCH)):
            ids = np.concatenate([parsed[i][1] for i in part])
            per_sentence = np.concatenate([parsed[i][2] for i in part])
            per_doc = np.asarray([len(parsed[i][2]) for i in part])
            y = np.asarray([parsed[i][0] for i in part])
            z = np.add.reduceat(weights[ids], np.cumsum(per_sentence) - per_sentence) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            none = np.exp(np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), np.cumsum(per_doc) - per_doc))
            # d loss / d z of a sentence: p in a clean document; in a toxic one the
            # sentence's part in the noisy-or, -p * none / (1 - none)
            slope = np.repeat(np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0), per_doc) * p
            g = np.bincount(ids, np.repeat(slope, per_sentence), BUCKETS)
            touched = np.flatnonzero((g != 0) & known)
            squares[touched] += g[touched] ** 2
            rate = RATE / np.sqrt(squares[touched])
            moved = weights[touched] - rate * g[touched]
            weights[touched] = np.sign(moved) * np.maximum(np.abs(moved) - rate * SPARSITY, 0)
            total = slope.sum()
            bias_square += total ** 2
            bias -= RATE * total / np.sqrt(bias_square)
    return weights, float(bias)


def scorer(weights: np.ndarray, bias: float):
    """Column function text -> struct(score, sentences at 0.5 or more, the worst one)."""
    nonzero = np.flatnonzero(weights)
    by_bucket = dict(zip(nonzero.tolist(), weights[nonzero].tolist()))
    kind = pa.struct([("score", pa.float64()), ("n_sentences", pa.int64()), ("worst_start", pa.int64()),
                      ("worst_end", pa.int64()),
                      ("offending", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()),
                                                        ("score", pa.float64())])))])

    def one(text: str, memo: dict) -> dict:
        found, keep, worst, n = [], 0.0, (-1e300, None, None), 0
        for start, end, words in sentences(text):
            n += 1
            z = bias
            for w in sorted(words):
                v = memo.get(w)
                if v is None:
                    if len(memo) > 500_000:
                        memo.clear()
                    v = memo[w] = sum(by_bucket.get(f, 0.0) for f in features(w))
                z += v
            if z > worst[0]:
                worst = (z, start, end)
            p = 1 / (1 + math.exp(-z)) if z > -30 else math.exp(z)
            if p >= 0.5:
                found.append({"start": start, "end": end, "score": p})
            keep += math.log1p(-min(p, 1 - 1e-12))
        return {"score": -math.expm1(keep) if n else 0.0, "n_sentences": n, "worst_start": worst[1],
                "worst_end": worst[2], "offending": found}

    @F.arrow_udf("score double, n_sentences long, worst_start long, worst_end long, "
                 "offending array<struct<start:long,end:long,score:double>>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("toxicity")
        memo: dict = {}
        for texts in batches:
            yield pa.array([one(t, memo) for t in texts.to_pylist()], kind)

    return judge


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_sentences, worst_start, worst_end
    (the sentence with the highest score, code points) and offending (all at 0.5 or more)."""
    judge = scorer(*fit(training_rows(docs, labels)))
    judged = docs.select("doc_id", judge(text_or_empty()).alias("j"))
    return judged.select(
        "doc_id", (id_remainder(FOLDS) == HELD_OUT).alias("held_out"), F.col("j.score").alias("score"),
        (F.col("j.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("j.n_sentences").alias("n_sentences"),
        F.col("j.worst_start").alias("worst_start"), F.col("j.worst_end").alias("worst_end"),
        F.col("j.offending").alias("offending"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose score is below the threshold, with the columns of ``docs``."""
    judge = scorer(*fit(training_rows(docs, labels)))
    return docs.where(judge(text_or_empty())["score"] < THRESHOLD)
