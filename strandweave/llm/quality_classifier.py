"""Quality classifier: supervised subword embeddings.

A document is the mean of the vectors of its words and word bigrams; a word's
is the mean of the learned vectors of its hashed form and its character
bigrams and trigrams, a word bigram's that of its hash; a softmax layer gives
the class. Trained by mini-batch stochastic gradient descent in numpy. Because
everything after the embedding is linear, a trained model scores a word or a
bigram by one number, so that scoring a text is a mean over such scores.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import prepare
from strandweave.llm.quality_rules import training_rows

BUCKETS, BIGRAMS = 1 << 17, 1 << 18
DIM = 8
TRAIN_ROWS = 2_500
GRAMS = (2, 3)
CACHE_WORDS = 300_000
THRESHOLD = 0.3
HELD_OUT_OF = 5


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def bigram_buckets(hashes: np.ndarray) -> np.ndarray:
    """The bucket of each word and its follower, from the words' crc32 in order. Pairs of equal words share one, whatever the word."""
    a, b = hashes[:-1], hashes[1:]
    mixed = (a * 2654435761 + b * 2246822519 >> 11) % (BIGRAMS - 1) + 1
    return BUCKETS + np.where(a == b, 0, mixed)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every feature: the word itself, and its character bigrams and trigrams with ends marked."""
    marked = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.int64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lens)
    two = owner[1:] == owner[:-1]
    three = owner[2:] == owner[:-2]
    bigrams = (marked[:-1] << 8 | marked[1:])[two]
    trigrams = (marked[:-2] << 16 | marked[1:-1] << 8 | marked[2:])[three]
    whole = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    index = np.concatenate([np.arange(len(words)), owner[:-1][two], owner[:-2][three]])
    buckets = np.concatenate([whole, bigrams * 2654435761 + 17 >> 7, trigrams * 2246822519 + 31 >> 9]) & (BUCKETS - 1)
    return index, buckets


class Model:
    """Learned per-bucket scores and offset: the log odds of label 1 are the offset plus the mean score of words and word pairs."""

    def __init__(self, bucket_scores: np.ndarray, offset: float):
        self.bucket_scores, self.offset = bucket_scores, offset
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.word_scores, self.hashes = np.zeros(1 << 12), np.zeros(1 << 12, np.int64)

    def __getstate__(self):
        return {"bucket_scores": self.bucket_scores, "offset": self.offset}

    def __setstate__(self, state):
        self.__init__(**state)

    def learn(self, new: list[bytes]) -> None:
        at = len(self.words)
        while at + len(new) > len(self.hashes):
            self.word_scores, self.hashes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.word_scores, self.hashes))
        index, buckets = word_features(new)
        self.word_scores[at : at + len(new)] = np.bincount(index, self.bucket_scores[buckets], len(new)) / np.bincount(index, minlength=len(new))
        self.hashes[at : at + len(new)] = np.fromiter(map(zlib.crc32, new), np.int64, len(new))
        self.words.update(zip(new, range(at, at + len(new))))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 of each whole text."""
        if len(self.words) > CACHE_WORDS:
            self.clear()
        docs = [words_of(t) for t in texts]
        new = [w for w in set().union(*docs) if w not in self.words]
        for at in range(0, len(new), 50_000):
            self.learn(new[at : at + 50_000])
        z = np.full(len(docs), self.offset)
        for i, d in enumerate(docs):
            if d:
                own = np.fromiter(map(self.words.__getitem__, d), np.int64, len(d))
                z[i] += (self.word_scores[own].sum() + self.bucket_scores[bigram_buckets(self.hashes[own])].sum()) / (2 * len(d) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str | None], y: np.ndarray, epochs: int = 6, rate: float = 0.6, batch: int = 64, seed: int = 11) -> Model:
    """Mini-batch SGD with AdaGrad steps on embeddings and softmax weights. Rows of fewer than two classes teach no words: every text then scores by the smoothed class share."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    docs, pairs = [], []
    for t in texts:
        words = words_of(t)
        size = max(1, 2 * len(words) - 1)
        counts = Counter(words)
        ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in counts), np.int64, len(counts))
        docs.append((ids, np.fromiter(counts.values(), np.float32, len(counts)) / size))
        of, often = np.unique(bigram_buckets(np.fromiter(map(zlib.crc32, words), np.int64, len(words))), return_counts=True) if len(words) > 1 else (np.zeros(0, np.int64),) * 2
        pairs.append((of, often.astype(np.float32) / size))
    index, buckets = word_features(list(vocabulary)) if vocabulary else (np.zeros(0, np.int64),) * 2
    buckets = buckets[np.argsort(index, kind="stable")]
    n_features = np.bincount(index, minlength=len(vocabulary))
    first = np.cumsum(n_features) - n_features
    e = (rng.random((BUCKETS + BIGRAMS, DIM), np.float32) - 0.5) / DIM
    w = np.full((DIM, 2), 0.1, np.float32) * np.array([-1, 1], np.float32)
    b = np.log(np.array([(y == 0).sum() + 1, (y == 1).sum() + 1], np.float32) / (len(y) + 2))
    ge, gw, gb = np.full(BUCKETS + BIGRAMS, 1e-6, np.float32), np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    hot = np.stack([y == 0, y == 1], 1).astype(np.float32)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS + BIGRAMS), float(b[1] - b[0]))
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            words = np.concatenate([docs[i][0] for i in own])
            k = n_features[words]
            stops = np.cumsum(k)
            ids = buckets[np.repeat(first[words] - stops + k, k) + np.arange(k.sum())]
            weights = np.repeat(np.concatenate([docs[i][1] for i in own]) / k, k)
            doc = np.repeat(np.repeat(np.arange(len(own)), [len(docs[i][0]) for i in own]), k)
            ids = np.concatenate([ids, *(pairs[i][0] for i in own)])
            weights = np.concatenate([weights, *(pairs[i][1] for i in own)])
            doc = np.concatenate([doc, np.repeat(np.arange(len(own)), [len(pairs[i][0]) for i in own])])
            h = np.stack([np.bincount(doc, e[ids, d] * weights, len(own)) for d in range(DIM)], 1).astype(np.float32)
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = (p - hot[own]) / len(own)
            dh = err @ w.T
            dw, db = h.T @ err, err.sum(0)
            touched, ids = np.unique(ids, return_inverse=True)
            de = np.stack([np.bincount(ids, dh[doc, d] * weights, len(touched)) for d in range(DIM)], 1).astype(np.float32)
            ge[touched] += (de * de).mean(1)
            e[touched] -= 0.1 * rate * de / np.sqrt(ge[touched])[:, None]
            gw += dw * dw
            gb += db * db
            w -= rate * dw / np.sqrt(gw)
            b -= rate * 0.1 * db / np.sqrt(gb)
    return Model(e @ (w[:, 1] - w[:, 0]), float(b[1] - b[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most max_rows labelled rows outside the held-out fifth (crc32 of the id as text, modulo 5, not 0)."""
    prepare(docs.sparkSession)
    rows = training_rows(docs, labels, label, max_rows, f"crc32(cast(doc_id as string)) % {HELD_OUT_OF} <> 0").toPandas().sort_values(["doc_id", "y"], kind="stable")
    return train(rows["text"].tolist(), rows["y"].to_numpy())


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row, those with null or repeated ids too.

    A null text or one without words scores the model's offset alone; an empty
    table gives no rows; extra columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            s = model.scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
