"""Toxicity by a classifier chain.

Categories are predicted one after the other by sparse linear models; each
later model also sees the earlier categories' probabilities. While training,
those are out-of-fold predictions, so that a later model meets them as it
will when scoring: rows of a fold are predicted by a model, and by a
vocabulary, learnt from the other folds. Inputs are words and word beginnings
with a significant association in the labelled rows, kept as an explicit
vocabulary: an unseen word can't collide with a toxic one.

The label table has one category, toxic, which is the last link and decides.
The links before it divide the toxic training rows by how they offend:
insult, by a whole word that a tenth of the toxic rows of other folds share;
veiled, without such a word. They are labels of training rows alone; a scored
document gets their predictions.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import prepare
from strandweave.llm.quality_rules import training_rows

CATEGORIES = ("insult", "veiled", "toxic")
TRAIN_ROWS = 12_000
VOCABULARY = 900
MIN_DOCS = 5
MIN_Z = 4.5
INSULT_SHARE = 0.1
PREFIXES = (4, 5, 6)
FOLDS = 5
CACHE_WORDS = 300_000
#: Chosen on held-out labels, where it finds more than 0.5 does for as few false alarms: marked labels are fewer than marked texts.
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features_of(word: str) -> list[str]:
    """The word itself, and its first letters followed by *."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Chain:
    """A row of weights per category: intercept, vocabulary, then earlier probabilities."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    known: dict[str, list[int]] = field(default_factory=dict)

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "weights": self.weights, "known": {}}

    def ids(self, word: str) -> list[int]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            got = self.known[word] = [i for f in features_of(word) if (i := self.vocabulary.get(f)) is not None]
        return got

    def sparse(self, text: str | None) -> tuple[list[int], list[float]]:
        """Vocabulary places of a whole text's features, and the logarithms of their counts plus one."""
        seen: Counter = Counter()
        for w in words_of(text):
            for i in self.ids(w):
                seen[i] += 1
        return list(seen), np.log1p(list(seen.values())).tolist()

    def probabilities(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        """A row per text, a column per category."""
        of = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
        at = np.fromiter((i for ids, _ in rows for i in ids), np.int64, len(of))
        x = np.fromiter((v for _, values in rows for v in values), np.float64, len(of))
        done = np.zeros((len(rows), 0))
        for w in self.weights:
            words = w[1 : 1 + len(self.vocabulary)]
            z = w[0] + np.bincount(of, x * words[at], len(rows)) + done @ w[1 + len(self.vocabulary) :]
            done = np.column_stack([done, _sigmoid(z)])
        return done


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _linear(x: np.ndarray, y: np.ndarray, often: np.ndarray, start: np.ndarray | None = None, l1: float = 0.0005, steps: int = 200) -> np.ndarray:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps; often says how many rows each row stands for, start is a first guess."""
    n, k = float(often.sum()), x.shape[1]
    norm, size = np.ones(k, np.float32), 1.0
    for _ in range(12):  # power steps to the largest singular value
        norm = x.T @ (often * (x @ norm))
        size = float(np.linalg.norm(norm)) or 1.0
        norm /= size
    rate = 4.0 / (1 + 1.1 * size / max(1, n))
    w = np.zeros(k + 1, np.float32)
    share = min(max(float((y * often).sum()) / n, 1e-4), 1 - 1e-4) if n else 0.5
    w[0] = np.log(share / (1 - share))
    if start is not None:
        w = start.copy()
    v, t = w.copy(), 1.0
    for _ in range(steps):
        err = (often * (_sigmoid(x @ v[1:] + v[0]) - y)).astype(np.float32)
        new = v - np.float32(rate / max(1, n)) * np.concatenate([[err.sum()], x.T @ err]).astype(np.float32)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * l1, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + np.float32((t - 1) / t2) * (new - w)
        w, t = new, t2
    return w


def train_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, known: np.ndarray, vocabulary: dict[str, int]) -> Chain:
    """x: a row per text over the vocabulary; labels: a 0/1 column per category, in chain order; known: per fold, which columns the other folds chose.

    The weights that score come from all rows, the probabilities that later
    links train on from models of the other folds over their own vocabulary.
    Texts of one fold and the same labels that have no word of the vocabulary
    are one row that counts as often.
    """
    kind = fold.astype(np.int64) << labels.shape[1] | (labels > 0) @ (1 << np.arange(labels.shape[1]))
    plain = ~x.any(axis=1)
    _, first, number = np.unique(kind[plain], return_index=True, return_counts=True)
    rows = np.concatenate([np.flatnonzero(~plain), np.flatnonzero(plain)[first]])
    often = np.concatenate([np.ones(int((~plain).sum())), number]).astype(np.float32)
    x, labels, fold = x[rows].astype(np.float32), labels[rows].astype(np.float32), fold[rows]
    weights = []
    done = np.zeros((len(x), 0), np.float32)
    for k in range(labels.shape[1]):
        seen, y = np.column_stack([x, done]).astype(np.float32), labels[:, k]
        weights.append(_linear(seen, y, often))
        held = np.zeros(len(x), np.float32)
        for f in range(len(known)):
            columns = np.r_[known[f], np.ones(done.shape[1], bool)]
            own = fold == f
            w = _linear(seen[~own][:, columns], y[~own], often[~own], weights[-1][np.r_[True, columns]], steps=80)
            held[own] = _sigmoid(w[0] + seen[own][:, columns] @ w[1:])
        done = np.column_stack([done, held])
    return Chain(vocabulary, [w.astype(np.float64) for w in weights])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = TRAIN_ROWS) -> Chain | None:
    """Learns from at most max_rows labelled rows; the driver gets the chosen vocabulary and sparse rows over it. None without labels of both classes."""
    prepare(docs.sparkSession)
    rows = training_rows(docs, labels, label, max_rows)

    def fold_of(ids) -> list[int]:
        return [(i * 2_654_435_761 >> 16) % FOLDS for i in ids]

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for fold, text, y in zip(fold_of(b.column(0).to_pylist()), b.column(1).to_pylist(), b.column(2).to_pylist()):
                slot = fold + FOLDS * int(y > 0)
                seen[("", slot)] += 1
                for f in {f for w in set(words_of(text)) for f in features_of(w)}:
                    seen[(f, slot)] += 1
        items = list(seen.items())
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([f for (f, _), _ in part]), pa.array([k for (_, k), _ in part], pa.int32()), pa.array([n for _, n in part], pa.int64())], ["f", "slot", "n"])

    slots = [f"{c}{k}" for c in "ab" for k in range(FOLDS)]
    counts = rows.mapInArrow(count, "f string, slot int, n long").groupBy("f").agg(*(F.sum(F.when(F.col("slot") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(slots)))
    total = counts.where("f = ''").first()
    if not total or not sum(total[f"b{k}"] for k in range(FOLDS)) or not sum(total[f"a{k}"] for k in range(FOLDS)):
        return None

    def z(without: int | None):
        """How far the share of toxic rows with a feature lies above that of others, in standard errors, without one fold."""
        of = [k for k in range(FOLDS) if k != without]
        a, b = (sum((F.col(f"{c}{k}") for k in of), F.lit(0)) for c in "ab")
        n0, n1 = (sum(total[f"{c}{k}"] for k in of) for c in "ab")
        pooled = (a + b + 1) / (n0 + n1 + 2)
        worth = ((b + 0.5) / (n1 + 1) - (a + 0.5) / (n0 + 1)) / F.sqrt(pooled * F.greatest(F.lit(1e-7), 1 - pooled) * (1 / (n0 + 1) + 1 / (n1 + 1)))
        return F.when(a + b >= MIN_DOCS, worth).otherwise(0.0), b / max(1, n1)

    tested = counts.where("f <> ''").select("f", z(None)[0].alias("z"), *(c.alias(f"{n}{k}") for k in range(FOLDS) for n, c in zip(("z_", "share_"), z(k)))).where(f"z >= {MIN_Z}")
    chosen = sorted(tested.orderBy(F.desc("z"), "f").limit(VOCABULARY).collect(), key=lambda r: r["f"])
    chain = Chain({r["f"]: i for i, r in enumerate(chosen)})
    known = np.array([[r[f"z_{k}"] >= MIN_Z for r in chosen] for k in range(FOLDS)], bool).reshape(FOLDS, -1)
    insults = known & np.array([[not r["f"].endswith("*") and r[f"share_{k}"] >= INSULT_SHARE for r in chosen] for k in range(FOLDS)], bool).reshape(FOLDS, -1)

    def sparse(batches):
        for b in batches:
            got = [chain.sparse(t) for t in b.column(1).to_pylist()]
            cols = [b.column(0), b.column(2), pa.array([x[0] for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "y", "at", "x"])

    got = sorted(rows.mapInArrow(sparse, "doc_id long, y double, at array<int>, x array<double>").collect(), key=lambda r: (r["doc_id"], r["y"], r["at"]))
    x = np.zeros((len(got), len(chain.vocabulary)))
    for i, r in enumerate(got):
        x[i, r["at"]] = r["x"]
    fold = np.array(fold_of(r["doc_id"] for r in got))
    toxic = np.array([r["y"] > 0 for r in got], float)
    insult = toxic * ((x > 0) & insults[fold]).any(axis=1)
    return train_chain(x, np.column_stack([insult, toxic - insult, toxic]), fold, known, chain.vocabulary)


def score_documents(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """(doc_id, insult, veiled, toxic): probabilities for every row, those with null or repeated ids too; all 0 without a model.

    Null texts have no words; an empty table gives no rows; extra columns are
    ignored, whatever their names; ties have the same score.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            p = chain.probabilities([chain.sparse(t) for t in texts]) if chain else np.zeros((len(texts), len(CATEGORIES)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in p.T)], ["doc_id", *CATEGORIES])

    schema = "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose toxic probability, the chain's last, reaches the threshold, with all category probabilities."""
    return score_documents(docs, fit(docs, labels)).where(F.col("toxic") >= threshold)
