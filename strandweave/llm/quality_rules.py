"""Quality rules: document statistics, two fixed rules, then gradient-boosted trees with monotonic constraints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import prepare
from strandweave.llm.trees import Forest, boost

SYMBOLS = "#*$%&|<>"
_SYMBOLS = list(SYMBOLS.encode())
_BLANKS = [9, 10, 11, 12, 13, 32]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
TRAIN_ROWS = 12_000
THRESHOLD = 0.5

#: Model inputs and how the verdict may follow them: 1 never falls, -1 never rises, 0 free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0,
    "mark_share": -1, "distinct_share": 0, "words_per_line": 0, "alpha_share": 0, "full_stops": 0, "bare_marks": -1, "comma_share": 0,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_stats(text: str | None) -> tuple[list[int], list[float]]:
    """The five base statistics of one text and the model's features."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    word_chars = int(count[:0x80].sum() + count[0xC0:].sum() - count[_BLANKS].sum())
    n_symbols = int(count[_SYMBOLS].sum())
    lines = [line for line in data.split(b"\n") if line.strip()]
    n_dup_lines = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    n_repeat = 0
    if n >= 4:
        size = len(ids)
        if size < 2_000_000:
            keys = (codes[:-2] * size + codes[1:-1]) * size + codes[2:]
        else:
            keys = np.unique(codes[:-2] * size + codes[1:-1], return_inverse=True)[1] * size + codes[2:]
        ordered = np.sort(keys)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(again):
            hit = np.isin(keys, again)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= hit
            n_repeat = int(covered.sum())
    chars, some = max(1, word_chars), max(1, n)
    upper, digits, marks = int(count[65:91].sum()), int(count[48:58].sum()), int(count[33] + count[63])
    alpha = upper + int(count[97:123].sum() + count[0xC0:].sum())
    features = [
        np.log1p(n), word_chars / some, n_symbols / chars, n_dup_lines / max(1, len(lines)), n_repeat / some, upper / chars, digits / chars,
        marks / some, len(ids) / some, min(n / max(1, len(lines)), 1e3), alpha / chars, count[46] / some, ids and sum(1 for w in ids if not w.isalnum() and len(w) == 1) / len(ids) or 0.0, count[44] / some,
    ]
    return [n, word_chars, n_symbols, n_dup_lines, n_repeat], [float(f) for f in features]


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, where: str = "true") -> DataFrame:
    """(doc_id, text, y) of at most max_rows labelled documents, the lowest by hash of their ids; null labels are left out. Repeated labels count once, and of the texts of a repeated id the smallest."""
    chosen = labels.where(f"`{label}` is not null and doc_id is not null and ({where})").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = TRAIN_ROWS) -> Forest | None:
    """Trees on at most max_rows labelled documents (a fixed bound, so the driver holds a fixed number of feature rows); None without labels."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [document_stats(t)[1] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = training_rows(docs, labels, label, max_rows).mapInArrow(run, "doc_id long, y double, x array<double>").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["doc_id", "y"], kind="stable")
    return boost(np.stack(got["x"].map(np.asarray).tolist()), got["y"].to_numpy(), np.array(list(FEATURES.values())))


def verdicts(texts: list[str | None], model: Forest | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base statistics, base_failed, kept and score of each text."""
    stats = [document_stats(t) for t in texts]
    base = np.array([s[0] for s in stats], np.int64).reshape(-1, 5)
    failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
    score = np.ones(len(base)) if model is None else 1 / (1 + np.exp(-model.scores(np.array([s[1] for s in stats]).reshape(-1, len(FEATURES)))))
    return base, failed, ~failed & (score >= threshold), score


def apply_rules(docs: DataFrame, model: Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, the base statistics, base_failed, kept, score.

    A null or empty text has no words and fails the base rules. Repeated rows
    and rows with a null id are judged one by one; an empty table gives no
    rows; other columns are ignored, whatever their names. Without a model the
    base rules decide alone.
    """
    prepare(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"

    def run(batches):
        for b in batches:
            base, failed, kept, score = verdicts(b.column(1).to_pylist(), model, threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *BASE, "base_failed", "kept", "score"])

    return src.mapInArrow(run, schema)


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass, with their columns, whatever their names; nulls, repeats and empty tables as in apply_rules."""
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(verdicts(b.column(at).to_pylist(), model, threshold)[2]))

    return docs.mapInArrow(run, docs.schema)
