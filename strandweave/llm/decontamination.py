"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Fixed masks pick some token positions of a window and ignore the others, so
that a window still matches after a substitution at an ignored position.
Windows of test items and of documents meet on the masks' hashes; each hit
fixes an ungapped alignment of the item to the document, which is then
compared token by token. A document is contaminated by an item if at least
`similarity` of the item's tokens agree, or if a passage of the item scores
`passage` or more with +1 per equal and -4 per substituted token (13 equal
tokens in a row, or more with substitutions among them).
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import materialize

MASKS = ("11111", "1101011", "1100100101")
SHORT = 14
SIMILARITY_PERCENT = 80
PASSAGE = 13
BROADCAST_TOKENS = 500_000
MARKS = ".,;:!?\"'()[]{}"


def token_hashes(text: Column) -> Column:
    """A 64-bit hash per word, lower-cased and without punctuation marks; null and blank texts have none."""
    plain = F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "\n\t\r\x0b\x0c" + MARKS, " " * 5)
    return F.transform(F.array_remove(F.split(plain, " "), ""), lambda w: F.xxhash64(w))


@lru_cache
def short_masks(n: int) -> tuple[str, ...]:
    """Masks of n positions for items of n tokens: with them, every choice of floor(n / 5) substituted tokens leaves a seed. Items of up to four tokens must stand as they are."""
    fixed = [[s + i for i, c in enumerate(m) if c == "1"] for m in MASKS for s in range(n - len(m) + 1)]
    lost = [c for c in combinations(range(n), n // 5) if not any(set(c).isdisjoint(on) for on in fixed)]
    return tuple("".join("0" if i in c else "1" for i in range(n)) for c in lost)


#: All masks by their numbers; those of short items serve items of that very length.
EVERY_MASK = (*((m, 0) for m in MASKS), *((m, n) for n in range(1, SHORT + 1) for m in short_masks(n)))


def _seeds(df: DataFrame, keep: list[str], lengths: set[int], item: bool) -> DataFrame:
    """keep, at int, key long: one row for each mask that fits at each token position of hs. lengths: which short items there are."""
    at = df.select(*keep, F.posexplode("hs").alias("at", "_h"))
    keys = []
    for n, (mask, length) in enumerate(EVERY_MASK):
        if length and length not in lengths:
            continue
        on = [i for i, c in enumerate(mask) if c == "1"]
        fits = F.col("at") + (len(mask) - 1) < F.size("hs")
        if length and item:
            fits = F.size("hs") == length
            fits &= F.col("at") == 0
        keys.append(F.when(fits, F.xxhash64(F.lit(n), *(F.get(F.col("hs"), F.col("at") + i) for i in on))))
    return at.select(*keep, "at", F.explode(F.array(*keys)).alias("key")).where("key is not null")


_COMPARE = """aggregate(
    sequence(0, size(item_hs) - 1),
    named_struct('n', 0, 'run', 0, 'best', 0),
    (a, j) -> named_struct(
        'n', a.n + int(get(hs, j + shift) <=> item_hs[j]),
        'run', greatest(0, a.run + if(get(hs, j + shift) <=> item_hs[j], 1, -4)),
        'best', greatest(a.best, a.run + if(get(hs, j + shift) <=> item_hs[j], 1, -4))))"""


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(doc_id, item_id, n_equal, n_tokens, passage, position): every contaminated pair, with the best alignment's figures.

    Items are broadcast if they hold at most `broadcast_tokens` tokens, a size
    that is counted first; beyond it seeds meet in a shuffled join and
    candidates fetch their documents by id. Items of up to 14 tokens have
    further masks, so that no allowed substitution hides them; one of fewer
    than five tokens matches where it stands as it is. Items and texts that
    are null or have no token match nothing, null ids are
    dropped, repeated rows count once, empty tables give no rows; extra
    columns are ignored.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), token_hashes(F.col("text")).alias("hs")).distinct()
    items = materialize(items, "items")
    size = items.agg(F.coalesce(F.sum(F.size("hs")), F.lit(0))).first()[0]
    lengths = {r[0] for r in items.select(F.size("hs").alias("n")).where(f"n <= {SHORT}").distinct().collect()}  # at most SHORT
    marks = _seeds(items, ["item_id", "hs"], lengths, True).select("item_id", F.col("at").alias("item_at"), "key").distinct()
    whole = items.select("item_id", F.col("hs").alias("item_hs"))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), token_hashes(F.col("text")).alias("hs"))
    if size <= broadcast_tokens:
        hits = _seeds(texts, ["doc_id", "hs"], lengths, False).join(F.broadcast(marks), "key").select("doc_id", "hs", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        found = hits.join(F.broadcast(whole), "item_id")
    else:
        hits = _seeds(texts, ["doc_id", "hs"], lengths, False).select("doc_id", "at", "key").join(marks, "key").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
        found = hits.join(whole, "item_id").join(texts, "doc_id")
    compared = found.withColumn("c", F.expr(_COMPARE)).select("doc_id", "item_id", F.expr("c.n").alias("n_equal"), F.size("item_hs").alias("n_tokens"), F.expr("c.best").alias("passage"), F.greatest("shift", F.lit(0)).alias("position"))
    bad = compared.where(f"100 * n_equal >= {SIMILARITY_PERCENT} * n_tokens or passage >= {PASSAGE}")
    best = F.max(F.struct("n_equal", "passage", (-F.col("position")).alias("before"), "n_tokens")).alias("b")
    return bad.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.expr("cast(b.n_equal as long)").alias("n_equal"), F.expr("cast(b.n_tokens as long)").alias("n_tokens"), F.expr("cast(b.passage as long)").alias("passage"), F.expr("cast(-b.before as long)").alias("position"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no benchmark item contaminates, with their columns, whatever their names.

    Rows with a null id or text stay; of repeated ids either all rows stay or
    none; an empty table stays empty.
    """
    bad = materialize(contaminated_pairs(docs, benchmark).select("doc_id").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
