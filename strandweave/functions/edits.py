"""Column expressions on edit lists: arrays of structs (op string, len int).

M is a match, R a replaced base, I bases only in the read, D bases only in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandweave.params import AlignParams

EDITS = "array<struct<op: string, len: int>>"


def _op_score(o: Column, p: AlignParams) -> Column:
    return F.when(o["op"] == "M", o["len"] * p.match).when(o["op"] == "R", -o["len"] * p.replace).otherwise(-(p.gap_open + o["len"] * p.gap_extend))


def edit_score(ops: Column, p: AlignParams) -> Column:
    return F.aggregate(ops, F.lit(0), lambda a, o: a + _op_score(o, p))


def op_total(ops: Column, kinds: str) -> Column:
    """Bases under the given ops."""
    return F.aggregate(ops, F.lit(0), lambda a, o: a + F.when(o["op"].isin(*kinds), o["len"]).otherwise(0))


def matches(ops: Column) -> Column:
    return op_total(ops, "M")


def edit_distance(ops: Column) -> Column:
    """Replaced, inserted and deleted bases (SAM's NM)."""
    return op_total(ops, "RID")


def alignment_length(ops: Column) -> Column:
    return op_total(ops, "MRID")


def query_length(ops: Column) -> Column:
    return op_total(ops, "MRI")


def ref_length(ops: Column) -> Column:
    return op_total(ops, "MRD")


def identity(ops: Column) -> Column:
    return matches(ops) / alignment_length(ops)


def has_match_run(ops: Column, n: int) -> Column:
    return F.exists(ops, lambda o: (o["op"] == "M") & (o["len"] >= n))


def score_of_first(ops: Column, n: Column, p: AlignParams) -> Column:
    """Score of the first n read bases; the last op is cut to fit, deletions before it count whole."""
    start = F.struct(F.lit(0).alias("left"), F.lit(0).alias("score"))

    def step(a: Column, o: Column) -> Column:
        left = n - a["left"]
        use = F.when(o["op"] == "D", o["len"]).otherwise(F.least(o["len"], left))
        cut = F.struct(o["op"].alias("op"), use.alias("len"))
        return F.when(left <= 0, a).otherwise(F.struct((a["left"] + F.when(o["op"] == "D", 0).otherwise(use)).cast("int").alias("left"), (a["score"] + _op_score(cut, p)).cast("int").alias("score")))

    return F.aggregate(ops, start, step, lambda a: a["score"])


def score_of_last(ops: Column, n: Column, p: AlignParams) -> Column:
    return score_of_first(F.reverse(ops), n, p)


def prefix_extremes(ops: Column, p: AlignParams) -> Column:
    """Struct of the lowest and highest prefix score and the final one."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(1 << 30).alias("low"), F.lit(-(1 << 30)).alias("high"))

    def step(a: Column, o: Column) -> Column:
        total = (a["sum"] + _op_score(o, p)).cast("int")
        return F.struct(total.alias("sum"), F.least(a["low"], total).alias("low"), F.greatest(a["high"], total).alias("high"))

    return F.aggregate(ops, zero, step)


def best_core(ops: Column, p: AlignParams) -> Column:
    """Score of the best-scoring run of ops (the greatest sub-array sum, at least 0)."""
    zero = F.struct(F.lit(0).alias("here"), F.lit(0).alias("best"))

    def step(a: Column, o: Column) -> Column:
        here = F.greatest(a["here"] + _op_score(o, p), F.lit(0)).cast("int")
        return F.struct(here.alias("here"), F.greatest(a["best"], here).alias("best"))

    return F.aggregate(ops, zero, step, lambda a: a["best"])


def cigar(ops: Column, clip_front: Column, clip_back: Column, clip: str = "H") -> Column:
    """SAM's CIGAR: matches and replacements as M, neighbours merged, unaligned read ends clipped."""
    plain = F.transform(ops, lambda o: F.struct(F.when(o["op"].isin("M", "R"), "M").otherwise(o["op"]).alias("op"), o["len"].alias("len")))
    zero = F.struct(F.lit("").alias("done"), F.lit("").alias("op"), F.lit(0).alias("len"))

    def told(op: Column, n: Column) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), op)).otherwise("")

    def step(a: Column, o: Column) -> Column:
        same = a["op"] == o["op"]
        return F.when(same, F.struct(a["done"].alias("done"), a["op"].alias("op"), (a["len"] + o["len"]).alias("len"))).otherwise(F.struct(F.concat(a["done"], told(a["op"], a["len"])).alias("done"), o["op"].alias("op"), o["len"].alias("len")))

    body = F.aggregate(plain, zero, step, lambda a: F.concat(a["done"], told(a["op"], a["len"])))
    return F.concat(told(F.lit(clip), clip_front), body, told(F.lit(clip), clip_back))


def md(ops: Column, ref: Column) -> Column:
    """SAM's MD tag over the aligned reference bases."""
    zero = F.struct(F.lit("").alias("done"), F.lit(0).alias("run"), F.lit(1).alias("at"))

    def step(a: Column, o: Column) -> Column:
        n, here = o["len"], F.substring(ref, a["at"], o["len"])
        spaced = F.regexp_replace(here, "(.)(?=.)", "$10").cast("string")
        matched = F.struct(a["done"].alias("done"), (a["run"] + n).alias("run"), (a["at"] + n).alias("at"))
        replaced = F.struct(F.concat(a["done"], a["run"].cast("string"), spaced).alias("done"), F.lit(0).alias("run"), (a["at"] + n).alias("at"))
        deleted = F.struct(F.concat(a["done"], a["run"].cast("string"), F.lit("^"), here).alias("done"), F.lit(0).alias("run"), (a["at"] + n).alias("at"))
        return F.when(o["op"] == "M", matched).when(o["op"] == "R", replaced).when(o["op"] == "D", deleted).otherwise(a)

    return F.aggregate(ops, zero, step, lambda a: F.concat(a["done"], a["run"].cast("string")))


def ops_string(ops: Column) -> Column:
    """A readable form, such as 50M1R49M."""
    return F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
