"""Quotation linking: conversations in reply order, without their quotes.

Lines that start with > are quotes; the number of > marks is the level. A
line such as "On Monday, Ada wrote:" that introduces a quote goes with it. A
quoted passage, its paragraphs, lines and sentences are hashed after
normalising white space and case, so that a quote may be wrapped anew, and
meet the earliest earlier message of the conversation that holds the same
unit as its own; the quoted words are then looked up in that message. A
message replies to the message that most of its outermost quotes come from;
replies form threads. Hot conversations and hot lines are safe: originals are
minima per (conversation, hash), never lists.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import discard, materialize, prepare

QUOTE = r"^[ \t]{0,3}((?:>[ \t]?)+)(.*)$"
#: Lines that introduce a quote, in four languages.
ATTRIBUTION = r"^[ \t]*(?:On|Am|Le|El) .*(?:wrote|schrieb|écrit|escribió)[^:]*:[ \t]*$"
PART_TURNS = 1024
_QUOTE, _ATTRIBUTION = re.compile(QUOTE), re.compile(ATTRIBUTION)


def split_quotes(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """The message's own text, and its quoted passages (level, lines): runs of quoted lines of one level. A line that introduces a quote, with at most blank lines between, is no own text."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    last = 0
    for line in (text or "").split("\n"):
        m = _QUOTE.match(line.rstrip("\r"))
        level = m.group(1).count(">") if m else 0
        if not m:
            own.append(line)
        elif level == last and passages:
            passages[-1][1].append(m.group(2))
        else:
            if not last:
                at = len(own) - 1
                while at >= 0 and not own[at].strip(" \t\r"):
                    at -= 1
                if at >= 0 and _ATTRIBUTION.match(own[at].rstrip("\r")):
                    del own[at]
            passages.append((level, [m.group(2)]))
        last = level
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n"), passages


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(text: str) -> set[str]:
    """The whole text, its paragraphs, lines and sentences, normalised."""
    out = {plain(t) for t in (text, *text.split("\n"))}
    for paragraph in re.split(r"\n[ \t]*\n", text):
        whole = plain(paragraph)
        out.add(whole)
        out.update(re.sub(r"([.!?]) ", "\\1\n", whole).split("\n"))
    return out - {""}


def _hash(piece: str) -> int:
    return xxhash.xxh64_intdigest(piece.encode()) - (1 << 63)


def units(own: str, passages: list[tuple[int, list[str]]], hash_of=_hash) -> list[tuple[int, int, str]]:
    """(level, hash, piece): pieces of the own text at level 0, of each quoted passage at its level."""
    out = {(0, t) for t in pieces(own)}
    for level, lines in passages:
        out |= {(level, t) for t in pieces("\n".join(lines))}
    return sorted((level, hash_of(t), t) for level, t in out)


def link_conversations(conversations: DataFrame, hash_of=_hash) -> DataFrame:
    """(conv_id, turn, role, thread, reply_to, n_quotes, max_level, text): every message without quotes.

    thread is the first turn of the replies a message belongs to (itself, if
    it quotes nothing that is found and nobody quotes it); reply order is
    (conv_id, thread, turn), in which a reply follows what it replies to.
    reply_to is null without a known original. Null texts are empty; rows with
    a null conv_id or turn are dropped; repeated (conv_id, turn) rows all stay
    and share their links; of equal originals the earliest counts; an empty
    table gives no rows; extra columns are ignored. Ids and turns may be any
    64-bit integers.
    """
    prepare(conversations.sparkSession)
    src = conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("piece", pa.string())]))

    def cut(batches):
        for b in batches:
            own, n, top, parts = [], [], [], []
            for text in b.column(3).to_pylist():
                mine, passages = split_quotes(text)
                own.append(mine)
                n.append(len(passages))
                top.append(max((p[0] for p in passages), default=0))
                parts.append([{"level": x, "hash": h, "piece": t if x else None} for x, h, t in units(mine, passages, hash_of)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(own, pa.string()), pa.array(n, pa.int64()), pa.array(top, pa.int64()), pa.array(parts, kind)], ["conv_id", "turn", "role", "own", "n_quotes", "max_level", "parts"])

    def verify(batches):
        """Keeps links whose quoted piece stands in the original's own text."""
        for b in batches:
            found = [t in plain(own) for t, own in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield b.filter(pa.array(found, pa.bool_())).select(["conv_id", "turn", "level", "source", "piece"])

    cut_ = materialize(src.mapInArrow(cut, "conv_id long, turn long, role string, own string, n_quotes long, max_level long, parts array<struct<level: int, hash: long, piece: string>>"), "messages")
    part = cut_.select("conv_id", "turn", F.explode("parts").alias("p")).select("conv_id", "turn", "p.*")
    quoted = part.where("level > 0").distinct()
    wanted = quoted.select("conv_id", "hash").distinct()
    originals = part.where("level = 0").join(wanted, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    links = quoted.join(originals, ["conv_id", "hash"]).where("source < turn")
    texts = cut_.select("conv_id", F.col("turn").alias("source"), "own")
    checked = links.join(texts, ["conv_id", "source"]).select("conv_id", "turn", "level", "source", "piece", "own").mapInArrow(verify, "conv_id long, turn long, level int, source long, piece string").distinct()
    votes = checked.groupBy("conv_id", "turn", "level", "source").agg(F.sum(F.length("piece")).alias("weight"))
    best = votes.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("weight")).alias("w"), "source")).alias("b")).select("conv_id", "turn", F.col("b.source").alias("reply_to"))
    best = materialize(best, "replies")
    threads = first_turns(best)
    told = best.select("conv_id", "turn", "reply_to").join(threads, ["conv_id", "turn"])
    out = cut_.drop("parts").join(told, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", F.coalesce("thread", "turn").alias("thread"), "reply_to", "n_quotes", "max_level", F.col("own").alias("text"))


def first_turns(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread): where the chain of replies (conv_id, turn, reply_to) of each message ends. Chains halve in every round."""
    up = replies.select("conv_id", "turn", F.col("reply_to").alias("thread"))
    while True:
        above = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_above"))
        now = up.join(above, ["conv_id", "thread"], "left")
        now = materialize(now.select("conv_id", "turn", F.coalesce("_above", "thread").alias("thread"), F.col("_above").isNotNull().alias("_moved")), "threads")
        moved = not now.where("_moved").isEmpty()
        if hasattr(up, "_strandweave_path"):
            discard(up)
        if not moved:
            return now.drop("_moved")
        path, up = now._strandweave_path, now.drop("_moved")
        up._strandweave_path = path


def render(linked: DataFrame, opening: str = "<|{role}|>\n", closing: str = "<|end|>\n") -> DataFrame:
    """Adds the column chat: each message between role marks, which concatenate in reply order to a training sample."""
    before, _, after = opening.partition("{role}")
    return linked.withColumn("chat", F.concat(F.lit(before), F.coalesce("role", F.lit("user")), F.lit(after), F.col("text"), F.lit("\n" + closing)))


def build_conversations(linked: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, thread, part, messages, n_messages, n_quotes, max_level, chat): threads in reply order.

    messages holds (turn, reply_to, role, text) by turn, chat the rendered
    text. A thread of any length is cut into parts by its turns, so that no
    task holds an unbounded one; parts join in their order. Repeated rows stay
    side by side, ordered by role and text.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("user")).alias("_r"), "text", "role", "reply_to", "chat")
    part = F.floor(F.col("turn") / part_turns).cast("long")
    grouped = render(linked).groupBy("conv_id", "thread", part.alias("part")).agg(F.array_sort(F.collect_list(one)).alias("m"), F.count(F.lit(1)).alias("n_messages"), F.sum("n_quotes").alias("n_quotes"), F.max("max_level").alias("max_level"))
    messages = F.transform("m", lambda x: F.struct(x["turn"].alias("turn"), x["reply_to"].alias("reply_to"), x["role"].alias("role"), x["text"].alias("text")))
    return grouped.select("conv_id", "thread", "part", messages.alias("messages"), "n_messages", "n_quotes", "max_level", F.array_join(F.transform("m", lambda x: x["chat"]), "").alias("chat"))
