import random

from strandweave.llm import chat_quotes, queries

SCHEMA = "conv_id long, turn long, role string, text string, thread string, chat string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA).repartition(3)


def brute(rows):
    """Reply and thread of each (conv, turn), by looking at every earlier message."""
    cut = {}
    for conv, turn, _, text in rows:
        own, passages = chat_quotes.split_quotes(text)
        cut.setdefault((conv, turn), []).append(chat_quotes.units(own, passages))
    reply = {}
    for (conv, turn), units in cut.items():
        votes = {}
        for level, h, w in {u for one in units for u in one if u[0] > 0}:
            sources = [t for (c, t), many in cut.items() if c == conv and any(v[0] == 0 and v[1] == h for one in many for v in one)]
            if sources and min(sources) < turn:
                votes[(level, min(sources))] = votes.get((level, min(sources)), 0) + len(w)
        if votes:
            reply[conv, turn] = min((lv, -w, s) for (lv, s), w in votes.items())[2]
    def root(k):
        while k in reply:
            k = (k[0], reply[k])
        return k[1]
    return {k: (reply.get(k), root(k)) for k in cut}


def check(df, rows):
    got = df.collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["reply_to"], r["thread"]) == want[r["conv_id"], r["turn"]], (r["conv_id"], r["turn"])
    return want


def test_query_matches_brute_force(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(chat_quotes.link_conversations(make(spark, rows)), rows)
    for name, links in (("op9_chat_quotes", False), ("chat_quotes_made", True)):
        got = queries.QUERIES[name](spark, sf_small).collect()
        assert sum(r["n_messages"] for r in got) == len(rows)
        assert (sum(r["n_messages"] > 1 for r in got) > 10) == links


def test_quotes_wrapped_anew_in_part_or_introduced(spark):
    text = "The first sentence is here. A second one follows it!\nAnd the third\nruns over lines."
    rows = [
        (5, -3, "user", text),
        (5, 1, "user", "On Monday, Ada <a@b.c> wrote:\n\n> the first   sentence\n> is here. A second one\n> follows it! And the third runs over lines.\nYes."),
        (5, 2, "assistant", "Le lundi, Ada a écrit :\n> A second one\n> follows it!\nNo."),
        (5, 3, "user", "Am Montag schrieb niemand:\nnothing quoted"),
        (5 + 2**40, 1, "user", "another one"), (5 + 2**40, 2, "user", "> another one\n!"), (-(2**63), 2**62, "user", "far"), (-(2**63), 2**63 - 1, "user", "> far\nout"),
    ]
    check(chat_quotes.link_conversations(make(spark, rows)), rows)
    got = {(r["conv_id"], r["turn"]): r for r in chat_quotes.link_conversations(make(spark, rows)).collect()}
    assert [got[5, t]["reply_to"] for t in (1, 2, 3)] == [-3, -3, None] and [got[5, t]["text"] for t in (1, 2)] == ["Yes.", "No."]
    assert got[5, 3]["text"] == "Am Montag schrieb niemand:\nnothing quoted"
    assert got[5 + 2**40, 2]["thread"] == 1 and got[-(2**63), 2**63 - 1]["thread"] == 2**62


def test_equal_hashes_of_other_words_do_not_link(spark):
    rows = [(1, 0, "user", "abcd"), (1, 1, "user", "> dcba\nno"), (1, 2, "user", "> abcd\nyes")]
    got = {r["turn"]: r["reply_to"] for r in chat_quotes.link_conversations(make(spark, rows), lambda piece: len(piece)).collect()}
    assert got == {0: None, 1: None, 2: 0}


def test_conversations_are_built_in_reply_order_and_parts(spark):
    rows = [(1, t, "user", f"m{t}" if t < 1 else f"> m0\nm{t}") for t in range(0, 3000, 7)] + [(1, 1, None, "alone")]
    made = chat_quotes.build_conversations(chat_quotes.link_conversations(make(spark, rows))).orderBy("thread", "part").collect()
    assert [(r["thread"], r["part"]) for r in made] == [(0, 0), (0, 1), (0, 2), (1, 0)]
    turns = [m["turn"] for r in made[:3] for m in r["messages"]]
    assert turns == list(range(0, 3000, 7)) and all(m["reply_to"] == 0 for m in made[1]["messages"])
    assert made[3]["chat"] == "<|user|>\nalone\n<|end|>\n" and made[3]["messages"][0]["role"] is None


def test_nested_and_reworded_quotes(spark):
    r = random.Random(5)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = []
    for conv in range(40):
        texts = []
        for turn in range(r.randint(1, 9)):
            text = "\n".join(" ".join(r.choice(words) for _ in range(r.randint(2, 6))) for _ in range(r.randint(1, 3)))
            if texts and r.random() < 0.7:
                quoted = r.choice(texts)
                text = "\n".join(r.choice(["> ", ">", "  > "]) + line.upper() for line in quoted.split("\n")) + "\n" + text
            texts.append(text)
            rows.append((conv, turn, "user", text))
    check(chat_quotes.link_conversations(make(spark, rows)), rows)


def test_texts_lose_their_quotes_and_keep_the_rest(spark):
    rows = [(1, 0, "user", "first line\nsecond line"), (1, 1, "assistant", "> first line\n> second line\nan answer"), (1, 2, "user", ">> first line\n> an answer\nthanks"), (1, 3, None, "no quote")]
    got = {r["turn"]: r for r in chat_quotes.render(chat_quotes.link_conversations(make(spark, rows))).collect()}
    assert [got[t]["text"] for t in range(4)] == ["first line\nsecond line", "an answer", "thanks", "no quote"]
    assert [got[t]["reply_to"] for t in range(4)] == [None, 0, 1, None]
    assert [got[t]["thread"] for t in range(4)] == [0, 0, 0, 3]
    assert got[2]["max_level"] == 2 and got[2]["n_quotes"] == 2
    assert got[1]["chat"] == "<|assistant|>\nan answer\n<|end|>\n" and got[3]["chat"].startswith("<|user|>")


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, ""), (1, 2, "user", "> \n>\n"), (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 1, "user", "> same"), (2, 1, "user", "> same"), (3, 5, "user", "> nowhere"), (4, 0, "user", "x " * 100_000), (4, 1, "user", "> " + "x " * 100_000)]
    check(chat_quotes.link_conversations(make(spark, rows)), rows)
    lost = [(None, 0, "user", "a"), (1, None, "user", "a")]
    assert chat_quotes.link_conversations(make(spark, lost)).count() == 0
    assert chat_quotes.link_conversations(make(spark, [])).count() == 0
