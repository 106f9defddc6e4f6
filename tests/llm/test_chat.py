import itertools
import random

import numpy as np

from tally.llm import chat
from tally.llm.queries import queries

from .cases import words

SCHEMA = "conv_id long, turn long, role string, text string, chunk string"


def test_segments():
    assert chat.segments("hi\nUser: one\nmore\nAssistant: two\n**System**: three") == [(None, "hi"), (1, "one\nmore"), (2, "two"), (0, "three")]
    assert chat.segments("") == [(None, "")]
    assert chat.segments("plain text: no marker") == [(None, "plain text: no marker")]
    assert chat.segments("Human: a\nBot: b") == [(1, "a"), (2, "b")]


def test_words_of_their_own_are_markers_in_pairs_only():
    for text in ("Model: X100\nCustomer: Acme\nA: first option", "A: one\nB: two", "Question: why?\nQuestion: how?\nAnswer: so", "Answer: 42", "Client: Acme\nDate: today"):
        assert chat.segments(text) == [(None, text)]
    assert chat.segments("Q: why?\nA: so\nQ: how?\nA: thus") == [(1, "why?"), (2, "so"), (1, "how?"), (2, "thus")]
    assert chat.segments("Customer: hello\nAgent: good day") == [(1, "hello"), (2, "good day")]


def test_transcripts_with_lost_and_wrong_markers(spark):
    r, rows, want = random.Random(5), [], []
    for c in range(200, 260):
        for t in range(8):
            role = ("user", "assistant")[t % 2]
            body = words(r.randrange(10**6), 6 if role == "user" else 80)
            shown = r.choices([role, "assistant" if role == "user" else "user"], [0.9, 0.1])[0]
            want.append((c, body, role))
            rows.append((c, t, None, body if r.random() < 0.3 else f"{shown.title()}: {body}", "x"))
    talks = spark.createDataFrame(talk(60, 6), SCHEMA)
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA), chat.fit(talks)).collect()
    found = {(x.conv_id, x.rendered.split("\n", 1)[1].removesuffix("\n<|end|>\n")): x.role for x in got}
    right = sum(found.get((c, body)) == role for c, body, role in want)
    assert len(got) == len(rows) and right / len(want) > 0.95


def best(start, move, weights):
    paths = itertools.product(range(3), repeat=len(weights))
    value = lambda p: start[p[0]] + sum(weights[i][s] for i, s in enumerate(p)) + sum(move[a][b] for a, b in zip(p, p[1:]))
    return list(max(paths, key=value))


def test_viterbi_against_all_paths():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        start, move, weights = r.normal(size=3), r.normal(size=(3, 3)), r.normal(size=(n, 3))
        assert chat.viterbi(start, move, weights) == best(start, move, weights)
        assert np.isclose((start[:, None] + chat.span(move, weights)).max(), start[chat.viterbi(start, move, weights)[0]] + chat.span(move, weights)[chat.viterbi(start, move, weights)[0]].max())


def talk(n, turns):
    r, rows = random.Random(2), []
    for c in range(n):
        for t in range(turns):
            role = "user" if t % 2 == 0 else "assistant"
            rows.append((c, t, role, words(r.randrange(10**6), 6 if role == "user" else 80), "x"))
    return rows


def test_chunks_agree_with_one_pass(spark):
    rows = talk(30, 6) + [(99, t, "user" if t % 2 == 0 else "assistant", words(t, 6 if t % 2 == 0 else 80), "x") for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = chat.fit(df)
    got = chat.format_chats(df, model).where("conv_id = 99").orderBy("turn").collect()
    own = [r for r in rows if r[0] == 99]
    plain = np.array([model.weigh(r[3], None) for r in own])
    assert [chat.ROLES.index(r.blind_role) for r in got] == chat.viterbi(model.start, model.move, plain)
    assert all(r.role == r.recorded for r in got)
    assert got[0].rendered == f"<|user|>\n{own[0][3]}\n<|end|>\n"


def test_odd_rows(spark):
    rows = talk(20, 4) + [(None, None, None, None, "x"), (None, 3, "user", "alone", "x"), (5, None, "robot", "", "x"), (5, 0, "user", "User: a\nAssistant: b", "x"), (7, 1, "user", "same", "x"), (7, 1, "user", "same", "x"), (8, 2**40, "user", "far", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = chat.format_chats(df, chat.fit(df)).collect()
    assert len(got) == len(rows) + 1
    assert [r.role for r in got if r.conv_id == 5 and "\na\n" in r.rendered] == ["user"] and [r.role for r in got if "\nb\n" in r.rendered] == ["assistant"]
    none = spark.createDataFrame([], SCHEMA)
    assert chat.format_chats(none, chat.fit(none)).count() == 0


def test_held_out_roles(spark, sf_dir):
    rows = [r for r in queries()["op4_chat"](spark, sf_dir).collect() if r.held_out]
    assert rows and sum(r.blind_role == r.recorded for r in rows) / len(rows) > 0.9
    assert sum(r.role == r.recorded for r in rows) / len(rows) > 0.9
