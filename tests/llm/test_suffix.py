import hashlib
import random
import re

import numpy as np
import pytest

from tally.llm import passages, suffix_dedup
from tally.llm.common import row_key
from tally.llm.queries import queries

from .cases import no_docs, odd_docs, words


def brute(texts, width):
    """Covered bytes of each text."""
    count = {}
    for t in texts:
        for p in range(len(t) - width + 1):
            w = t[p : p + width]
            count[w] = count.get(w, 0) + 1
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if count[t[p : p + width]] > 1:
                mask[p : p + width] = True
        out.append(mask)
    return out


def check(rows, texts, width):
    for t, mask in zip(texts, brute(texts, width), strict=True):
        key = bytes(np.frombuffer(t, np.uint8)[~mask])
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        assert (len(t), key, spans) in rows, t[:60]


def mosaic(seed, n):
    """Texts put together from shared parts of all lengths, with changes and runs."""
    r = random.Random(seed)
    parts = [words(seed + k, r.randint(3, 40)).encode() for k in range(12)] + [b"ab" * 90, b"#" * 150]
    out = []
    for _ in range(n):
        t = bytearray(b"".join(r.choice(parts) for _ in range(r.randint(1, 6))))
        for _ in range(r.randint(0, 2)):
            if t:
                t[r.randrange(len(t))] = r.randrange(97, 123)
        out.append(bytes(t))
    return out


@pytest.mark.parametrize("group, crowd", [(256, 50_000), (2, 50_000), (2, 3)])
def test_against_all_windows(spark, monkeypatch, group, crowd):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    texts = list(dict.fromkeys(mosaic(5, 60)))
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for width in (60, 120):
        rows = {(r.n_bytes, bytes(r.kept), len(r.removed)) for r in suffix_dedup.dedup(df, width).collect()}
        check(rows, texts, width)


def test_anchors_depend_on_the_window_alone():
    data = np.frombuffer(words(1, 400).encode(), np.uint8)
    shifted = np.frombuffer(b"zz" + data.tobytes(), np.uint8)
    a, b = (dict((w, p - w) for f, last, p in zip(*suffix_dedup.stretches(x, 100)[2:]) for w in range(f, last + 1)) for x in (data, shifted))
    assert all(b[w + 2] == p for w, p in a.items()) and len(a) == len(data) - 99


def test_pieces_of_long_documents_meet(monkeypatch):
    data = np.frombuffer(words(1, 3000).encode(), np.uint8)
    windows = lambda s: sorted((w, p) for f, last, p in zip(*s[2:]) for w in range(f, last + 1))
    whole = windows(suffix_dedup.stretches(data, 100))
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    assert windows(suffix_dedup.stretches(data, 100)) == whole


def test_deep_shallow_sort_groups_equal_windows():
    r = random.Random(2)
    data = b"".join(r.choice([b"abcabcabcabc", b"abcabcabcabd", b"xyz"]) for _ in range(300))
    at = np.arange(len(data) - 40)
    got = suffix_dedup.equal_windows(data, np.zeros(len(at), np.int64), at, 40, 16)
    want = {}
    for p in at.tolist():
        want.setdefault(data[p : p + 40], []).append(p)
    assert sorted(map(sorted, got)) == sorted(v for v in want.values() if len(v) > 1)


def test_odd_rows(spark):
    odd = odd_docs(spark)
    texts = [(r.text or "").encode() for r in odd.collect()]
    rows = suffix_dedup.dedup(odd).collect()
    assert len(rows) == len(texts)
    check({(r.n_bytes, bytes(r.kept), len(r.removed)) for r in rows}, texts, 400)
    assert suffix_dedup.dedup(no_docs(spark)).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries()["op7_suffix_dedup"](spark, sf_dir).collect()}
    for d, mask in zip(docs, brute([d.text.encode() for d in docs], 400), strict=True):
        r = got[d.doc_id]
        raw = np.frombuffer(d.text.encode(), np.uint8)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(raw), int(mask.sum()), hashlib.sha256(raw[~mask].tobytes()).hexdigest())


def brute_sharing(docs, n):
    """Texts by place that hold n words in a row which another one holds."""
    runs = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in (re.findall(r"[0-9a-z_]+", t) for t in docs)]
    return {i for i, a in enumerate(runs) for j, b in enumerate(runs) if i != j and a & b}


def test_passages_against_all_runs(spark):
    r, docs = random.Random(3), []
    shared = [words(800 + k, 40).split() for k in range(6)]
    for i in range(60):
        part = shared[r.randrange(6)] if r.random() < 0.6 else []
        a = r.randrange(0, 25)
        part = part[a : a + r.choice([8, 11, 12, 13, 20, 40])]
        docs.append(" ".join([*words(i, r.randrange(0, 30)).split(), *part, *words(500 + i, r.randrange(0, 30)).split()]))
    docs += [docs[0], "", "one two"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    keys = {x.row: x.doc_id for x in df.select("doc_id", row_key("doc_id", "text").alias("row")).collect()}
    for n, gram in ((12, 4), (12, 8), (20, 5)):
        got = {keys[x.row] for x in passages.sharing(df, n, gram).collect()}
        assert got == brute_sharing(docs, n)


def test_passages_odd_rows(spark):
    odd = odd_docs(spark)
    got = passages.sharing(odd)
    own = odd.select("doc_id", row_key("doc_id", "text").alias("row")).join(got, "row").collect()
    assert sorted(str(x.doc_id) for x in own) == ["5", "6", "7", "7", "8", "None"]
    assert passages.sharing(no_docs(spark)).count() == 0
