import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tally.llm import pii
from tally.llm.boosting import Boosted
from tally.llm.queries import queries

from .cases import no_docs, odd_docs


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        s += v // 10 + v % 10
    return s % 10 == 0


def plain(t):
    """The rules as written."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+ 0123459()é\n", max_size=40))
def test_base_spans_follow_the_rules(text):
    assert pii.base_spans(text) == plain(text)


def test_base_examples():
    text = "mail me.x@a-b.co.uk or 10.0.0.255 or 4111 1111 1111 1111, +1 (368) 555-0098; 1.2.3.999 x@y"
    assert [text[a:b] for _, a, b in pii.base_spans(text)] == ["me.x@a-b.co.uk", "10.0.0.255", "4111 1111 1111 1111", "+1 (368) 555-0098"]
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []
    assert pii.redact(text, pii.base_spans(text)).startswith("mail [EMAIL] or [IP] or [CARD], [PHONE];")


def test_trees_learn_and():
    x = np.random.default_rng(1).random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] > 0.3)).astype(float)
    model = Boosted().fit(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97


def people(n, first=0):
    """Texts with one base span each, and numbers that are none."""
    kinds = ["call +1 (368) 555-{:04d} now", "write to name.{}@host.example.org soon", "card 4111 1111 1111 1111 of {}", "server 10.0.{}.7 is down"]
    return [(first + i, f"{kinds[i % 4].format(i % 250)} or see {i} 77{i % 10} 12{i % 7} 9 then, chapter 3.1.{i} and 2020-10-1{i % 9}") for i in range(n)]


def test_disguised_spans_are_found(spark):
    docs = spark.createDataFrame(people(3000), "doc_id long, text string")
    model = pii.fit(docs)
    assert set(model.thresholds) == set(pii.KINDS)
    r, right, taken, wanted = random.Random(1), 0, 0, 0
    for _, text in people(400, 10_000):
        ((kind, a, b),) = pii.base_spans(text)
        made = pii.disguise(kind, text[a:b], r)
        other = text[:a] + made + text[b:]
        found = [s for s in model.spans(other) if not s[3]]
        wanted += not any(s[3] for s in model.spans(other))
        taken += len(found)
        right += any(pii.overlap((kind, a, a + len(made)), s) >= 0.8 for s in found)
        assert not [s for s in model.spans(text) if not s[3]]
    assert right > 0.8 * wanted and right > 0.95 * taken


def test_learned_spans_stay_beside_base(spark):
    docs = spark.createDataFrame(people(1200) + [(5000 + i, f"call (368) 555-{i:04d} now and +1 368 555 0199") for i in range(40)], "doc_id long, text string")
    rows = pii.find(docs, pii.fit(docs)).collect()
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == pii.base_spans(r.text)
        own = sorted((s.start, s.end) for s in r.spans)
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))
    assert sum(len(r.spans) == 2 for r in rows if r.doc_id >= 5000) > 30


def test_all_documents_are_learned_from(spark):
    rows = people(2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [case for doc, text in rows for case in pii.cases(text, doc)]
    got = pii.counted(docs).agg({"positive": "sum", "negative": "sum"}).first().asDict()
    assert (got["sum(positive)"], got["sum(negative)"]) == (sum(c[1] for c in want), sum(1 - c[1] for c in want))


def test_trees_are_the_same_summed_by_spark(spark, monkeypatch):
    monkeypatch.setattr(Boosted.__init__, "__defaults__", (3, 0.3, 1, *Boosted.__init__.__defaults__[3:]))
    docs = spark.createDataFrame(people(800), "doc_id long, text string")
    one, two = pii.fit(docs, held=10**9), pii.fit(docs, held=0)
    assert set(one.trees) == set(two.trees) == set(pii.KINDS) and one.thresholds == two.thresholds
    for kind in pii.KINDS:
        for a, b in zip(one.trees[kind].trees, two.trees[kind].trees, strict=True):
            assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_odd_rows(spark):
    odd = odd_docs(spark)
    model = pii.fit(odd)
    rows = pii.find(odd, model).collect()
    assert len(rows) == odd.count() and all(r.spans == [] for r in rows)
    assert pii.find(no_docs(spark), pii.fit(no_docs(spark))).count() == 0


def test_query(spark, sf_dir):
    docs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in queries()["op2_pii"](spark, sf_dir).collect():
        base = plain(docs[r.doc_id])
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(",")) and (r.n_spans, r.n_learned) == (len([x for x in r.spans.split(",") if x]), r.n_spans - len(base))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in pii.KINDS)
