import random
import zlib

import numpy as np

from tally.llm import toxicity
from tally.llm.queries import queries
from tally.llm.toxicity import INSULT, NEGATION, OTHER, REPORT, TARGET, THREAT

from .cases import no_docs, odd_docs, words


def test_grammar_weighs_clauses():
    score = lambda *s: toxicity.grammar().clause([(x, 4.0 if x == INSULT else 0.5 if x == THREAT else 0.0) for x in s])
    assert score(OTHER, OTHER) == 0
    assert score(TARGET, INSULT) > score(INSULT) > score(NEGATION, INSULT) > 0
    assert score(REPORT, INSULT) < score(INSULT)
    assert score(NEGATION, OTHER, OTHER, OTHER, INSULT) == score(INSULT)
    assert score(THREAT, OTHER, TARGET) > score(THREAT)
    assert score(INSULT, INSULT) > 2 * score(INSULT)


def labelled(spark, n=400):
    r, docs, labels = random.Random(1), [], []
    for i in range(n):
        bad = i % 4 == 0
        text = words(i, 60).split()
        for _ in range(3 * bad):
            text.insert(r.randrange(len(text)), "zzgrot" + r.choice(["o", "ia", "um"]))
        docs.append((i, " ".join(text) + "."))
        labels.append((i, 1 if bad else 0))
    labels += [(0, None), (None, 1), (10**9, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_stems_and_scores_held_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert any(s.startswith("zzg") for s in model.stems)
    rows = toxicity.score(docs, model).collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) > 40 and all((r.toxicity >= 0.5) == (r.doc_id % 4 == 0) for r in out)
    kept = {r.doc_id for r in toxicity.clean(docs, labels).collect()}
    assert kept == {i for i in range(400) if i % 4}


def test_odd_rows(spark):
    docs, labels = labelled(spark)
    model, odd = toxicity.fit(docs, labels), odd_docs(spark)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.toxicity <= 1 for r in rows)
    assert {r.toxicity for r in rows if not (r.text or "").strip()} == {model.probability(np.zeros((1, 3)))[0]}
    kept = toxicity.clean(odd, labels)
    assert kept.columns == odd.columns and {r.toxicity for r in kept.collect()} <= {"t", None}
    assert toxicity.score(no_docs(spark), model).count() == 0
    assert toxicity.fit(no_docs(spark), labels).stems == {}
    assert toxicity.fit(docs, labels.limit(0)).stems == {}


def test_query(spark, sf_dir):
    rows = queries()["op1_toxicity"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
