import random

import numpy as np

from tally.llm import decontam
from tally.llm.queries import queries

from .cases import no_docs, odd_docs, words

ITEM = "A farmer named Maria drove 35 km to the market with 12 crates, sold each crate for 7 dollars and drove 35 km back; how much did Maria earn in all?"


def leaks(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in decontam.leaks(docs, spark.createDataFrame(list(items), "item_id long, text string")).collect()}


def test_templates():
    t, v, first = decontam.templates(["Then Ann Lee ran 5 km. Éa foo", "then Bob ran 77 miles. éa foo", ""])
    a, b = t[first[0] : first[1]], t[first[1] : first[2]]
    assert a.tolist() == b.tolist() and len(a) == 7 and first.tolist() == [0, 7, 14, 14]
    assert decontam.is_slot(a).tolist() == [False, True, False, True, True, False, False]


def test_verbatim_changed_and_inconsistent(spark):
    changed = ITEM.replace("Maria", "Olga").replace("35", "80").replace("12", "9")
    mixed = ITEM.replace("35 km to", "80 km to").replace("named Maria", "named Olga")
    texts = [f"{words(1, 30)}. {ITEM} {words(2, 30)}", f"{words(3, 30)}\n{changed}", words(4, 80), mixed, ITEM[: len(ITEM) // 4], ITEM.lower().replace("maria", "Maria")]
    got = leaks(spark, texts)
    assert got[0, 1] == "verbatim" and got[1, 1] == "reparameterised" and (2, 1) not in got and (4, 1) not in got and (5, 1) in got
    # 35 stands for two values, and Maria for two names: what agrees isn't enough or is reported without the clash
    assert got.get((3, 1)) in (None, "reparameterised")


def test_capitals_do_not_hide_an_item(spark):
    plain = words(8, 30)
    assert set(leaks(spark, [f"So. {plain.upper()}"], [(1, plain)])) == {(0, 1)}
    t, _, _ = decontam.templates(["we met Ann, I say, at NASA in Étretat"])
    assert decontam.is_slot(t).tolist() == [False, False, True, False, False, False, False, False, True]


def test_slots_must_agree():
    index = decontam.Index([(1, "the box has 5 red and 5 blue balls with 5 more of green ones in all")], 6, 3)
    text = lambda a, b, c: f"the box has {a} red and {b} blue balls with {c} more of green ones in all"
    run = lambda t: [x[4] for x in decontam._leaks(*decontam.templates([t]), index, 0.5)]
    assert run(text(5, 5, 5)) == ["verbatim"] and run(text(8, 8, 8)) == ["reparameterised"] and run(text(8, 9, 7)) == []


def test_short_items_and_many(spark):
    items = [(1, "only four plain words"), (2, None), (3, ""), (4, "only four plain words")]
    assert set(leaks(spark, ["so only four plain words stand", "only four words"], items)) == {(0, 1), (0, 4)}
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    many = spark.createDataFrame([(i, ITEM if i == 77 else words(i, 20)) for i in range(100)], "item_id long, text string")
    assert [r.item_id for r in decontam.leaks(docs, many).collect()] == [77]


def test_items_of_numbers_and_names(spark):
    items = [(1, "What is 12 + 7 * 3?"), (2, "Solve: 3x + 12 = 27, 5y - 4 = 11, 8z / 2 = 16"), (3, "Calculate 25 * 48 - 310 / 5 + 17."), (4, "Maria has 5 cats. Peter has 3 dogs. Olga has 9 birds. How many pets?"), (5, "sold for 900 in the town of his birth last spring")]
    names = items[3][1].replace("Maria", "Ines").replace("Peter", "Hugo").replace("Olga", "Vera")
    texts = [*(f"{words(k, 20)}. {t}" for k, t in items), names, items[4][1].replace("900", "1,200"), items[4][1].replace("900", "3.5"), "Calculate 26 * 49 - 311 / 6 + 18.", words(9, 60), "in 7 8 9 10 11 12 13 14"]
    got = leaks(spark, texts, items)
    assert {k: got.get((k, k + 1)) for k in range(5)} == dict.fromkeys(range(5), "verbatim")
    assert got[5, 4] == got[6, 5] == got[7, 5] == got[8, 3] == "reparameterised" and len(got) == 9


def brute(docs, items):
    """Each document against each item by itself: no bitmap, no join."""
    out = {}
    for d, text in docs:
        for i, item in items:
            for openers in (False, True):
                for *_, kind in decontam._leaks(*decontam.templates([text], openers), decontam.Index([(i, item)], 8, 4, openers), 0.5):
                    out[d, i] = max(kind, out.get((d, i), ""))
    return out


def test_against_each_pair_with_changed_names_and_numbers(spark):
    r = random.Random(6)
    names, kinds = ["Maria", "Olga", "Peter", "Ines"], ["crates", "boxes", "barrels", "sacks"]
    make = lambda k: f"{words(100 + k % 9, 4)} {r.choice(names)} drove {r.randrange(2, 99)} km with {r.randrange(2, 99)} {kinds[k % 4]}, sold each for {r.randrange(2, 99)} dollars and told {r.choice(names)} so"
    items = [(k, make(k)) for k in range(40)]
    docs = [(k, f"{words(k, 20)}. {make(k)} {words(900 + k, 10)}" if k % 3 else words(k, 60)) for k in range(60)] + [(100 + k, items[k][1]) for k in range(5)]
    got = {(x.doc_id, x.item_id): x.kind for x in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) and len(got) > 100 and {"verbatim", "reparameterised"} == set(got.values())


def test_odd_rows(spark):
    odd = odd_docs(spark)
    bench = spark.createDataFrame([(1, words(2, 300)), (2, None)], "item_id long, text string")
    got = sorted(str(r.doc_id) for r in decontam.leaks(odd, bench).collect())
    assert got == ["7", "7", "8", "None"]
    kept = decontam.decontaminate(odd, bench)
    # of the rows with id 7 the one with another text stays, and of those without an id none
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "10", "2", "3", "4", "5", "6", "7", "9"]
    assert decontam.leaks(odd, bench.limit(0)).count() == 0 == decontam.leaks(no_docs(spark), bench).count()


def test_query(spark, sf_dir):
    got = {(r.doc_id, r.item_id) for r in queries()["op9_decontamination"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    whole = {(d.doc_id, b.item_id) for d in docs for b in items if b.text in d.text}
    assert whole <= got and len(got) <= len(whole) + 3
    assert np.all([d >= 0 for d, _ in got])
