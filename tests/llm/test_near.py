import random
import re
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tally.llm import line_dedup, ngram_join
from tally.llm.common import mark, release
from tally.llm.components import components
from tally.llm.queries import queries
from tally.llm.wordhash import shingle_sets

from .cases import no_docs, odd_docs, words


class Forest:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    forest = Forest(3000)
    for a, b in edges:
        a, b = sorted((forest.find(a), forest.find(b)))
        forest.up[b] = a
    least = defaultdict(lambda: 10**9)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    for x in nodes:
        least[forest.find(x)] = min(least[forest.find(x)], x)
    got = {tuple(r) for r in components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()}
    assert got == {(x, least[forest.find(x)]) for x in nodes}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_shingles():
    a, b = shingle_sets(["One two, three four five six!", "one TWO three  four five six"], 5)
    assert a.tolist() == b.tolist() and len(a) == 2
    assert [len(s) for s in shingle_sets(["", "a b", "a b c d e"], 5)] == [0, 1, 1]
    long = words(1, 4000)
    assert len(shingle_sets([long, "x"], 5)[0]) == 3996


def brute(docs):
    """class and links of each row: docs are (doc_id, text)."""
    sets = [set(s.tolist()) for s in shingle_sets([t or "" for _, t in docs], 5)]
    forest, links = Forest(len(docs)), [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                forest.up[forest.find(i)] = forest.find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[forest.find(i)] = min(least.get(forest.find(i), doc), doc)
    return sorted((str(d), str(least.get(forest.find(i))), links[i]) for i, (d, _) in enumerate(docs))


def near_copies(n, size=60):
    r, base = random.Random(4), words(9, size).split()
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(r.choice([0, 1, 1, 2])):
            own[r.randrange(size)] = f"new{r.randrange(10**6)}"
        out.append((i, " ".join(own)))
    return out + [(n + i, words(500 + i, size)) for i in range(10)]


@pytest.mark.parametrize("block", [1024, 8])
def test_join_against_all_pairs(spark, block):
    docs = near_copies(40)
    got = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), block=block).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute(docs)


def test_recall_by_length():
    assert ngram_join.recall_of([100] + [0] * 19, 0.8, 32, 8) < 0.9995 < ngram_join.recall_of([100] + [0] * 19, 0.8, 32, 5)
    assert ngram_join.recall_of([0] * 19 + [100], 0.8, 32, 8) > 0.9995
    assert ngram_join.recall_of([0] * 20, 0.8, 32, 8) == 1


def test_prefixes_are_shortened_for_weak_links(spark):
    r, docs = random.Random(8), []
    for i in range(120):  # pairs of a similarity just over the threshold: 46 of 56 shingles shared
        base = words(1000 + i, 55).split()
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:50], *words(5000 + i, 5).split()]))]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((str(x.doc_id), str(x.class_id), x.n_links) for x in ngram_join.join(df).collect())
    assert got == brute(docs) and sum(x[2] for x in got) == 240
    deep = ngram_join.join(df, recall=0.5).collect()
    assert 150 < sum(x.n_links for x in deep) <= 240


def test_tries_against_all_prefixes(spark):
    r = np.random.default_rng(3)
    symbols = r.integers(0, 3, (200, 2, 4))  # two tries of four symbols
    nodes = spark.createDataFrame([(i, symbols[i].astype(">u2").tobytes()) for i in range(200)], "node long, paths binary").repartition(7)
    links = ngram_join.tries(nodes, 2, 4, 1).collect()
    for depth in (1, 2, 3, 4):
        want, got = Forest(200), Forest(200)
        for t in range(2):
            first = {}
            for i in range(200):
                j = first.setdefault(tuple(symbols[i, t, :depth]), i)
                want.up[want.find(i)] = want.find(j)
        for x in links:
            if x.depth >= depth:
                got.up[got.find(x.src)] = got.find(x.dst)
        told = {x.node: x.root for x in ngram_join.clustered(spark.createDataFrame([tuple(x) for x in links if x.depth >= depth], "src long, dst long, depth int, tree int"), 1).collect()}
        assert len({want.find(i) for i in told}) == len(set(told.values())) and all(want.find(i) == want.find(r) for i, r in told.items())
        groups = lambda f: {frozenset(i for i in range(200) if f.find(i) == root) for root in {f.find(i) for i in range(200)}}
        assert groups(want) == groups(got)


def test_one_row_of_a_component_stays(spark):
    a, b, c = words(1, 60), words(2, 60), words(3, 60)
    docs = [(1, a), (1, a), (1, b), (2, a), (None, b), (None, c), (None, c), (4, ""), (4, ""), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(map(tuple, ngram_join.keep_one(df).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, c), (4, ""), (4, ""), (5, None)], key=str)


def test_join_odd_rows(spark):
    odd = odd_docs(spark)
    got = ngram_join.join(odd).collect()
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == want
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert ngram_join.join(no_docs(spark)).count() == 0 == ngram_join.keep_one(no_docs(spark)).count()


def test_join_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op5_ngram_join"](spark, sf_dir).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == brute(docs)


def test_rounds_leave_no_shuffles(spark):
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    release(spark)
    time.sleep(1)
    before, chain = files(), list(range(500))
    random.Random(2).shuffle(chain)
    got = components(spark.createDataFrame(list(zip(chain, chain[1:])), "src long, dst long"))
    until = time.time() + 10
    while files() > before + 100 and time.time() < until:  # Spark deletes in the background
        time.sleep(0.2)
    assert files() <= before + 100
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(500)]


def test_rounds_of_few_edges_are_one_task_each(spark):
    sc, chain = spark.sparkContext, list(range(30))
    random.Random(2).shuffle(chain)
    edges = [*zip(chain, chain[1:]), *[(1000, 1000 + i) for i in range(90)]]
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    tasks, found = {}, {}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for few in (0, 10**6):
            group = f"edges{few}"
            sc.setJobGroup(group, group)
            found[few] = sorted(map(tuple, components(spark.createDataFrame(edges, "src long, dst long"), few=few).collect()))
            jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
            tasks[few] = sum(sc.statusTracker().getStageInfo(s).numCompletedTasks for j in jobs for s in j.stageIds if sc.statusTracker().getStageInfo(s))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found[0] == found[10**6] == [(i, 0) for i in range(30)] + [(1000 + i, 1000) for i in range(90)]
    assert 4 * tasks[10**6] < tasks[0]


def test_lines_leave_their_result_only(spark):
    base, begun = words(9, 30), mark()
    docs = [(i, base[:-3] + f"{i:03}") for i in range(200)] + [(1000 + i, words(100 + i, 20)) for i in range(50)]
    got = line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string"), direct=1)
    assert mark() - begun == 3  # lines, classes and the first lines of these
    assert sorted(r.doc_id for r in got.collect()) == sorted(brute_lines(docs))


def brute_lines(docs):
    """The places of lines that go, by doc_id; docs are (doc_id, text) with distinct ids. All pairs that share a string of nine characters are compared."""
    lines = sorted((i, p, x.strip(" ").lower()) for i, t in docs for p, x in enumerate((t or "").split("\n")) if x.strip(" "))
    sets = {x: {x[k : k + 9] for k in range(max(1, len(x) - 8))} for *_, x in lines}
    texts, forest = list(sets), Forest(len(sets))
    post = defaultdict(list)
    for k, x in enumerate(texts):
        for s in sets[x]:
            post[s].append(k)
    shared = Counter(pair for own in post.values() for pair in combinations(own, 2))
    for (i, j), n in shared.items():
        if 5 * n >= 4 * (len(sets[texts[i]]) + len(sets[texts[j]]) - n):
            forest.up[forest.find(i)] = forest.find(j)
    seen, gone, place = set(), defaultdict(list), {x: k for k, x in enumerate(texts)}
    for i, p, x in lines:
        root = forest.find(place[x])
        if root in seen:
            gone[i].append(p)
        seen.add(root)
    return gone


def test_lines_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    gone = brute_lines(docs)
    got = queries()["op10_line_dedup"](spark, sf_dir).collect()
    assert len(got) == len(docs) and gone
    for r in got:
        assert r.removed == ",".join(map(str, gone[r.doc_id])) and r.n_removed == len(gone[r.doc_id])
        assert r.n_lines == len(dict(docs)[r.doc_id].split("\n"))


def test_lines_native_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = line_dedup.dedup(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_lines_of_small_docs(spark):
    line = "this line of license text stands in many documents of the corpus and is long enough to be shingled well by anyone who cares"
    near = line.replace("license", "licence")
    docs = [(1, f"first own words here\n{line}\n\nshort"), (2, f"{near}\nsecond own words here\nshort"), (3, line), (4, None), (5, ""), (6, f"  {line.upper()}  \nthird own words here")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.dedup(df).collect()}
    assert got[1] == (docs[0][1], len(docs[0][1])) and got[2] == ("second own words here", 21) and 3 not in got
    assert got[4][0] is None and got[5][0] == "" and got[6][0] == "third own words here"


def test_unlike_lines_stay(spark):
    texts = [
        "Total amount: $ 100", "Total amount: $ 999", "https://example.org/alpha-and-omega", "https://example.org/completely-different-path", "the price of item is 100", "the price of item is 250",
        "これは日本語の長い文章の例であり、最初の部分は同じです。", "これは日本語の長い文章の例であり、終わりがまったく違うものになる。", "iVBORw0KGgoAAAANSUhEUgAAAAUAAAAFCAYAAACNbyblAAAA", "iVBORw0KGgoAAAANbbbcccdddeeefffggghhhiiijjjkkklll",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_removed for r in line_dedup.report(docs).collect()] == [0] * len(texts)


def test_short_and_blank_lines(spark):
    docs = spark.createDataFrame([(1, "ok\n\nfine\n  "), (2, "OK\n\nfind"), (3, " fine ")], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.report(docs).collect()} == {1: "", 2: "0", 3: "0"}


@pytest.mark.parametrize("hot, block, direct", [(line_dedup.HOT, line_dedup.BLOCK, line_dedup.DIRECT), (1, 16, 1)])
def test_lines_of_a_large_family(spark, hot, block, direct):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base, docs = word(100), []
    for _ in range(150):  # a pair differs in its last two letters, families in twenty before them
        own = word(22)
        docs += [(len(docs) + k, base + own + word(2)) for k in range(2)]
    docs += [(1000 + k, word(120)) for k in range(50)]
    got = line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot, block=block, direct=direct).collect()
    gone = brute_lines(docs)
    assert len(gone) == 150 and {x.doc_id for x in got} == set(gone)


def test_lines_odd_rows(spark):
    odd = odd_docs(spark)
    out = line_dedup.dedup(odd)
    assert out.columns == odd.columns and 5 in {r.doc_id for r in out.collect()} and 6 not in {r.doc_id for r in out.collect()}
    assert line_dedup.report(odd).count() == odd.count()
    assert line_dedup.dedup(no_docs(spark)).count() == 0 == line_dedup.report(no_docs(spark)).count()


def test_digest_tells_sets_apart():
    r = np.random.default_rng(1)
    sets = [np.sort(r.integers(0, 2**63, n, dtype=np.uint64)) for n in range(1, 200)]
    assert len({ngram_join.digest(s) for s in sets}) == 199
