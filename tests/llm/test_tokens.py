import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.llm import packing, token_orc
from tally.llm.queries import queries, vocabulary
from tally.llm.tokens import SEGMENT, Encoder

from .cases import no_docs, odd_docs, words


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    r = random.Random(3)
    parts = ["a", "foo", "Bar", "é", "É", " ", "  ", ",", ".", "\n", "!", "!!", "'s", "don't", "1", "½", "\t", "(", '"', "_", "漢字", " ", "😀", "…", "\r\n", "<|endoftext|>", "\x1f", "́"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [words(1, SEGMENT // 4), "x" * (SEGMENT + 5)]
    for text, got in zip(texts, Encoder(vocabulary()).encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library(text), text[:50]


def test_differencing_evens_out():
    r = random.Random(1)
    sizes = [r.randint(1, 256) for _ in range(500)]
    at = packing.windows(sizes, 1024)
    loads = np.bincount(at, weights=sizes)
    assert loads.max() <= 1024 and loads.sum() == sum(sizes) and len(loads) <= 1.03 * sum(sizes) / 1024 + 1
    assert packing.difference([8, 7, 6, 5, 4], 2).tolist() in ([0, 1, 1, 0, 0], [1, 0, 0, 1, 1], [0, 1, 0, 1, 1], [1, 0, 1, 0, 0])
    # too full for the first count of windows: it rises
    assert packing.windows([700] * 4, 1024).max() == 3


def test_packing_places_every_id_once(spark, library):
    docs = odd_docs(spark)
    rows = packing.pack(docs, vocabulary(), group=16).collect()
    sequences, pieces = {}, {}
    for p in rows:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        pieces.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    want = {}
    for d in docs.collect():
        ids = library(d.text) + [0]
        want.setdefault((d.doc_id, len(ids)), []).append(ids)
    assert {k: sorted(len(x) for x in v) for k, v in want.items()} == {k: [k[1]] * (sum(len(i) for _, i in v) // k[1]) for k, v in pieces.items()}
    for key, own in want.items():
        for start, ids in pieces[key]:
            assert any(w[start : start + len(ids)] == ids for w in own)
    assert packing.pack(no_docs(spark), vocabulary()).count() == 0


def test_orc_round_trip(spark, library, tmp_path):
    docs = odd_docs(spark)
    path = str(tmp_path / "tokens")
    token_orc.write_token_orc(docs, path, vocabulary(), files=3)
    rows = token_orc.read_token_orc(spark, path).orderBy("start").collect()
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert [r.doc_id for r in rows if r.doc_id is not None] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    assert sorted((r.doc_id or -1, r.ids) for r in rows) == sorted((d.doc_id or -1, library(d.text) + [2]) for d in docs.collect())
    assert token_orc.find_in_token_orc(spark, path, [7]).count() == 3
    token_orc.write_token_orc(no_docs(spark), str(tmp_path / "none"), vocabulary())
    assert token_orc.read_token_orc(spark, str(tmp_path / "none")).count() == 0


def test_orc_files_carry_bloom_filters(spark, tmp_path):
    path = tmp_path / "tokens"
    token_orc.write_token_orc(odd_docs(spark), str(path), vocabulary(), files=1)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = next(path.glob("part-*.orc"))
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000
    stripe = reader.getStripes().get(0)
    assert reader.getStripes().size() == 1 and stripe.getIndexLength() > 0
    columns = list(reader.getSchema().getFieldNames())
    streams = [(str(x.getKind()), x.getColumn()) for x in reader.rows().readStripeFooter(stripe).getStreamsList()]
    assert [c for k, c in streams if k.startswith("BLOOM_FILTER")] == [1 + columns.index("doc_id")]


def test_a_lookup_reads_few_rows(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    path = str(tmp_path / "tokens")
    token_orc.write_token_orc(docs, path, vocabulary(), files=2)
    found = token_orc.find_in_token_orc(spark, path, [12_345])
    assert [r.doc_id for r in found.collect()] == [12_345]
    rows = spark.read.schema(token_orc.SCHEMA).orc(path).where("doc_id = 12345")
    rows.collect()
    assert scanned(rows) <= 2000


def scanned(df):
    """Rows that the scan of an executed plan gave."""
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            return node.metrics().apply("numOutputRows").value()
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]


def test_queries(spark, sf_dir, library):
    from zlib import crc32

    docs = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, []
    for i in sorted(docs):
        ids = library(docs[i]) + [2]
        want.append((i, at, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = queries()["op6_token_orc"](spark, sf_dir)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    packed = queries()["op3_pack"](spark, sf_dir)
    for p in packed.collect():
        ids = library(docs[p.doc_id]) + [0]
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    total = packed.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert total[0] == at and total[0] / (1024 * total[1]) > 0.97
