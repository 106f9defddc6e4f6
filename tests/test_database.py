import json

import pytest

from tally import cli
from tally.database import Database
from tally.plans import service
from tally.schema import POSTINGS_IN
from tally.sources.tables import RowTable, read_log
from tally.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rows(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    assert db.row_count == 0 and db.columns == []
    db.bulk_insert([])
    db.insert({"account": "cash", "amount": 100})
    db.bulk_insert([{"amount": 200, "account": "bank"}, {"account": "cash", "amount": 300}])
    assert db.row_count == 3 and db.columns == ["account", "amount"]
    assert rows(db.filter_eq("account", "cash")) == [("cash", 100), ("cash", 300)]
    assert db.validate_filter_index("account", "cash")
    assert [tuple(r) for r in db.read_rows_by_ids([2, 0]).collect()] == [("cash", 300), ("cash", 100)]
    assert rows(db.read_column("amount")) == [(100,), (200,), (300,)]
    with pytest.raises(ValueError):
        db.insert({"account": "a", "currency": "x"})
    with pytest.raises(ValueError):
        db.insert({})
    again = Database(spark, str(tmp_path / "db"))
    assert again.row_count == 3
    assert again.prefix_sum("amount").range_sum(0, 2) == 300.0
    again.close()


def test_groups_and_join(spark, tmp_path):
    a, b = Database(spark, str(tmp_path / "a")), Database(spark, str(tmp_path / "b"))
    a.bulk_insert([{"group": g, "amount": v} for g, v in ((1, 10), (2, 5), (1, 20), (2, 7))])
    assert [tuple(r) for r in a.group_by("group", "amount").collect()] == [(1, 30.0, 2, 15.0), (2, 12.0, 2, 6.0)]
    assert a.prefix_sum("amount").range_avg(0, 4) == 10.5
    b.bulk_insert([{"group": 1, "name": "x"}])
    assert a.sort_merge_join(b, "group", "group").count() == 2
    a.register("ledger")
    assert service.query("SELECT amount FROM ledger WHERE amount = 5", spark)["rows"] == [{"amount": 5}]


def test_clustered_table_numbers_all(spark, tmp_path):
    t = RowTable(spark, str(tmp_path / "t"), cluster_by="v", bloom=("v",))
    t.append(spark.range(100, numPartitions=5).selectExpr("(id * 37) % 101 as v"))
    t.append(spark.range(10).selectExpr("id as v"))
    assert sorted(r.row_id for r in t.rows(with_id=True).collect()) == list(range(110))


def test_ledger(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    assert db.ledger_balance() == (0, 0)
    first = db.post_transaction("PAY-1", "cash", "revenue", 100, transaction_key=1)
    assert db.post_transaction("PAY-1", "cash", "revenue", 999) == first == "tx-PAY-1"
    assert db.ledger_entries().count() == 2 and db.ledger_balance() == (100, 100)
    for bad in (0, -5):
        with pytest.raises(ValueError):
            db.post_transaction("X", "a", "b", bad)
    with pytest.raises(ValueError):
        db.post_transaction("X", "a", "b", 5, credit_amount=6)
    db.post_transaction("PAY-2", "cash", "revenue", 75, transaction_key=2)
    db.post_transaction("PAY-3", "cash", "revenue", 5, transaction_key=3)
    assert db.transaction_count() == 3 and db.has_idempotency_key("PAY-2") and db.transaction_for_key("nothing") is None
    assert rows(db.validate_suspicious_transactions(6)) == [(1, 2, 3)]


def write(folder, name, *postings):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(POSTINGS_IN.names, p))) + "\n" for p in postings))


def test_stream_books_once(spark, tmp_path):
    source, ledger, checkpoint = tmp_path / "in", str(tmp_path / "ledger"), str(tmp_path / "checkpoint")
    run = lambda: ingest.ingest_postings(ingest.posting_stream(spark, str(source)), ledger, checkpoint, rejects=str(tmp_path / "rejects")).awaitTermination()
    write(source, "1.json", ("PAY-1", "cash", "revenue", 100, 0), ("PAY-1", "cash", "revenue", 1, 0), ("BAD", "cash", "revenue", -1, 0))
    run()
    write(source, "2.json", ("PAY-1", "cash", "revenue", 100, 0), ("PAY-2", "cash", "revenue", 75, 0))
    run()
    run()
    entries = ingest.read_ledger(spark, ledger)
    assert sum(r.amount for r in entries.collect() if r.entry_type == "debit") == 175
    assert entries.count() == 4
    assert spark.read.parquet(str(tmp_path / "rejects")).count() == 1


def test_stream_survives_a_failed_batch(spark, tmp_path):
    source, ledger, checkpoint = tmp_path / "in", str(tmp_path / "ledger"), str(tmp_path / "checkpoint")
    write(source, "1.json", ("PAY-1", "cash", "revenue", 100, 0))
    stream = ingest.posting_stream(spark, str(source))
    # a batch that writes and then fails before it is committed
    def torn(batch, number):
        from tally.operators import posting

        posting.post(batch.selectExpr("*", "1L as at"), "at").write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        raise RuntimeError("stopped")

    with pytest.raises(Exception):
        stream.writeStream.foreachBatch(torn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    ingest.ingest_postings(ingest.posting_stream(spark, str(source)), ledger, checkpoint).awaitTermination()
    assert ingest.read_ledger(spark, ledger).count() == 2


def test_row_stream(spark, tmp_path):
    source = tmp_path / "in"
    write(source, "1.json", ("a", "b", "c", 1, 0))
    for _ in range(2):
        ingest.ingest_rows(ingest.json_stream(spark, str(source), POSTINGS_IN), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_log_leaves_out_a_torn_end(spark, tmp_path):
    schema = "key long, value long"
    from pyspark.sql.types import StructType

    t = StructType.fromDDL(schema)
    (tmp_path / "log.jsonl").write_text('{"key": 1, "value": 2}\n{"key": 2, "val')
    assert rows(read_log(spark, str(tmp_path / "log.jsonl"), t)) == [(1, 2)]
    (tmp_path / "bad.jsonl").write_text('{"key": 1, "value": }\n{"key": 2, "value": 3}\n')
    with pytest.raises(Exception, match="malformed"):
        read_log(spark, str(tmp_path / "bad.jsonl"), t).collect()


@pytest.mark.parametrize("text, want", [
    ('{"key": 1, "value": 2}\n{"key": 2, "value": 3}', [(1, 2)]), ('{"key": 1, "value": 2}\n{"key": 2, "val": {}', [(1, 2)]), ("", []), ('{"key": 1', []),
    ('{"key": 1, "value": 2}\n{"key": 2, "val\n{"key": 3, "value": 4}\n', None), ('{"key": 1, "value": 2}\n\n', None), ("[1]\n", None),
])
def test_only_a_line_without_its_end_is_left_out(spark, tmp_path, text, want):
    from pyspark.sql.types import StructType

    t = StructType.fromDDL("key long, value long")
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text(text)
    (tmp_path / "log" / "b.jsonl").write_text('{"key": 9, "value": 9}\n')
    if want is None:
        with pytest.raises(Exception, match="malformed"):
            read_log(spark, str(tmp_path / "log"), t).collect()
    else:
        assert rows(read_log(spark, str(tmp_path / "log"), t)) == sorted([*want, (9, 9)])


def test_command_line(spark, tmp_path, capsys):
    at = ["--data", str(tmp_path / "db")]
    cli.main([*at, "insert", '{"key": 1, "amount": 5}'])
    cli.main([*at, "transaction", "T1", "cash", "bank", "7"])
    cli.main([*at, "balance"])
    cli.main([*at, "query", "SELECT amount FROM ledger WHERE key = 1"])
    cli.main([*at, "rows"])
    out = [json.loads(x) for x in capsys.readouterr().out.strip().split("\n")]
    assert out[0] == {"row_count": 1} and out[1] == {"transaction_id": "tx-T1"} and out[2] == {"debits": 7, "credits": 7}
    assert out[3]["rows"] == [{"amount": 5}] and out[4] == [{"key": 1, "amount": 5}]


def scanned(df):
    """Rows that the scan of an executed plan gave."""
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan"):
            return node.metrics().apply("numOutputRows").value()
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]


def test_clustering_and_bloom_filters_skip_row_groups(spark, tmp_path):
    data = spark.range(20_000).selectExpr("id * 7919 % 20000 AS key", "concat('name ', id * 7919 % 20000) AS name")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        RowTable(spark, str(tmp_path / "sorted"), cluster_by="key").append(data)
        RowTable(spark, str(tmp_path / "bloom"), bloom=("name",)).append(data)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    db = Database(spark, str(tmp_path / "none"))
    db.table = RowTable(spark, str(tmp_path / "sorted"))
    for found, n in ((db.filter_eq("key", 4321), 1), (db.filter_between("key", 100, 199), 100)):
        assert len(found.collect()) == n and scanned(found) <= 10_000
    db.table = RowTable(spark, str(tmp_path / "bloom"))
    one, none = db.filter_eq("name", "name 4321"), db.filter_eq("name", "name 4321x")
    assert len(one.collect()) == 1 and scanned(one) < 20_000 and none.collect() == [] and scanned(none) == 0
