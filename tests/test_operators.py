import pytest
from pyspark.sql import functions as F

from tally.functions.digest import table_digest
from tally import queries
from tally.operators import aggregate, combinations, filters, joins, positions, posting
from tally.schema import POSTINGS_IN, conform
from tally import tuning
from tally.tuning import plan_batches


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([(1, 10, 1), (2, 20, 1), (2, 30, 2), (3, 40, 2)], "key long, amount long, category long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_filters(sales):
    assert rows(filters.filter_between(sales, "amount", 15, 35)) == [(2, 20, 1), (2, 30, 2)]
    assert rows(filters.filter_eq(sales, "key", 2)) == rows(filters.filter_eq(sales, "key", 2, use_index=False))
    assert filters.validate_filter_index(sales, "key", 2)
    with pytest.raises(ValueError):
        filters.filter_between(sales, "amount", 35, 15)
    with pytest.raises(KeyError):
        filters.filter_eq(sales, "nothing", 1)


def test_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (2, None)], "key long, amount long")
    assert rows(filters.filter_eq(df, "amount", None)) == [(1, None), (2, None)]
    assert {tuple(r) for r in aggregate.group_by(df, "key", "amount").collect()} == {(1, None, 0, None), (2, 5.0, 1, 5.0)}
    assert filters.validate_filter_index(df, "amount", None)


def test_filter_reaches_the_scan(spark, sf_dir):
    df = filters.filter_eq(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", 42).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,42)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    other = filters.filter_eq(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", 42, use_index=False)
    assert "EqualTo" not in other._jdf.queryExecution().executedPlan().toString()


def test_grouping_is_partial_and_final(sales):
    plan = aggregate.group_by(sales, "category", "amount")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2
    assert rows(aggregate.aggregate(sales, "category", "SUM", "amount", "total")) == [(1, 30.0), (2, 70.0)]
    assert aggregate.aggregate(sales, "category", "COUNT", "amount").columns == ["category", "count(amount)"]
    with pytest.raises(ValueError):
        aggregate.aggregate(sales, "category", "MAX", "amount")


def test_join_pairs(spark):
    left = spark.createDataFrame([(2, "b"), (1, "a1"), (1, "a2"), (None, "n")], "key long, left_value string")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (1, "z"), (None, "m")], "key long, right_value string")
    both = joins.sort_merge_join(left, right, "key", "key")
    assert both.columns == ["left.key", "left.left_value", "right.key", "right.right_value"]
    assert sorted((r[1], r[3]) for r in both.collect()) == [("a1", "x"), ("a1", "z"), ("a2", "x"), ("a2", "z"), ("b", "y")]
    assert "SortMergeJoin" in both._jdf.queryExecution().sparkPlan().toString()
    with pytest.raises(KeyError):
        joins.equi_join(left, right, "nothing", "key")


def test_fetch_keeps_the_order(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    assert [r[0] for r in joins.fetch_rows(df, [3, 1, 3]).collect()] == [3, 1, 3]
    assert joins.fetch_rows(df, []).count() == 0
    with pytest.raises(IndexError):
        joins.fetch_rows(df, [11])


@pytest.mark.parametrize("ranges", [1, 2, 7])
def test_prefix_sums(spark, ranges):
    values = [((k * 37) % 101, None if k % 9 == 0 else k / 4) for k in range(100)]
    df = spark.createDataFrame(values, "at long, v double")
    total, want = 0.0, {}
    for n, (at, v) in enumerate(sorted(values)):
        total += v or 0.0
        want[at] = (n, total)
    sums = {r["at"]: r["prefix_sum"] for r in positions.prefix_sum(df, "at", "v", ranges=ranges).collect()}
    ids = {r["at"]: r["row_id"] for r in positions.with_row_id(df, "at", ranges=ranges).collect()}
    assert {k: (ids[k], sums[k]) for k in sums} == want


def test_prefix_sum_of_nothing(spark):
    assert positions.prefix_sum(spark.createDataFrame([], "at long, v double"), "at", "v").count() == 0


def test_sums_keep_their_decimals(spark):
    df = spark.createDataFrame([(k, 0.125) for k in range(8)] + [(8, 1e17)], "row_id long, v double")
    got = [r[0] for r in positions.prefix_sum(df, "row_id", "v").orderBy("row_id").select("prefix_sum").collect()]
    assert got == [0.125 * k for k in range(1, 9)] + [1e17 + 1.0]
    assert positions.PrefixSums(df, "v").range_sum(0, 8) == 1.0 and positions.PrefixSums(df, "v").range_avg(0, 4) == 0.125
    exact = df.where("row_id < 3").select("row_id", F.lit("0.1").cast("decimal(5,1)").alias("v"))
    assert [r[0] for r in positions.prefix_sum(exact, "row_id", "v").orderBy("row_id").select("prefix_sum").collect()] == [0.1, 0.2, 0.3]


def test_ties_and_nulls_have_a_place(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), *((5, float(k)) for k in range(60)), (7, 4.0)], "at long, v double")
    got = positions.with_row_id(df, "at", ranges=5).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(63)) and [r["at"] for r in got] == [None] * 2 + [5] * 60 + [7]
    again = positions.with_row_id(df.repartition(3), "at", ranges=2).orderBy("row_id").collect()
    assert got == again
    sums = positions.prefix_sum(df, "at", "v", ranges=3).orderBy("prefix_sum").collect()
    assert sums[1].prefix_sum == 3.0 and sums[-1].prefix_sum == 3.0 + sum(range(60)) + 4.0


def test_range_errors(spark):
    df = spark.createDataFrame([(0, 10), (1, 5), (2, 20), (3, 7)], "row_id long, amount long")
    sums = positions.PrefixSums(df, "amount")
    assert sums.range_avg(0, 4) == 10.5 and sums.range_sum(1, 3) == 25.0 and sums.range_sum(2, 2) == 0.0
    for bad, error in (((0.5, 2), TypeError), ((-1, 2), IndexError), ((0, 5), IndexError), ((3, 1), ValueError)):
        with pytest.raises(error):
            sums.range_sum(*bad)
    with pytest.raises(ValueError):
        sums.range_avg(2, 2)
    with pytest.raises(TypeError):
        positions.PrefixSums(df.withColumn("t", F.lit("x")), "t")


def test_combinations(spark):
    df = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 3, None)], "k long")
    assert rows(combinations.combinations(df, "k", 6, 3)) == [(1, 2, 3)]
    assert rows(combinations.combinations(df, "k", 10, 4)) == [(1, 2, 3, 4)]
    with pytest.raises(ValueError):
        combinations.combinations(df, "k", 6, 2)


def test_posting_keeps_the_first(spark):
    df = spark.createDataFrame([("A", "cash", "revenue", 100, 1, 2), ("A", "cash", "revenue", 70, 1, 1), ("B", "cash", "bank", 0, 2, 3), (None, "x", "y", 5, 0, 4)], "idempotency_key string, debit_account string, credit_account string, amount long, transaction_key long, at long")
    got = rows(posting.post(df, "at").select("transaction_id", "entry_type", "account", "amount"))
    assert got == [("tx-A", "credit", "revenue", 70), ("tx-A", "debit", "cash", 70)]
    assert posting.rejected(df).count() == 2
    assert posting.post(df, "at", posting.post(df, "at")).count() == 0
    assert tuple(aggregate.balance(posting.post(df.limit(0), "at")).first()) == (0, 0)
    assert len(POSTINGS_IN) == 5


def test_columns_must_agree(spark, sales):
    assert conform(sales.select("category", "amount", "key"), ["key", "amount", "category"]).columns == ["key", "amount", "category"]
    with pytest.raises(ValueError):
        conform(sales.drop("key"), sales.columns)
    with pytest.raises(ValueError):
        conform(sales.withColumn("more", F.lit(1)), sales.columns)


def test_batches(spark):
    assert plan_batches(1000, 100, 5500, batch_bytes=1000)[:3] == (45, 23, 5500)
    assert tuple(plan_batches(1000, 128, 16384)) == (96, 11, 16384, 21.0)
    for bad in ((1, 100, 99), (0, 1, 9999), (5, 1, 9999, 0)):
        with pytest.raises(ValueError):
            plan_batches(*bad[:3], most=bad[3] if len(bad) > 3 else None)
    df = spark.createDataFrame([(k, "x" * k) for k in range(5)], "k long, s string")
    assert tuple(tuning.measure(df)) == (5, 26)
    assert tuning.writer_options(df, 4096 + 53) == {"maxRecordsPerFile": "2"} and tuning.writer_options(df.limit(0)) == {}
    assert tuning.task_memory(spark) > 1 << 20


def test_digest_ignores_order(spark, sales):
    a, b = table_digest(sales).first(), table_digest(sales.orderBy(F.desc("amount")).repartition(3)).first()
    assert a == b and a["rows"] == 4
    assert table_digest(sales.limit(3)).first() != a


def test_suspicious_keys_over_the_target(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").limit(4).collect()
    made = [{**r.asDict(), "o_custkey": k} for r, k in zip(orders, (-50, 10, 100, 19), strict=True)]
    schema = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    spark.createDataFrame([tuple(m[c] for c in schema.names) for m in made], schema).write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(queries.validate_suspicious(spark, str(tmp_path))) == [(-50, 10, 100)]
