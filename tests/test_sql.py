import pytest

from tally.plans import service
from tally.plans.sqlgate import SQLSyntaxError, parse_sql


@pytest.fixture(scope="module")
def sales(spark):
    spark.createDataFrame([(1, 10, 1), (2, 20, 1), (2, 30, 2), (3, 40, 2)], "key long, amount long, category long").createOrReplaceTempView("sales")
    return "sales"


def rows(spark, sql):
    return sorted(tuple(r) for r in service.execute(sql, spark).collect())


def test_between_uses_the_range_path(spark, sales):
    sql = "SELECT key, amount FROM sales WHERE amount BETWEEN 15 AND 35"
    assert rows(spark, sql) == [(2, 20), (2, 30)]
    assert service.explain(sql, spark) == ["table_scan(sales)", "range_index_binary_search(amount)", "project"]


def test_equality_and_all(spark, sales):
    assert rows(spark, "SELECT key FROM sales WHERE key = 2") == [(2,), (2,)]
    assert len(rows(spark, "select key, amount from sales")) == 4
    assert service.execute("SELECT * FROM sales", spark).columns == ["key", "amount", "category"]
    assert rows(spark, "SELECT key FROM sales WHERE amount BETWEEN 35 AND 15") == []


def test_grouping(spark, sales):
    assert rows(spark, "SELECT category, SUM(amount) AS total FROM sales GROUP BY category") == [(1, 30.0), (2, 70.0)]
    assert rows(spark, "SELECT category, AVG(amount) FROM sales WHERE amount BETWEEN 15 AND 99 GROUP BY category") == [(1, 20.0), (2, 35.0)]
    assert service.execute("SELECT category, COUNT(amount) FROM sales GROUP BY category", spark).columns == ["category", "count(amount)"]


def test_self_join(spark, sales):
    sql = "SELECT a.key, a.amount, b.category FROM sales a JOIN sales b ON a.key = b.key WHERE a.amount BETWEEN 20 AND 20"
    assert service.execute(sql, spark).columns == ["a.key", "a.amount", "b.category"]
    assert rows(spark, sql) == [(2, 20, 1), (2, 20, 2)]
    assert service.explain(sql, spark) == ["table_scan(sales)", "sort_merge_join(sales, sales)", "project"]
    assert service.execute("SELECT * FROM sales a JOIN sales b ON a.key = b.key", spark).columns[:2] == ["left.key", "left.amount"]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT DISTINCT key FROM sales", "SELECT key + 1 FROM sales", "SELECT COUNT(*) FROM sales", "SELECT key FROM sales WHERE key = 1 AND amount = 2", "SELECT key FROM sales WHERE key > 1", "SELECT key FROM sales WHERE key IN (1, 2)",
        "SELECT key FROM sales WHERE key IS NULL", "SELECT key FROM sales WHERE key = NULL", "SELECT key FROM sales WHERE", "SELECT key FROM sales LEFT JOIN sales b ON key = b.key", "SELECT key FROM sales ORDER BY key", "SELECT key FROM sales LIMIT 1",
        "SELECT category, SUM(amount), COUNT(amount) FROM sales GROUP BY category", "SELECT key, SUM(amount) FROM sales GROUP BY category", "SELECT category, MAX(amount) FROM sales GROUP BY category", "SELECT category, SUM(amount) FROM sales GROUP BY category, key",
        "SELECT c.key FROM sales a JOIN sales b ON a.key = b.key", "SELECT a.key FROM sales a JOIN sales b ON a.key > b.key", "SELECT key FROM (SELECT key FROM sales) x", "DELETE FROM sales", "SELECT key, * FROM sales", "not sql", "SELECT key FROM sales WHERE key = amount",
    ],
)
def test_rejected(spark, sales, sql):
    with pytest.raises(SQLSyntaxError):
        parse_sql(sql, spark)


def test_literals(spark, sales):
    assert parse_sql("SELECT key FROM sales WHERE key = -5", spark).where.values == (-5,)
    assert parse_sql("SELECT key FROM sales WHERE key BETWEEN 1.5 AND 2", spark).where.values == (1.5, 2)
    assert parse_sql("SELECT key FROM sales WHERE key = 'it''s'", spark).where.values[0] in ("it's", "its")


def test_service(spark, sales):
    answer = service.query("SELECT key FROM sales WHERE key = 1", spark)
    assert answer == {"success": True, "plan": ["table_scan(sales)", "equality_index(key)", "project"], "rows": [{"key": 1}]}
    assert service.query("SELECT nothing FROM sales", spark)["success"] is False
    assert service.query("SELECT key FROM sales LIMIT 1", spark)["success"] is False
    assert service.query("SELECT COUNT(*) AS n FROM sales", spark, strict=False)["rows"] == [{"n": 4}]
