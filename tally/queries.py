"""The engine's queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tuning
from .database import Database
from .functions.digest import table_digest
from .operators import aggregate, combinations, filters, joins, positions, posting
from .plans import service
from .sources.tables import read_log, read_parquet, shared_dir
from .streaming.ingest import ingest_postings, ingest_rows, json_stream, read_ledger

DECIMAL_SUM = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A view of a table under a name of its own, so that queries over other folders don't meet."""
    view = f"{name}_{uuid.uuid4().hex[:8]}"
    table(spark, sf_dir, name).createOrReplaceTempView(view)
    return view


def scan_all(spark, d):
    return table(spark, d, "nation").select("*")


def column_scan(spark, d):
    return table(spark, d, "customer").select("c_mktsegment")


def row_count(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("row_count"))


def schema_listing(spark, d):
    return spark.createDataFrame(list(enumerate(table(spark, d, "orders").columns)), "position int, column_name string")


def point_fetch(spark, d):
    found = joins.fetch_rows(table(spark, d, "orders"), [7, 3, 100, 3], "o_orderkey")
    return found.select("o_orderkey", "o_custkey", "o_totalprice")


def project_alias(spark, d):
    return service.execute(f"SELECT o_orderkey AS id, o_totalprice AS price FROM {_view(spark, d, 'orders')}")


def filter_eq_int(spark, d):
    return filters.filter_eq(table(spark, d, "orders"), "o_custkey", 42)


def filter_eq_str(spark, d):
    return filters.filter_eq(table(spark, d, "orders"), "o_orderstatus", "F").select("o_orderkey", "o_orderstatus")


def filter_eq_scan(spark, d):
    return filters.filter_eq(table(spark, d, "orders"), "o_custkey", 42, use_index=False)


def filter_eq_null(spark, d):
    t = table(spark, d, "orders").withColumn("maybe", F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey")))
    return filters.filter_eq(t, "maybe", None).select("o_orderkey")


def filter_between(spark, d):
    return filters.filter_between(table(spark, d, "orders"), "o_totalprice", 1000.0, 200000.0).select("o_orderkey", "o_totalprice")


def filter_between_str(spark, d):
    return filters.filter_between(table(spark, d, "customer"), "c_mktsegment", "B", "G").select("c_custkey", "c_mktsegment")


def sql_filter_eq(spark, d):
    return service.execute(f"SELECT o_orderkey FROM {_view(spark, d, 'orders')} WHERE o_orderpriority = '1-URGENT'")


def sql_filter_between(spark, d):
    return service.execute(f"SELECT o_orderkey, o_custkey FROM {_view(spark, d, 'orders')} WHERE o_custkey BETWEEN 100 AND 200")


def sql_between_reversed(spark, d):
    return service.execute(f"SELECT o_orderkey FROM {_view(spark, d, 'orders')} WHERE o_custkey BETWEEN 200 AND 100")


def group_sum(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(aggregate.exact_sum("o_totalprice").alias("total"))


def group_count(spark, d):
    return aggregate.aggregate(table(spark, d, "orders"), "o_custkey", "COUNT", "o_orderkey", "orders")


def group_avg(spark, d):
    return aggregate.group_by(table(spark, d, "orders"), "o_custkey", "o_totalprice", scale=2).select(F.col("key").alias("o_custkey"), F.col("avg").alias("mean_price"))


def group_all(spark, d):
    return aggregate.group_by(table(spark, d, "orders"), "o_custkey", "o_totalprice", scale=2)


def group_filtered(spark, d):
    some = filters.filter_eq(table(spark, d, "orders"), "o_orderstatus", "F")
    return some.groupBy("o_custkey").agg(aggregate.exact_sum("o_totalprice").alias("total"))


def group_string_key(spark, d):
    some = filters.filter_between(table(spark, d, "orders"), "o_totalprice", 1000.0, 200000.0)
    return aggregate.aggregate(some, "o_orderpriority", "COUNT", "o_orderkey", "orders")


def group_default_name(spark, d):
    return service.execute(f"SELECT o_orderstatus, COUNT(o_orderkey) FROM {_view(spark, d, 'orders')} GROUP BY o_orderstatus")


def sql_group_sum(spark, d):
    return service.execute(f"SELECT l_returnflag, SUM(l_linenumber) AS total FROM {_view(spark, d, 'lineitem')} GROUP BY l_returnflag")


def global_aggregate(spark, d):
    return service.execute(f"SELECT COUNT(*) AS n, MAX(l_linenumber) AS most FROM {_view(spark, d, 'lineitem')}", strict=False)


def join_group(spark, d):
    both = joins.equi_join(table(spark, d, "customer"), table(spark, d, "nation"), "c_nationkey", "n_nationkey")
    return both.groupBy(F.col("`right.n_regionkey`").alias("regionkey")).agg(F.count(F.lit(1)).alias("customers"))


def join_prefixed(spark, d):
    return joins.sort_merge_join(table(spark, d, "nation"), table(spark, d, "region"), "n_regionkey", "r_regionkey").select("`left.n_name`", "`right.r_name`")


def join_large(spark, d):
    both = joins.equi_join(table(spark, d, "lineitem"), table(spark, d, "orders"), "l_orderkey", "o_orderkey")
    return both.groupBy(F.col("`right.o_orderpriority`").alias("o_orderpriority")).agg(F.count(F.lit(1)).alias("lines"), F.sum("`left.l_linenumber`").alias("numbers"))


def self_join(spark, d):
    n = _view(spark, d, "nation")
    return service.execute(f"SELECT a.n_name, b.n_name FROM {n} a JOIN {n} b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey BETWEEN 3 AND 9").toDF("a.n_name", "b.n_name")


def prefix_sum(spark, d):
    return positions.prefix_sum(table(spark, d, "events").select("event_id", "value"), "event_id", "value", scale=2).select("event_id", "prefix_sum")


def row_ids(spark, d):
    return positions.with_row_id(table(spark, d, "events").select("event_id"), "event_id")


def range_sum_avg(spark, d):
    numbered = positions.with_row_id(table(spark, d, "events").select("event_id", "value"), "event_id")
    return positions.range_total(numbered, "value", 100, 600, scale=2)


def _rated(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * 0.0625).alias("rate"))


def prefix_sum_fine(spark, d):
    """Prefix sums of values of many decimals, exact to eight."""
    return positions.prefix_sum(_rated(spark, d), "o_orderkey", "rate", scale=8).select("o_orderkey", "prefix_sum")


def prefix_sum_double(spark, d):
    """Prefix sums of doubles as they are; rounded, since the last bits depend on the order of additions."""
    found = positions.prefix_sum(table(spark, d, "events").select("event_id", (F.col("value") / 7).alias("part")), "event_id", "part")
    return found.select("event_id", F.round("prefix_sum", 3).alias("prefix_sum"))


def range_sum_double(spark, d):
    numbered = positions.with_row_id(_rated(spark, d), "o_orderkey")
    return positions.range_total(numbered, "rate", 50, 5000).select(F.round("range_sum", 3).alias("range_sum"), F.round("range_avg", 6).alias("range_avg"))


def three_sum(spark, d):
    return combinations.combinations(table(spark, d, "part"), "p_size", 60, 3)


def four_sum(spark, d):
    return combinations.combinations(table(spark, d, "part"), "p_size", 60, 4)


def _postings(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("idempotency_key"), F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("debit_account"), F.lit("revenue").alias("credit_account"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount"), F.col("o_custkey").alias("transaction_key"), "o_orderkey",
    )


def post_entries(spark, d):
    return posting.post(_postings(table(spark, d, "orders")), "o_orderkey")


def balance(spark, d):
    return aggregate.balance(post_entries(spark, d))


def transaction_count(spark, d):
    return aggregate.transaction_count(post_entries(spark, d))


def transaction_for_key(spark, d):
    return aggregate.transaction_for_key(post_entries(spark, d), "ORD-7")


def idempotent_first(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return posting.first_per_key(rows, "user_id", "event_id")


def rejected_postings(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("idempotency_key"), F.lit("a").alias("debit_account"), F.lit("b").alias("credit_account"), (F.col("event_id") % 3).alias("amount"))
    return posting.rejected(rows).select("idempotency_key", "amount")


def validate_suspicious(spark, d):
    return combinations.combinations(post_entries(spark, d), "transaction_key", 60, 3)


def index_vs_scan(spark, d):
    return filters.agreement(table(spark, d, "orders"), "o_custkey", 42)


def query_service(spark, d):
    answer = service.query(f"SELECT o_orderstatus, COUNT(o_orderkey) AS orders FROM {_view(spark, d, 'orders')} GROUP BY o_orderstatus")
    return spark.createDataFrame([(r["o_orderstatus"], r["orders"]) for r in answer["rows"]], "o_orderstatus string, orders long")


def explain_steps(spark, d):
    spark_view = _view(spark, d, "orders")
    steps = service.explain(f"SELECT o_orderkey FROM {spark_view} WHERE o_custkey BETWEEN 1 AND 5", spark)
    return spark.createDataFrame([(i, s.replace(spark_view, "orders")) for i, s in enumerate(steps)], "step int, name string")


def state_digest(spark, d):
    """Count and digest of a table, as one answer."""
    return table_digest(table(spark, d, "nation"))


def _database(spark: SparkSession) -> Database:
    return Database(spark, f"{shared_dir(spark)}/database-{uuid.uuid4().hex}")


def insert_rows(spark, d):
    """Rows put in one at a time, read back."""
    db = _database(spark)
    for r in table(spark, d, "region").select("r_regionkey", "r_name").collect():  # a region each
        db.insert(r.asDict())
    return db.rows()


def bulk_insert(spark, d):
    """Two bulk inserts, read back in a database opened anew, with the positions of rows."""
    db = _database(spark)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    db.bulk_insert(orders.where("o_custkey % 2 = 0"))
    db.bulk_insert(orders.where("o_custkey % 2 = 1"))
    again = Database(spark, db.path)
    return again.table.rows(with_id=True).select("o_orderkey", "o_custkey", "o_totalprice", (F.col("row_id") < again.filter_between("o_orderkey", 0, 1 << 60).where("o_custkey % 2 = 0").count()).alias("first"))


def read_column(spark, d):
    db = _database(spark)
    db.bulk_insert(table(spark, d, "customer").select("c_custkey", "c_name"))
    return db.read_column("c_name")


def recovery(spark, d):
    """Postings booked in two databases opened one after the other on one folder; those known already change nothing."""
    db, rows = _database(spark), _postings(table(spark, d, "orders"))
    db.post(rows.where("o_orderkey % 3 != 0"), "o_orderkey")
    again = Database(spark, db.path)
    again.post(rows.withColumn("amount", F.when(F.col("o_orderkey") % 3 == 0, F.col("amount")).otherwise(F.col("amount") + 1)), "o_orderkey")
    return Database(spark, db.path).ledger_entries()


def wal_records(spark, d):
    """A log of orders in JSON lines, of which one file ends in a record without its line end."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    spark.range(1).select(F.lit('{"o_orderkey":-1,"o_custkey":1}\n{"o_orderkey":-2,"o_custkey":2}').alias("value")).write.mode("append").option("lineSep", " ").text(path)
    return read_log(spark, path, rows.schema)


def row_stream(spark, d):
    """Rows of JSON files as a stream, appended to a table."""
    base = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows.write.json(f"{base}/in")
    ingest_rows(json_stream(spark, f"{base}/in", rows.schema), f"{base}/rows", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


def batch_plan(spark, d):
    """Batches of the published size: 1,000 rows of 128 bytes in 16 KiB."""
    return spark.createDataFrame([tuple(tuning.plan_batches(1000, 128, 16384))], "rows long, batches long, peak_bytes long, cost double")


def row_width(spark, d):
    size = tuning.measure(table(spark, d, "nation").select("n_nationkey", "n_name"))
    return spark.createDataFrame([tuple(size)], "rows long, row_bytes long")


def sql_select_all(spark, d):
    return service.execute(f"SELECT * FROM {_view(spark, d, 'nation')}")


def sql_group_avg(spark, d):
    return service.execute(f"SELECT l_returnflag, AVG(l_linenumber) AS mean FROM {_view(spark, d, 'lineitem')} GROUP BY l_returnflag")


def sql_join_all(spark, d):
    """Every column of a self-join, by the names that the engine gives."""
    n = _view(spark, d, "nation")
    return service.execute(f"SELECT * FROM {n} a JOIN {n} b ON a.n_regionkey = b.n_nationkey")


def posting_stream(spark, d):
    """Orders and a second copy of them as a stream of postings; each key is booked once."""
    base = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    rows = _postings(table(spark, d, "orders"))
    rows.unionByName(rows.withColumn("o_orderkey", F.col("o_orderkey") + 10**12).withColumn("amount", F.col("amount") + 1)).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    ingest_postings(stream, f"{base}/ledger", f"{base}/checkpoint", order="o_orderkey").awaitTermination()
    return read_ledger(spark, f"{base}/ledger")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [scan_all, column_scan, row_count, schema_listing, point_fetch, project_alias, filter_eq_int, filter_eq_str, filter_eq_scan, filter_eq_null, filter_between, filter_between_str, sql_filter_eq, sql_filter_between, sql_between_reversed]
    made += [group_sum, group_count, group_avg, group_all, group_filtered, group_string_key, group_default_name, sql_group_sum, global_aggregate, join_group, join_prefixed, join_large, self_join, prefix_sum, row_ids, range_sum_avg, three_sum, four_sum]
    made += [post_entries, balance, transaction_count, transaction_for_key, idempotent_first, rejected_postings, validate_suspicious, index_vs_scan, query_service, explain_steps, state_digest, posting_stream]
    made += [prefix_sum_fine, prefix_sum_double, range_sum_double, insert_rows, bulk_insert, read_column, recovery, wal_records, row_stream, batch_plan, row_width, sql_select_all, sql_group_avg, sql_join_all]
    return {f.__name__: f for f in made}


_LEGS = """SELECT 'tx-ORD-' || o_orderkey AS transaction_id, 'ORD-' || o_orderkey AS idempotency_key, e.entry_type,
 CASE WHEN e.entry_type = 'debit' THEN 'customer-' || o_custkey ELSE 'revenue' END AS account,
 CAST(round(o_totalprice * 100) AS BIGINT) AS amount, o_custkey AS transaction_key
 FROM orders, (VALUES ('debit'), ('credit')) e(entry_type) WHERE o_totalprice > 0"""


_RATED = "SELECT o_orderkey, o_totalprice * CAST(0.0625 AS DOUBLE) AS rate FROM orders"


def _digest(name: str, columns: list[str]) -> str:
    """Count and digest of a table: SHA-256 of each row's JSON, added up by words of 32 bits."""
    json = ", ".join(f"'{c}', {c}" for c in columns)
    words = ", ".join(f"SUM(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)) AS w{k}" for k in range(8))
    joined = " || ':' || ".join(["CAST(rows AS VARCHAR)", *(f"CAST(w{k} AS VARCHAR)" for k in range(8))])
    return f"SELECT rows, sha256({joined}) AS digest FROM (SELECT COUNT(*) AS rows, {words} FROM (SELECT sha256(CAST(json_object({json}) AS VARCHAR)) AS h FROM {name}))"


def _sums(n: int, keys: str) -> str:
    names = "abcd"[:n]
    tables = ", ".join(f"k k{x}" for x in names)
    order = " AND ".join(f"k{x}.k < k{y}.k" for x, y in zip(names, names[1:], strict=False))
    return f"WITH k AS ({keys}) SELECT {', '.join(f'k{x}.k AS {x}' for x in names)} FROM {tables} WHERE {order} AND {' + '.join(f'k{x}.k' for x in names)} = 60"


def oracle_sql() -> dict[str, str]:
    total = DECIMAL_SUM.format("o_totalprice")
    sizes = "SELECT DISTINCT CAST(p_size AS BIGINT) AS k FROM part"
    return {
        "scan_all": "SELECT * FROM nation",
        "column_scan": "SELECT c_mktsegment FROM customer",
        "row_count": "SELECT COUNT(*) AS row_count FROM lineitem",
        "schema_listing": "SELECT CAST(column_index AS INT) AS position, column_name FROM (SELECT row_number() OVER () - 1 AS column_index, column_name FROM (DESCRIBE orders))",
        "point_fetch": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders JOIN (VALUES (7), (3), (100), (3)) v(id) ON o_orderkey = id",
        "project_alias": "SELECT o_orderkey AS id, o_totalprice AS price FROM orders",
        "filter_eq_int": "SELECT * FROM orders WHERE o_custkey = 42",
        "filter_eq_str": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
        "filter_eq_scan": "SELECT * FROM orders WHERE o_custkey = 42",
        "filter_eq_null": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'",
        "filter_between": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000",
        "filter_between_str": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'G'",
        "sql_filter_eq": "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'",
        "sql_filter_between": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 100 AND 200",
        "sql_between_reversed": "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 200 AND 100",
        "group_sum": f"SELECT o_custkey, {total} AS total FROM orders GROUP BY o_custkey",
        "group_count": "SELECT o_custkey, COUNT(o_orderkey) AS orders FROM orders GROUP BY o_custkey",
        "group_avg": f"SELECT o_custkey, {total} / COUNT(o_totalprice) AS mean_price FROM orders GROUP BY o_custkey",
        "group_all": f"SELECT o_custkey AS key, {total} AS sum, COUNT(o_totalprice) AS count, {total} / COUNT(o_totalprice) AS avg FROM orders GROUP BY o_custkey",
        "group_filtered": f"SELECT o_custkey, {total} AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey",
        "group_string_key": "SELECT o_orderpriority, COUNT(o_orderkey) AS orders FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 GROUP BY o_orderpriority",
        "group_default_name": 'SELECT o_orderstatus, COUNT(o_orderkey) AS "count(o_orderkey)" FROM orders GROUP BY o_orderstatus',
        "sql_group_sum": "SELECT l_returnflag, CAST(SUM(l_linenumber) AS DOUBLE) AS total FROM lineitem GROUP BY l_returnflag",
        "global_aggregate": "SELECT COUNT(*) AS n, MAX(l_linenumber) AS most FROM lineitem",
        "join_group": "SELECT n_regionkey AS regionkey, COUNT(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey",
        "join_prefixed": 'SELECT n_name AS "left.n_name", r_name AS "right.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey',
        "join_large": "SELECT o_orderpriority, COUNT(*) AS lines, CAST(SUM(l_linenumber) AS BIGINT) AS numbers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
        "self_join": 'SELECT a.n_name AS "a.n_name", b.n_name AS "b.n_name" FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey BETWEEN 3 AND 9',
        "prefix_sum": "SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(18,2))) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS prefix_sum FROM events",
        "row_ids": "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_id FROM events",
        "range_sum_avg": f"SELECT {DECIMAL_SUM.format('value')} AS range_sum, {DECIMAL_SUM.format('value')} / COUNT(*) AS range_avg FROM (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events) WHERE r >= 100 AND r < 600",
        "three_sum": _sums(3, sizes),
        "four_sum": _sums(4, sizes),
        "post_entries": _LEGS,
        "balance": f"SELECT CAST(SUM(CASE WHEN entry_type = 'debit' THEN amount ELSE 0 END) AS BIGINT) AS debits, CAST(SUM(CASE WHEN entry_type = 'credit' THEN amount ELSE 0 END) AS BIGINT) AS credits FROM ({_LEGS})",
        "transaction_count": f"SELECT COUNT(DISTINCT transaction_id) AS transactions FROM ({_LEGS})",
        "transaction_for_key": "SELECT 'tx-ORD-7' AS transaction_id FROM orders WHERE o_orderkey = 7",
        "idempotent_first": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1",
        "rejected_postings": "SELECT CAST(event_id AS VARCHAR) AS idempotency_key, event_id % 3 AS amount FROM events WHERE event_id % 3 = 0",
        "validate_suspicious": _sums(3, "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey <= 60"),
        "index_vs_scan": "SELECT true AS agree",
        "query_service": "SELECT o_orderstatus, COUNT(o_orderkey) AS orders FROM orders GROUP BY o_orderstatus",
        "explain_steps": "SELECT * FROM (VALUES (0, 'table_scan(orders)'), (1, 'range_index_binary_search(o_custkey)'), (2, 'project')) v(step, name)",
        "state_digest": _digest("nation", ["n_name", "n_nationkey", "n_regionkey"]),
        "prefix_sum_fine": f"SELECT o_orderkey, CAST(SUM(CAST(rate AS DECIMAL(38,8))) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS prefix_sum FROM ({_RATED})",
        "prefix_sum_double": "SELECT event_id, round(SUM(value / 7) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 3) AS prefix_sum FROM events",
        "range_sum_double": f"SELECT round(SUM(rate), 3) AS range_sum, round(SUM(rate) / COUNT(*), 6) AS range_avg FROM (SELECT rate, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM ({_RATED})) WHERE r >= 50 AND r < 5000",
        "insert_rows": "SELECT r_regionkey, r_name FROM region",
        "bulk_insert": "SELECT o_orderkey, o_custkey, o_totalprice, o_custkey % 2 = 0 AS first FROM orders",
        "read_column": "SELECT c_name FROM customer",
        "recovery": _LEGS,
        "wal_records": "SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT -1, 1",
        "row_stream": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
        "batch_plan": "SELECT CAST(1000 / 96 + 1 AS BIGINT) AS batches, CAST(21 AS DOUBLE) AS cost, CAST(16384 AS BIGINT) AS peak_bytes, CAST(96 AS BIGINT) AS rows",
        "row_width": "SELECT COUNT(*) AS rows, CAST(ceil(avg(24 + strlen(n_name))) AS BIGINT) AS row_bytes FROM nation",
        "sql_select_all": "SELECT * FROM nation",
        "sql_group_avg": "SELECT l_returnflag, CAST(SUM(l_linenumber) AS DOUBLE) / COUNT(l_linenumber) AS mean FROM lineitem GROUP BY l_returnflag",
        "sql_join_all": "SELECT " + ", ".join(f'{a}.{c} AS "{side}.{c}"' for a, side in (("a", "left"), ("b", "right")) for c in ("n_nationkey", "n_name", "n_regionkey")) + " FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey",
        "posting_stream": _LEGS,
    }
