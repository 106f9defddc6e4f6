"""A folder with one row table and one ledger, behind the engine's operators."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregate, combinations, filters, joins, positions, posting
from .schema import LEDGER_ENTRIES, POSTINGS_IN, require
from .sources.tables import RowTable, exists


class Database:
    """Rows under ``path/rows`` and ledger entries under ``path/ledger_entries``.

    One writer at a time: an append or a posting reads what is there before it adds to
    it, so two at once may give one row id or one posting key twice. Readers need no care.
    """

    def __init__(self, spark: SparkSession, path: str, **table_options: Any):
        self.spark, self.path = spark, path
        self.table = RowTable(spark, f"{path}/rows", **table_options)

    # rows
    def insert(self, values: Mapping[str, Any]) -> None:
        self.bulk_insert([values])

    def bulk_insert(self, rows: DataFrame | list[Mapping[str, Any]]) -> None:
        """All rows become visible together; ValueError for empty rows or other columns. An empty list changes nothing."""
        if not isinstance(rows, DataFrame):
            if not rows:
                return
            if any(not r or set(r) != set(rows[0]) for r in rows):
                raise ValueError("rows need the same columns, at least one")
            names = list(rows[0])
            stored = self.table.columns
            if stored and set(stored) != set(names):
                raise ValueError(f"columns {sorted(names)} differ from the table's {sorted(stored)}")
            schema = self.table.rows().select(*stored).schema if stored else names
            order = stored or names
            rows = self.spark.createDataFrame([tuple(r[c] for c in order) for r in rows], schema)
        self.table.append(rows)

    def rows(self) -> DataFrame:
        return self.table.rows()

    @property
    def row_count(self) -> int:
        return self.table.row_count

    @property
    def columns(self) -> list[str]:
        return self.table.columns

    def read_column(self, column: str) -> DataFrame:
        rows = self.table.rows()
        require(rows, column)
        return rows.select(f"`{column}`")

    def read_rows_by_ids(self, ids: list[int]) -> DataFrame:
        return joins.fetch_rows(self.table.rows(with_id=True), ids).drop("row_id")

    def filter_eq(self, column: str, value: Any, use_index: bool = True) -> DataFrame:
        return filters.filter_eq(self.rows(), column, value, use_index)

    def filter_between(self, column: str, lower: Any, upper: Any) -> DataFrame:
        return filters.filter_between(self.rows(), column, lower, upper)

    def validate_filter_index(self, column: str, value: Any) -> bool:
        return filters.validate_filter_index(self.rows(), column, value)

    def group_by(self, key: str, value: str) -> DataFrame:
        return aggregate.group_by(self.rows(), key, value).orderBy("key")

    def sort_merge_join(self, other: Database, left_column: str, right_column: str) -> DataFrame:
        return joins.sort_merge_join(self.rows(), other.rows(), left_column, right_column)

    def prefix_sum(self, column: str) -> positions.PrefixSums:
        return positions.PrefixSums(self.table.rows(with_id=True), column)

    def register(self, name: str = "ledger") -> None:
        """The rows as a view for SQL."""
        self.rows().createOrReplaceTempView(name)

    # ledger
    def ledger_entries(self) -> DataFrame:
        at = f"{self.path}/ledger_entries"
        return self.spark.read.schema(LEDGER_ENTRIES).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], LEDGER_ENTRIES)

    def post_transaction(self, idempotency_key: str, debit_account: str, credit_account: str, amount: int, *, credit_amount: int | None = None, transaction_key: int = 0) -> str:
        """Book one posting; a known key changes nothing. Gives the transaction id."""
        posting.require_valid(idempotency_key, amount, amount if credit_amount is None else credit_amount)
        row = (idempotency_key, debit_account, credit_account, amount, transaction_key)
        self.post(self.spark.createDataFrame([row], POSTINGS_IN))
        return f"tx-{idempotency_key}"

    def post(self, postings: DataFrame, order: str | None = None) -> None:
        """Book many postings, the first of each key; both sides of one become visible together."""
        if order is None:
            order, postings = "__order", postings.withColumn("__order", F.monotonically_increasing_id())
        posting.post(postings, order, self.ledger_entries()).write.mode("append").parquet(f"{self.path}/ledger_entries")

    def ledger_balance(self) -> tuple[int, int]:
        return tuple(aggregate.balance(self.ledger_entries()).first())

    def transaction_count(self) -> int:
        return aggregate.transaction_count(self.ledger_entries()).first()[0]

    def has_idempotency_key(self, key: str) -> bool:
        return self.transaction_for_key(key) is not None

    def transaction_for_key(self, key: str) -> str | None:
        row = aggregate.transaction_for_key(self.ledger_entries(), key).first()
        return row[0] if row else None

    def validate_suspicious_transactions(self, target: int, *, arity: int = 3) -> DataFrame:
        return combinations.combinations(self.ledger_entries(), "transaction_key", target, arity)

    def close(self) -> None:
        """Nothing is held open."""
