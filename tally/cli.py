"""Command line: insert, rows, transaction, balance and query over a data folder."""

from __future__ import annotations

import argparse
import json
import sys

from .database import Database
from .plans import service
from .session import session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tally")
    parser.add_argument("--data", required=True, help="data folder")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("insert").add_argument("row", help="a JSON object")
    commands.add_parser("rows").add_argument("--limit", type=int, default=100)
    commands.add_parser("balance")
    commands.add_parser("query").add_argument("sql")
    post = commands.add_parser("transaction")
    for name in ("idempotency_key", "debit_account", "credit_account"):
        post.add_argument(name)
    post.add_argument("amount", type=int)
    post.add_argument("--transaction-key", type=int, default=0)
    args = parser.parse_args(argv)
    db = Database(session(), args.data)
    if args.command == "insert":
        db.insert(json.loads(args.row))
        out = {"row_count": db.row_count}
    elif args.command == "rows":
        out = [r.asDict() for r in db.table.rows(with_id=True).orderBy("row_id").limit(args.limit).drop("row_id").collect()]
    elif args.command == "balance":
        out = dict(zip(("debits", "credits"), db.ledger_balance(), strict=True))
    elif args.command == "query":
        db.register()
        out = service.query(args.sql)
    else:
        out = {"transaction_id": db.post_transaction(args.idempotency_key, args.debit_account, args.credit_account, args.amount, transaction_key=args.transaction_key)}
    json.dump(out, sys.stdout, default=str)
    print()
    return 0


if __name__ == "__main__":
    sys.exit(main())
