"""Small tables to try things on, and tables from a file of SQL statements."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_DAY = dt.date
#: Rows of the demo tables.
ORDERS = [
    (1, 1001, "ES", Decimal("120.00"), False, _DAY(2026, 9, 1)),
    (2, 1001, "ES", Decimal("90.00"), False, _DAY(2026, 9, 1)),
    (3, 1002, "MX", Decimal("200.00"), False, _DAY(2026, 9, 2)),
    (4, 1003, "BR", Decimal("75.50"), False, _DAY(2026, 9, 2)),
    (5, 1004, "CO", Decimal("40.00"), True, _DAY(2026, 9, 3)),
]
REFUNDS = [(2, Decimal("10.00"), None), (4, Decimal("5.50"), None)]

STARTER = """source orders {
  columns: { order_id: int64 nonnull, customer_id: int64 nonnull, country: string nonnull, gross_amount_usd: money nonnull, is_test: bool, order_day: date nonnull }
}
source refunds { columns: { order_id: int64 nonnull, discount_usd: money, refunded_at: timestamp } }

contract Daily { country: string nonnull  order_day: date nonnull  net: money  orders: int64 nonnull }

model daily_orders -> contract Daily {
  owner: "you"
  from orders
  join_left refunds on orders.order_id == refunds.order_id expect many_to_one
  let off = coalesce(refunds.discount_usd, cast(0, "money"))
  filter is_test == false
  group { country, order_day } ( aggregate { net = sum(gross_amount_usd - off), orders = count() } )
  sort { order_day, country }
}

test daily_orders { expect orders > 0  expect row_count >= 1 }
"""


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "orders": spark.createDataFrame(ORDERS, "order_id long, customer_id long, country string, gross_amount_usd decimal(38,2), is_test boolean, order_day date"),
        "refunds": spark.createDataFrame(REFUNDS, "order_id long, discount_usd decimal(38,2), refunded_at timestamp_ntz"),
    }


def seed(spark: SparkSession, folder: str) -> list[str]:
    """Write the demo tables as <folder>/<name>.parquet."""
    for name, df in tables(spark).items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return list(tables(spark))


def start(folder: str) -> Path:
    """A new project: a module that reads the demo tables."""
    path = Path(folder) / "daily_orders.model"
    if path.exists():
        raise FileExistsError(f"{path} exists")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(STARTER)
    return path


def fixtures(spark: SparkSession, text: str) -> list[str]:
    """Run SQL statements, ended by ``;``, that make views or tables to read."""
    done = []
    for part in text.split(";"):
        sql = "\n".join(x for x in part.splitlines() if not x.strip().startswith("--")).strip()
        if sql:
            spark.sql(sql)
            done.append(sql.split("\n")[0])
    return done
