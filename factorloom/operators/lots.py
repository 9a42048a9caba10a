"""First-in first-out lots: which purchase each sold piece came from, as a table function over partitions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MATCHES = "asset long, buy_id long, sell_id long, quantity double, buy_price double, sell_price double"


class FifoLots:
    """Of one asset's trades (asset, id, quantity, price) in order: a row for each piece of a lot that a sale takes.

    Purchases have positive quantities, sales negative ones. A sale takes the oldest open lots; what is sold beyond what is
    held is passed over. Rows without quantity or price, and of quantity 0, are passed over.
    """

    def __init__(self) -> None:
        self.lots: deque[list] = deque()

    def eval(self, row: Row) -> Iterator[tuple]:
        yield from self.trade(row["asset"], row["id"], row["quantity"], row["price"])

    def trade(self, asset: int | None, trade_id: int | None, quantity: float | None, price: float | None) -> list[tuple]:
        out = []
        if not quantity or price is None:
            return out
        if quantity > 0:
            self.lots.append([trade_id, float(quantity), float(price)])
            return out
        left = -float(quantity)
        while left > 0 and self.lots:
            lot = self.lots[0]
            taken = min(left, lot[1])
            out.append((asset, lot[0], trade_id, taken, lot[2], float(price)))
            left -= taken
            lot[1] -= taken
            if lot[1] <= 0:
                self.lots.popleft()
        return out


_SCHEMA = pa.schema([("asset", pa.int64()), ("buy_id", pa.int64()), ("sell_id", pa.int64()), ("quantity", pa.float64()), ("buy_price", pa.float64()), ("sell_price", pa.float64())])


def match_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of batches of trades, in which each asset's trades stand together and in order; open lots of one asset are held."""
    asset, lots = None, FifoLots()
    for batch in batches:
        out: list[tuple] = []
        for a, i, quantity, price in zip(*(batch.column(c).to_pylist() for c in ("asset", "id", "quantity", "price")), strict=True):
            if a != asset:
                asset, lots = a, FifoLots()
            out += lots.trade(a, i, quantity, price)
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def register_lots(spark: SparkSession, name: str = "fifo_lots") -> None:
    """Makes the table function known to SQL: SELECT * FROM fifo_lots(TABLE(t) PARTITION BY asset ORDER BY (at, id))."""
    spark.udtf.register(name, F.udtf(FifoLots, returnType=StructType.fromDDL(MATCHES)))


def fifo_matches(trades: DataFrame) -> DataFrame:
    """Matches of trades (asset, at, id, quantity, price), each asset's in order of (at, id), assets side by side.

    The table function's matching, over Arrow batches of sorted partitions: a row costs no call of its own.
    """
    rows = trades.select(F.col("asset").cast("long").alias("asset"), "at", F.col("id").cast("long").alias("id"), F.col("quantity").cast("double").alias("quantity"), F.col("price").cast("double").alias("price"))
    return rows.repartition("asset").sortWithinPartitions("asset", "at", "id").mapInArrow(match_sorted, MATCHES)


def realized(matches: DataFrame) -> DataFrame:
    """(asset, n, quantity, pnl) of matched pieces."""
    return matches.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.sum((F.col("sell_price") - F.col("buy_price")) * F.col("quantity")).alias("pnl"))
