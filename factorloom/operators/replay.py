"""Order-by-order replay of portfolios, many runs at once: one stream of sessions per run, runs spread over tasks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Costs and market rules of a replay."""

    cash: float = 1_000_000.0
    commission: float = 0.0003
    least_commission: float = 5.0
    slippage: float = 0.002
    stamp: float = 0.0005
    tick: float = 0.001
    lot: int = 100
    price_limit: float = 0.1
    limit_slack: float = 1e-3
    t_plus_1: bool = True
    limits: bool = True


@dataclass
class Position:
    amount: int = 0
    cost: float = 0.0  # average price paid
    price: float = 0.0
    locked: int = 0


@dataclass
class Order:
    asset: str
    amount: int


@dataclass
class Account:
    """What a strategy sees on a session's open: cash, positions, today's opens; and its orders."""

    rules: Rules
    cash: float
    day: object = None
    positions: dict[str, Position] = field(default_factory=dict)
    opens: dict[str, float] = field(default_factory=dict)
    pending: list[Order] = field(default_factory=list)

    def value(self) -> float:
        return self.cash + sum(p.amount * p.price for p in self.positions.values())

    def order(self, asset: str, amount: int) -> None:
        """Buys in whole lots, sales as they are; nothing without a bar today."""
        if amount > 0:
            amount = amount // self.rules.lot * self.rules.lot
        if amount and asset in self.opens:
            self.pending.append(Order(asset, int(amount)))

    def order_value(self, asset: str, value: float) -> None:
        if self.opens.get(asset, 0) > 0:
            self.order(asset, int(value / self.opens[asset]))

    def order_target_value(self, asset: str, target: float) -> None:
        """Toward a value, truncated to shares and then to lots; a target of 0 sells all, odd lots too."""
        price = self.opens.get(asset, 0)
        if price <= 0:
            return
        held = self.positions.get(asset, Position()).amount
        if target == 0 and held > 0:
            self.order(asset, -held)
            return
        shares = int((target - held * price) / price)
        self.order(asset, int(shares / self.rules.lot) * self.rules.lot)

    def order_target_percent(self, asset: str, share: float) -> None:
        self.order_target_value(asset, self.value() * share)


Strategy = Callable[[Account, dict[str, float]], None]


def follow_targets(account: Account, targets: dict[str, float]) -> None:
    """The default strategy: leaves what has no target today, sells before it buys; without any targets it does nothing."""
    if not targets:
        return
    worth = account.value()
    for asset in sorted(a for a, p in account.positions.items() if p.amount and a not in targets):
        account.order_target_value(asset, 0)
    now = lambda a: account.positions.get(a, Position()).amount * account.opens.get(a, 0)
    for asset in sorted(targets, key=lambda a: (targets[a] * worth - now(a), a)):
        account.order_target_value(asset, targets[asset] * worth)


def execution_price(price: float, amount: int, r: Rules) -> float:
    raw = price * (1 + math.copysign(r.slippage / 2, amount))
    return round(round(raw / r.tick) * r.tick, 10) if r.tick > 0 else raw


def commission(value: float, r: Rules) -> float:
    return max(abs(value) * r.commission, r.least_commission) if value else 0.0


def affordable(amount: int, price: float, cash: float, r: Rules) -> int:
    """The most shares up to `amount` that cash pays for with costs, in lots."""
    fill = execution_price(price, 1, r)
    if fill <= 0:
        return 0
    n = min(amount, int(cash / price))
    by_rate, by_least = cash / (fill * (1 + r.commission)), (cash - r.least_commission) / fill
    n = max(0, min(n, int(min(by_rate, by_least) + 1e-9)))
    while n > 0 and n * fill + commission(n * fill, r) > cash:
        n -= 1
    return n // r.lot * r.lot


def at_limit(amount: int, bar: dict, r: Rules) -> bool:
    before = bar["pre_close"]
    if not r.limits or bar["kind"] != "stock" or not before or before <= 0:
        return False
    if amount > 0:
        return bar["open"] >= before * (1 + r.price_limit) - r.limit_slack
    return bar["open"] <= before * (1 - r.price_limit) + r.limit_slack


def fill(account: Account, order: Order, bar: dict) -> dict | None:
    """Executes an order at the open, or returns None; the trade as a row."""
    r = account.rules
    pos = account.positions.setdefault(order.asset, Position())
    stock = bar["kind"] == "stock"
    if order.amount > 0:
        n = affordable(order.amount, bar["open"], account.cash, r)
        if n <= 0:
            return None
        price = execution_price(bar["open"], n, r)
        fee, tax = commission(n * price, r), 0.0
        pos.cost = (pos.amount * pos.cost + n * price) / (pos.amount + n)
        pos.amount += n
        pos.locked += n if stock and r.t_plus_1 else 0
        account.cash -= n * price + fee
    else:
        free = pos.amount - (pos.locked if stock and r.t_plus_1 else 0)
        n = -min(free, -order.amount)
        if n >= 0:
            return None
        price = execution_price(bar["open"], n, r)
        worth = -n * price
        fee, tax = commission(worth, r), worth * r.stamp if stock else 0.0
        pos.amount += n
        pos.cost = pos.cost if pos.amount else 0.0
        account.cash += worth - fee - tax
    return {"asset": order.asset, "amount": n, "price": price, "commission": fee, "slippage": abs((price - bar["open"]) * n), "tax": tax}


def session(account: Account, bars: dict[str, dict], targets: dict[str, float], due: dict[tuple, float], strategy: Strategy) -> list[dict]:
    """One session: unlock, splits, open prices, dividend cash, the strategy, fills, entitlements, the close."""
    rows: list[dict] = []
    account.opens = {a: b["open"] for a, b in bars.items() if b["open"] is not None}
    for asset, pos in account.positions.items():
        pos.locked = 0
        bar = bars.get(asset)
        if bar is None:
            continue
        ratio = bar["split_ratio"]
        if pos.amount and ratio and abs(ratio - 1) > 1e-6:
            pos.amount, pos.cost = round(pos.amount * ratio), pos.cost / ratio
        pos.price = bar["open"]
    for key in [k for k in due if k[1] == account.day]:
        paid = due.pop(key)
        account.cash += paid
        rows.append({"event": "dividend", "asset": key[0], "value": paid})
    strategy(account, targets)
    waiting, account.pending = account.pending, []
    for order in waiting:
        bar = bars.get(order.asset)
        if bar is None or bar["open"] is None:
            account.pending.append(order)
            continue
        done = None if at_limit(order.amount, bar, account.rules) else fill(account, order, bar)
        rows.append({"event": "trade" if done else "rejected", **(done or {"asset": order.asset, "amount": order.amount})})
        if done:
            account.positions[order.asset].price = bar["open"]
    for asset, pos in account.positions.items():
        bar = bars.get(asset)
        for pay, cash in (bar or {}).get("dividends") or []:
            if pos.amount > 0 and pay is not None:
                due[asset, pay] = due.get((asset, pay), 0.0) + pos.amount * cash
        if bar is not None and bar["close"] is not None:
            pos.price = bar["close"]
    rows.append({"event": "equity", "value": account.value()})
    return rows


OUTPUT = "run_id string, date date, event string, asset string, amount long, price double, commission double, slippage double, tax double, value double, cash double"
_COLUMNS = [x.split()[0] for x in OUTPUT.split(", ")]
_BAR = ["open", "close", "pre_close", "split_ratio", "kind", "dividends"]


def replay(bars: DataFrame, targets: DataFrame, dividends: DataFrame | None = None, rules: Rules = Rules(), strategy: Strategy = follow_targets) -> DataFrame:
    """Replays runs session by session; returns trades, rejections, dividends and a closing equity row per session.

    bars: date, asset, open, close, and optionally pre_close, split_ratio, kind (default stock); targets: run_id, date,
    asset, weight - what the strategy is given on a date; dividends: asset, record_date, pay_date, div_cash (cash by the
    shares held at the record date's end, paid on the pay date if it is a session).

    Each run needs the bars of the assets that it ever targets, on all sessions: a join on asset. Rows go to their run's
    task sorted by date and are consumed as a stream, so a task holds one session and the positions. Runs are parallel,
    a run is sequential by nature.
    """
    have = bars.columns
    rows = bars.select("date", F.col("asset").cast("string").alias("asset"), "open", "close", F.col("pre_close").alias("pre_close") if "pre_close" in have else F.lit(None).cast("double").alias("pre_close"), F.col("split_ratio") if "split_ratio" in have else F.lit(1.0).alias("split_ratio"), F.col("kind") if "kind" in have else F.lit("stock").alias("kind"))
    if dividends is not None:
        paid = dividends.groupBy(F.col("asset").cast("string").alias("asset"), F.col("record_date").alias("date")).agg(F.collect_list(F.struct("pay_date", "div_cash")).alias("dividends"))
        rows = rows.join(paid, ["asset", "date"], "left")
    else:
        rows = rows.withColumn("dividends", F.lit(None).cast("array<struct<pay_date:date,div_cash:double>>"))
    goals = targets.select(F.col("run_id").cast("string").alias("run_id"), "date", F.col("asset").cast("string").alias("asset"), F.col("weight").cast("double").alias("weight"))
    feed = goals.select("run_id", "asset").distinct().join(rows, "asset").join(goals, ["run_id", "asset", "date"], "left")
    feed = feed.repartition("run_id").sortWithinPartitions("run_id", "date", "asset").select("run_id", "date", "asset", *_BAR, "weight")

    def items(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in frames:
            yield from pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[dict] = []
        for run_id, of_run in itertools.groupby(items(frames), key=lambda x: x[0]):
            account, due = Account(rules, rules.cash), {}
            for day, of_day in itertools.groupby(of_run, key=lambda x: x[1]):
                today = list(of_day)
                account.day = day
                book = {x[2]: dict(zip(_BAR, x[3:9], strict=True)) for x in today}
                for b in book.values():
                    b["dividends"] = [(d["pay_date"], d["div_cash"]) if isinstance(d, dict) else (d[0], d[1]) for d in (b["dividends"] if b["dividends"] is not None else [])]
                wanted = {x[2]: x[9] for x in today if x[9] is not None}
                out += [{"run_id": run_id, "date": day, "cash": account.cash, **x} for x in session(account, book, wanted, due, strategy)]
                if len(out) > 10_000:
                    yield frame(out)
                    out = []
        if out:
            yield frame(out)

    def frame(rows: list[dict]) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=_COLUMNS)
        pdf["amount"] = pdf["amount"].astype("Int64")
        return pdf

    return feed.mapInPandas(run, OUTPUT)


LEDGER = "asset string, date date, amount long, price double, held_before long, cost_out double, pnl double, pnl_pct double"


def trade_ledger(trades: DataFrame, dividends: DataFrame | None = None, splits: DataFrame | None = None, fees: bool = True) -> DataFrame:
    """Each sale with its realised profit by average cost; buys have none.

    trades: asset, date, amount (signed), price, seq (order within a date), and optionally commission, slippage, tax;
    dividends: asset, date, div_cash (lowers the cost of what is held); splits: asset, date, ratio (multiplies shares).
    Splits up to a trade's date come before it, then dividends, which wait while nothing is held. Sales beyond the holding
    count up to it. With fees, buys carry theirs into the cost and sales are net of theirs.

    The three are one stream per asset, sorted by Spark; state is one position, whatever the length of the stream.
    """
    zero = F.lit(0.0)
    cost = sum((F.coalesce(F.col(c), zero) for c in ("commission", "slippage", "tax") if c in trades.columns), zero) if fees else zero
    key = F.col("asset").cast("string").alias("asset")
    rows = trades.select(key, "date", F.lit(2).alias("what"), F.col("seq").cast("long").alias("seq"), F.col("amount").cast("double").alias("a"), F.col("price").alias("b"), cost.alias("c"))
    for df, what, value in ((splits, 0, "ratio"), (dividends, 1, "div_cash")):
        if df is not None:
            rows = rows.unionByName(df.select(key, "date", F.lit(what).alias("what"), F.lit(0).cast("long").alias("seq"), F.col(value).cast("double").alias("a"), zero.alias("b"), zero.alias("c")))
    rows = rows.repartition("asset").sortWithinPartitions("asset", "date", "what", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asset, amount, paid, waiting = None, 0, 0.0, []
        for pdf in frames:
            out = []
            for name, day, what, _, a, b, c in pdf.itertuples(index=False, name=None):
                if name != asset:
                    asset, amount, paid, waiting = name, 0, 0.0, []
                if what == 0:
                    amount = round(amount * a) if abs(a - 1) > 1e-6 else amount
                elif what == 1:
                    waiting.append(a)
                else:
                    if amount > 0:
                        paid -= sum(waiting) * amount
                        waiting = []
                    if a > 0:
                        out.append((name, day, int(a), b, amount, None, None, None))
                        amount, paid = amount + int(a), paid + a * b + c
                        continue
                    sold = min(amount, int(-a))
                    if sold <= 0:
                        continue
                    part = paid * sold / amount
                    pnl = sold * b - part - c
                    out.append((name, day, -sold, b, amount, part, pnl, pnl / part * 100 if part > 0 else 0.0))
                    amount, paid = amount - sold, paid - part
            yield pd.DataFrame(out, columns=[x.split()[0] for x in LEDGER.split(", ")])

    return rows.mapInPandas(run, LEDGER)


def trade_stats(ledger: DataFrame, eps: float = 1e-6) -> DataFrame:
    """One row over all closed trades: wins, losses, win rate, profit to loss, mean profit and loss, and in percent."""
    won, lost = F.col("pnl") > eps, F.col("pnl") < -eps
    wins, losses = F.count_if(won), F.count_if(lost)
    up, down = F.sum(F.when(won, F.col("pnl"))), F.sum(F.when(lost, F.col("pnl")))
    return ledger.agg(wins.alias("profit_count"), losses.alias("loss_count"), F.try_divide(wins, wins + losses).alias("win_rate"), (up / F.abs(down)).alias("profit_loss_ratio"), F.avg(F.when(won, F.col("pnl"))).alias("avg_win"), F.avg(F.when(lost, F.col("pnl"))).alias("avg_loss"), F.avg(F.when(won, F.col("pnl_pct"))).alias("avg_win_pct"), F.avg(F.when(lost, F.col("pnl_pct"))).alias("avg_loss_pct"))
