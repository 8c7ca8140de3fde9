"""Signals by windows, a ledger by one grouped pass, and figures of it by aggregates.

Any number of specifications runs in one job: they are rows, joined with the bars, and each (series, specification) is
a group of its own. Walking forward, whose sets share their signals, sends each bar once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.rolling import before, mean
from tapeworks.operators import patterns
from tapeworks.operators.recursive import recursive, zigzag
from tapeworks.sources.bars import SERIES


@dataclass(frozen=True)
class Costs:
    """Percent of value, money a share, basis points and ticks; a bar is locked at 98 % of the daily limit."""

    commission_pct: float = 0.15
    commission_share: float = 0.03
    tax_pct: float = 15.0
    levies_pct: float = 0.02
    slippage_bps: float = 10.0
    tick: float = 0.01
    spread_ticks: float = 2.0
    limit_pct: float = 7.5
    participation: float = 0.1

    def fees(self, price: float, shares: int) -> float:
        value = price * shares
        return max(value * self.commission_pct / 100, shares * self.commission_share) * (1 + self.tax_pct / 100) + value * self.levies_pct / 100

    def fill(self, price: float, buy: bool) -> float:
        worse = price * self.slippage_bps / 1e4 + self.spread_ticks * self.tick / 2
        return price + worse if buy else price - worse


#: A specification: what triggers, and where stop and target lie.
SPEC = "spec_id int, kind string, fast int, slow int, level double, stop_scales double, target_r double, max_hold int, allow_short boolean, trend_filter boolean"
DEFAULTS = {"kind": "sma_cross", "fast": 20, "slow": 50, "level": 30.0, "stop_scales": 2.0, "target_r": 2.0, "max_hold": 40, "allow_short": False, "trend_filter": False}


def specs(spark, rows: list[dict]) -> DataFrame:
    """Specifications from keyword sets; what is left out is as in ``DEFAULTS``."""
    return spark.createDataFrame([(k, *(DEFAULTS | row).values()) for k, row in enumerate(rows)], SPEC)


def signals(bars: DataFrame, specifications: DataFrame, averages: tuple[int, ...] = (20, 50)) -> DataFrame:
    """Each bar for each specification, with side (1, -1 or null), stop and target of the signal that its close gives.

    ``bars`` hold ``scale``, ``rsi`` and ``macd_hist``. Kinds: ``sma_cross`` of two of ``averages``, ``rsi_recovery``
    through ``level`` (and its mirror), ``macd_cross`` of the histogram through 0. The specifications are few and bounded.
    """
    bars = bars.withColumns({f"_sma{p}": mean(F.col("close"), p) for p in {*averages, 200}})
    bars = bars.withColumns({f"_p{c}": before(F.col(c)) for c in ("rsi", "macd_hist", *(f"_sma{p}" for p in averages))})
    rows = bars.crossJoin(F.broadcast(specifications))
    pick = lambda of, form: F.coalesce(*(F.when(F.col(of) == p, F.col(form.format(p))) for p in averages))
    f, s, pf, ps = pick("fast", "_sma{}"), pick("slow", "_sma{}"), pick("fast", "_p_sma{}"), pick("slow", "_p_sma{}")
    kind, c = F.col("kind"), F.col
    up = F.when(kind == "sma_cross", (f > s) & (pf <= ps)).when(kind == "rsi_recovery", (c("_prsi") < c("level")) & (c("rsi") >= c("level"))).otherwise((c("macd_hist") > 0) & (c("_pmacd_hist") <= 0))
    down = F.when(kind == "sma_cross", (f < s) & (pf >= ps)).when(kind == "rsi_recovery", (c("_prsi") > 100 - c("level")) & (c("rsi") <= 100 - c("level"))).otherwise((c("macd_hist") < 0) & (c("_pmacd_hist") >= 0))
    allowed = lambda side: ~c("trend_filter") | F.coalesce(side * (c("close") - c("_sma200")) > 0, F.lit(False))
    side = F.when(up & allowed(1), 1).when(down & c("allow_short") & allowed(-1), -1)
    stop = c("close") - c("side") * c("stop_scales") * c("scale")
    rows = rows.withColumn("side", side).withColumn("stop", stop).withColumn("target", c("close") + c("target_r") * (c("close") - c("stop")))
    return rows.select(*SERIES, "i", "open", "high", "low", "close", "volume", "spec_id", "stop_scales", "target_r", "max_hold", "side", "stop", "target")


LEDGER = "symbol string, timeframe string, spec_id int, i int, equity double, side int, signal_i int, entry_i int, entry double, exit double, shares long, reason string, bars_held int, pnl double, return_pct double, r double, skipped string"
LEDGER_COLUMNS = [x.split()[0] for x in LEDGER.split(", ")]


@dataclass(frozen=True)
class Prices:
    """One series as arrays, in order of time."""

    open: np.ndarray
    high: np.ndarray
    low: np.ndarray
    close: np.ndarray
    volume: np.ndarray

    @classmethod
    def of(cls, bars: pd.DataFrame) -> Prices:
        return cls(*(bars[x].to_numpy(float) for x in ("open", "high", "low", "close", "volume")))

    def part(self, start: int, stop: int) -> Prices:
        return Prices(*(x[start:stop] for x in (self.open, self.high, self.low, self.close, self.volume)))


def refusal(p: Prices, t: int, sign: float, stop: float, target: float, costs: Costs) -> str | None:
    """Why the open of bar ``t`` can't fill an order."""
    moved = p.open[t] / p.close[t - 1] - 1
    if p.volume[t] == 0:
        return "zero_volume"
    if p.high[t] == p.low[t] and sign * moved > 0 and abs(moved) * 100 >= 0.98 * costs.limit_pct:
        return "price_limit_locked"
    if sign * (p.open[t] - stop) <= 0:
        return "gap_through_stop"
    return "gap_through_target" if sign * (p.open[t] - target) >= 0 else None


def shares_for(equity: float, entry: float, stop: float, volume: float, costs: Costs, risk: float) -> int:
    """The least of what risk, equity and the bar's volume (if known) allow."""
    gap = abs(entry - stop)
    caps = [equity * risk / gap if gap > 0 else 0.0, equity / entry, costs.participation * volume]
    return int(min(x for x in caps if not math.isnan(x)))


def way_out(p: Prices, entered: int, sign: float, stop: float, target: float, hold: float) -> tuple[int, float, str]:
    """(bar, price, reason) of leaving a position: the first bar within the holding time that touches stop or target.

    Both on one bar count as the stop; a bar that opens beyond either, save that of entry, fills at its open.
    """
    last = len(p.close) - 1
    end = int(min(last, entered + hold))
    near, far = (p.low, p.high) if sign > 0 else (p.high, p.low)
    span = slice(entered, end + 1)
    stopped, reached = sign * (near[span] - stop) <= 0, sign * (far[span] - target) >= 0
    touched = np.flatnonzero(stopped | reached)
    if not len(touched):
        return end, p.close[end], "time" if end - entered >= hold else "end_of_data"
    at = int(touched[0])
    reason, edge, beyond = ("stop", stop, -sign) if stopped[at] else ("target", target, sign)
    opened = p.open[entered + at]
    return entered + at, opened if at and beyond * (opened - edge) > 0 else edge, reason


def simulate(p: Prices, side: np.ndarray, stop: np.ndarray, target: np.ndarray, hold: float, costs: Costs, capital: float, risk: float) -> tuple[np.ndarray, list[dict], dict[int, str]]:
    """(equity at each close, trades, refusals by bar) of one series and specification.

    A signal met while flat is filled at the next open or refused. The walk is from signal to signal: bars between, and
    those of a position, are looked at as arrays. The close that ends a position may signal the next one.
    """
    n = len(side)
    worth, trades, refused, equity = np.full(n, capital), [], {}, capital
    wanted = np.flatnonzero(~np.isnan(side[: max(n - 1, 0)]))
    place = 0
    while place < len(wanted):
        k = int(wanted[place])
        t, sign = k + 1, side[k]
        why = refusal(p, t, sign, stop[k], target[k], costs)
        entry = costs.fill(p.open[t], sign > 0)
        shares = 0 if why else shares_for(equity, entry, stop[k], p.volume[t], costs, risk)
        if shares <= 0:
            refused[t] = why or "size_zero_liquidity"
            place += 1
            continue
        left, price, reason = way_out(p, t, sign, stop[k], target[k], hold)
        got = costs.fill(price, sign < 0)
        pnl = sign * (got - entry) * shares - costs.fees(got, shares) - costs.fees(entry, shares)
        risked = abs(entry - stop[k]) * shares
        worth[t:left] = equity + sign * (p.close[t:left] - entry) * shares
        equity += pnl
        worth[left:] = equity
        trades.append({"t": left, "side": int(sign), "signal_i": k, "entry_i": t, "entry": round(entry, 4), "exit": round(got, 4), "shares": shares, "reason": reason, "bars_held": left - t, "pnl": round(pnl, 2), "return_pct": round(100 * pnl / (entry * shares), 3), "r": round(pnl / risked, 3) if risked > 0 else 0.0})
        place = int(np.searchsorted(wanted, left))
    return worth.round(2), trades, refused


WHOLE = {"side": "Int32", "signal_i": "Int32", "entry_i": "Int32", "bars_held": "Int32", "shares": "Int64"}


def booked(at: np.ndarray, worth: np.ndarray, trades: list[dict], refused: dict[int, str]) -> pd.DataFrame:
    """What ``simulate`` found as a row for each bar; ``at`` holds their numbers."""
    made = pd.DataFrame(trades, columns=["t", *LEDGER_COLUMNS[5:-1]]).set_index("t").reindex(range(len(at)))
    return made.assign(i=at, equity=worth, skipped=pd.Series(refused, dtype=object)).astype(WHOLE)


def simulated(bars: pd.DataFrame, costs: Costs = Costs(), capital: float = 1_000_000.0, risk: float = 0.01) -> pd.DataFrame:
    """The ledger of one series and specification, as rows of ``LEDGER``."""
    bars = bars.sort_values("i")
    side, stop, target = (bars[x].to_numpy(float) for x in ("side", "stop", "target"))
    first = bars.iloc[0]
    rows = booked(bars["i"].to_numpy(), *simulate(Prices.of(bars), side, stop, target, float(first["max_hold"]), costs, capital, risk))
    return rows.assign(symbol=first["symbol"], timeframe=first["timeframe"], spec_id=first["spec_id"])[LEDGER_COLUMNS]


def ledger(signalled: DataFrame, costs: Costs = Costs(), capital: float = 1_000_000.0, risk: float = 0.01) -> DataFrame:
    """A row for each bar and specification of ``signals``: the equity, and the trade that was closed on it, if any."""
    return signalled.groupBy(*SERIES, "spec_id").applyInPandas(lambda b: simulated(b, costs, capital, risk), LEDGER)


def trades(ledgers: DataFrame) -> DataFrame:
    return ledgers.where("reason is not null").drop("equity", "skipped")


def metrics(ledgers: DataFrame, year: int = 245, also: Sequence[str] = ()) -> DataFrame:
    """Figures of each series and specification, and the columns ``also``, which are one value for each.

    The Sharpe ratio needs 20 trades and 120 returns; null where undefined.
    """
    key = [*SERIES, "spec_id"]
    w = Window.partitionBy(*key).orderBy("i")
    rows = ledgers.withColumns({"peak": F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0)), "past": F.lag("equity").over(w)})
    won = F.col("return_pct") > 0
    of = lambda x, condition: F.when(condition, x)
    figures = rows.groupBy(*key).agg(
        F.count("reason").alias("trades"), F.count("*").alias("bars"), F.avg(won.cast("double")).alias("win_rate"), F.avg(of(F.col("return_pct"), won)).alias("avg_win_pct"), F.avg(of(F.col("return_pct"), ~won)).alias("avg_loss_pct"),
        F.sum(of(F.col("pnl"), F.col("pnl") > 0)).alias("gained"), F.sum(of(-F.col("pnl"), F.col("pnl") <= 0)).alias("lost"), (F.min((F.col("equity") - F.col("peak")) / F.col("peak")) * 100).alias("max_drawdown_pct"),
        F.avg("r").alias("expectancy_r"), F.avg("return_pct").alias("expectancy_pct"), F.avg("bars_held").alias("avg_holding_bars"), F.count("past").alias("returns"), F.avg(F.col("equity") / F.col("past") - 1).alias("mean"), F.stddev_pop(F.col("equity") / F.col("past") - 1).alias("spread"),
        F.count("skipped").alias("skipped"), F.max_by("equity", "i").alias("final_equity"), *(F.first(c).alias(c) for c in also),
    )
    sharpe = F.when((F.col("trades") >= 20) & (F.col("returns") >= 120) & (F.col("spread") > 0), F.col("mean") / F.col("spread") * F.sqrt(F.lit(float(year))))
    factor = F.when(F.col("lost") > 0, F.coalesce(F.col("gained"), F.lit(0.0)) / F.col("lost"))
    return figures.withColumns({"sharpe": sharpe, "profit_factor": factor, "signals_per_100_bars": 100 * F.col("trades") / F.col("bars")}).drop("gained", "lost", "mean", "spread", "returns")


GRID = {"stop_scales": [1.5, 2.0, 3.0], "max_hold": [20, 40], "target_r": [2.0, 3.0]}


TESTED = LEDGER + ", fold int, start int, stop_i int, chosen int, train_expectancy_r double"


def walk_forward(bars: DataFrame, spec: dict, folds: int = 4, train: float = 0.6, least: int = 3) -> DataFrame:
    """(symbol, timeframe, fold, chosen parameters, figures of the test): the grid's best by expectancy on all before a fold, run on the fold.

    The sets share their signals, so bars go once to their series' group, where each fold is trained and tested; what
    leaves it is the ledgers of the tests. A set needs ``least`` trades; where none has them the defaults are tested.
    Folds of under ten bars are left out.
    """
    spark, costs, capital, risk = bars.sparkSession, Costs(), 1_000_000.0, 0.01
    sets = [DEFAULTS | spec | dict(zip(GRID, x, strict=True)) for x in product(*GRID.values())] + [DEFAULTS | spec]
    signalled = signals(bars, specs(spark, [spec])).join(bars.select(*SERIES, "i", "scale"), [*SERIES, "i"])

    def run(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("i")
        p, at, side, scales, n = Prices.of(series), series["i"].to_numpy(), series["side"].to_numpy(float), series["scale"].to_numpy(float), len(series)

        def outcome(k: int, stop_i: int, start: int | None = None) -> tuple:
            """Set ``k`` on the bars before ``stop_i``, with signals from ``start`` on if that is given."""
            seen = side[:stop_i].copy()
            if start is not None:
                seen[:start] = seen[stop_i - 1 :] = np.nan
            close = p.close[:stop_i]
            stop = close - seen * sets[k]["stop_scales"] * scales[:stop_i]
            return simulate(p.part(0, stop_i), seen, stop, close + sets[k]["target_r"] * (close - stop), float(sets[k]["max_hold"]), costs, capital, risk)

        first, made = int(n * train), []
        step = max(1, (n - first) // folds)
        for fold in range(folds):
            start, stop_i = first + fold * step, min(n, first + (fold + 1) * step)
            if stop_i - start < 10:
                continue
            gained = {k: [x["r"] for x in outcome(k, start)[1]] for k in range(len(sets) - 1)}
            means = {k: float(np.mean(x)) for k, x in gained.items() if len(x) >= least}
            chosen = max(means, key=lambda k: (means[k], -k), default=len(sets) - 1)
            made.append(booked(at[:stop_i], *outcome(chosen, stop_i, start)).assign(spec_id=fold, fold=fold, start=start, stop_i=stop_i, chosen=chosen, train_expectancy_r=means.get(chosen)))
        names = [x.split()[0] for x in TESTED.split(", ")]
        if not made:
            return pd.DataFrame(columns=names)
        return pd.concat(made).assign(symbol=series["symbol"].iloc[0], timeframe=series["timeframe"].iloc[0])[names].astype({"train_expectancy_r": float})

    tested = signalled.groupBy(*SERIES).applyInPandas(run, TESTED)
    fixed = ["fold", "start", "stop_i", "chosen", "train_expectancy_r"]
    params = [F.element_at(F.array(*(F.lit(x[c]) for x in sets)), F.col("chosen") + 1).alias(c) for c in GRID]
    return metrics(tested, also=fixed).select(*SERIES, *fixed[:3], *params, "train_expectancy_r", "trades", "win_rate", "expectancy_r", "profit_factor")


def split(bars: DataFrame, spec: dict, share: float = 0.7) -> DataFrame:
    """(symbol, timeframe, part, split_i, figures): ``spec`` on the first ``share`` of each series, and on the rest, in one job."""
    grid = signals(bars, specs(bars.sparkSession, [spec])).drop("spec_id")
    n = bars.groupBy(*SERIES).agg(F.floor(F.count("*") * share).cast("int").alias("split_i"))
    both = grid.join(n, SERIES).withColumn("spec_id", F.when(F.col("i") < F.col("split_i"), 0).otherwise(1))
    part = F.when(F.col("spec_id") == 0, "in_sample").otherwise("out_of_sample")
    return metrics(ledger(both.drop("split_i"))).withColumn("part", part).drop("spec_id").join(n, SERIES)


def by_symbol(figures: DataFrame) -> DataFrame:
    """What a table of symbols shows of ``metrics``."""
    return figures.select("symbol", "timeframe", "trades", "expectancy_r", "win_rate", "profit_factor")


def replayed(bars: DataFrame, lookback: int = 250, least: int = 40) -> DataFrame:
    """For each bar of ``bars`` the ``lookback`` bars up to it as a series of its own, called ``symbol@i``, without those of fewer than ``least``.

    So whatever works on series sees each bar as the last one. The frame is ``lookback`` times as long.
    """
    c = F.col
    last = F.count("*").over(Window.partitionBy(*SERIES)) - 1
    rows = bars.withColumn("_last", last).withColumn("t", F.explode(F.sequence(F.greatest(c("i"), F.lit(least - 1)), F.least(c("i") + lookback - 1, c("_last")))))
    rows = rows.where(c("t") >= c("i"))
    start = F.greatest(F.lit(0), c("t") - lookback + 1)
    return rows.select(F.concat_ws("@", "symbol", "t").alias("symbol"), "timeframe", "ts", "open", "high", "low", "close", "volume", (c("i") - start).cast("int").alias("i"))


def pattern_signals(bars: DataFrame, pattern_ids: tuple[str, ...], lookback: int = 250, allow_short: bool = False, volume: bool = False, trend_filter: bool = False, target_r: float | None = None, max_hold: int = 40, buffer: float = 0.2, stop_scales: float = 2.0) -> DataFrame:
    """Signals, as ``ledger`` takes them, at each bar that confirms a pattern among the ``lookback`` bars up to it, of several the best.

    Stop beyond the pattern's invalidation, or where it has none beyond ``stop_scales`` from its level, by ``buffer``
    scales; target that of the pattern, or ``target_r`` (twice, where it has none) times the risk. All bars of all series are looked at in one job.
    """
    c = F.col
    seen = recursive(replayed(bars, lookback), "scale")
    found = patterns.detect(patterns.context(seen), zigzag(seen), pattern_ids)
    found = found.where((c("confirmation_idx") == c("last")) & ~c("provisional") & c("direction").isin("bullish", "bearish"))
    found = found.where(c("direction") == "bullish") if not allow_short else found
    found = found.where(F.coalesce("volume_confirmation", F.lit(False))) if volume else found
    now = seen.groupBy(*SERIES).agg(F.max_by("scale", "i").alias("scale"))
    cut = F.length("symbol") - F.locate("@", F.reverse("symbol"))
    named = found.join(now, SERIES).withColumns({"i": F.substring_index("symbol", "@", -1).cast("int"), "symbol": F.left("symbol", cut)})
    sgn = F.when(c("direction") == "bullish", 1).otherwise(-1)
    if trend_filter:  # before the best is chosen, so that one against the trend hides no other
        trend = bars.select(*SERIES, "i", (c("close") - mean(c("close"), 200)).alias("_trend"))
        named = named.join(trend, [*SERIES, "i"]).where(sgn * c("_trend") > 0)
    stop = F.coalesce("inval", c("level") - sgn * stop_scales * c("scale")) - sgn * buffer * c("scale")
    best = named.groupBy(*SERIES, "i").agg(F.max_by(F.struct(sgn.alias("side"), stop.alias("stop"), c("target").alias("goal")), F.struct("quality", -c("start_idx"))).alias("x"))
    rows = bars.join(best, [*SERIES, "i"], "left")
    goal = F.lit(None).cast("double") if target_r is not None else c("x.goal")
    goal = F.coalesce(goal, c("close") + c("x.side") * (target_r or 2.0) * F.abs(c("close") - c("x.stop")))
    return rows.select(*SERIES, "i", "open", "high", "low", "close", "volume", F.lit(0).alias("spec_id"), F.lit(stop_scales).alias("stop_scales"), F.lit(target_r or 2.0).alias("target_r"), F.lit(max_hold).alias("max_hold"), c("x.side").alias("side"), c("x.stop").alias("stop"), goal.alias("target"))
