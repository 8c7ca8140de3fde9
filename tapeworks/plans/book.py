"""SQL of the backtests: a recursive walk over bars that holds the book of each run, one row for each bar and run."""

from __future__ import annotations

from itertools import product

from tapeworks.operators.backtest import GRID
from tapeworks.plans.oracle import DAILY, HOURLY, signalled

#: What a run carries on: its terms, the open position and the order that waits for the next open.
TERMS = ("symbol", "run", "kind", "hi", "from_i", "sc", "tr", "hold")
POSITION = ("s", "sk", "ei", "en", "n", "st", "ta", "paid")
ORDER = ("ws", "wk", "wst", "wta")
def exact(x: str, places: int) -> str:
    """``x`` rounded as numpy does: the nearest whole of the scaled number, halves to even."""
    return f"round_even(({x}) * 1e{places}, 0) / 1e{places}"


#: The trade closed on a bar, as the ledger shows it.
TRADE = {
    "side": "CAST(s1 AS INT)", "signal_i": "sk1", "entry_i": "ei1", "entry": exact("en1", 4), "exit": exact("ox", 4), "shares": "CAST(n1 AS BIGINT)", "bars_held": "t1 - ei1",
    "pnl": exact("pnl1", 2), "return_pct": exact("100 * pnl1 / (en1 * n1)", 3), "r": f"CASE WHEN abs(en1 - st1) * n1 > 0 THEN {exact('pnl1 / (abs(en1 - st1) * n1)', 3)} ELSE 0 END",
}
BARS = "wb AS MATERIALIZED (SELECT symbol, spec_id, i, open AS o, high AS h, low AS l, close AS c, volume AS v, lag(close) OVER (PARTITION BY symbol, spec_id ORDER BY i) AS pc, side, a FROM sj)"


def fees(price: str, shares: str) -> str:
    return f"(greatest({price} * {shares} * 0.15e0 / 100, {shares} * 0.03e0) * 1.15e0 + {price} * {shares} * 0.02e0 / 100)"


def walk(name: str, runs: str) -> list[str]:
    """``name``, the ledger of ``runs`` (TERMS and lo: bars lo to hi - 1, signals from from_i on)."""
    null = ", ".join([*(f"CAST(NULL AS DOUBLE) AS {c}" for c in (*POSITION, *ORDER)), *(f"CAST(NULL AS {'BIGINT' if c in ('shares', 'signal_i', 'entry_i', 'side', 'bars_held') else 'DOUBLE'}) AS {c}" for c in TRADE), "CAST(NULL AS VARCHAR) AS reason", "CAST(NULL AS VARCHAR) AS skipped"])
    kept = ", ".join(TERMS)
    steps = [
        f"SELECT r.*, r.t + 1 AS t1, b.o, b.h, b.l, b.c, b.v, b.pc, b.side AS bs, b.a, b.o + ws * (b.o * 10e0 / 10000 + 0.01e0) AS e0 FROM {name}_w r JOIN wb b ON b.symbol = r.symbol AND b.spec_id = r.kind AND b.i = r.t + 1 WHERE r.t + 1 < r.hi",
        "SELECT *, CASE WHEN wk IS NULL THEN NULL WHEN v = 0 THEN 'zero_volume' WHEN h = l AND abs(o / pc - 1) * 100 >= 0.98e0 * 7.5e0 AND ws * (o / pc - 1) > 0 THEN 'price_limit_locked' WHEN ws * (o - wst) <= 0 THEN 'gap_through_stop' WHEN ws * (o - wta) >= 0 THEN 'gap_through_target' END AS why, "
        "CASE WHEN abs(e0 - wst) > 0 THEN trunc(least(eq * 0.01e0 / abs(e0 - wst), eq / e0, 0.1e0 * v)) ELSE 0 END AS n0 FROM ({})",
        "SELECT *, wk IS NOT NULL AND why IS NULL AND n0 > 0 AS opened FROM ({})",
        f"SELECT *, CASE WHEN opened THEN ws ELSE s END AS s1, CASE WHEN opened THEN wk ELSE sk END AS sk1, CASE WHEN opened THEN t1 ELSE ei END AS ei1, CASE WHEN opened THEN e0 ELSE en END AS en1, CASE WHEN opened THEN n0 ELSE n END AS n1, CASE WHEN opened THEN wst ELSE st END AS st1, CASE WHEN opened THEN wta ELSE ta END AS ta1, CASE WHEN opened THEN {fees('e0', 'n0')} ELSE paid END AS paid1, CASE WHEN wk IS NOT NULL AND NOT opened THEN coalesce(why, 'size_zero_liquidity') END AS skip1 FROM ({{}})",
        "SELECT *, CASE WHEN s1 * (CASE WHEN s1 > 0 THEN l ELSE h END - st1) <= 0 THEN 'stop' WHEN s1 * (CASE WHEN s1 > 0 THEN h ELSE l END - ta1) >= 0 THEN 'target' WHEN t1 - ei1 >= hold THEN 'time' WHEN s1 IS NOT NULL AND t1 = hi - 1 THEN 'end_of_data' END AS why1 FROM ({})",
        "SELECT *, CASE why1 WHEN 'stop' THEN CASE WHEN s1 * (o - st1) < 0 AND t1 > ei1 THEN o ELSE st1 END WHEN 'target' THEN CASE WHEN s1 * (o - ta1) > 0 AND t1 > ei1 THEN o ELSE ta1 END ELSE c END AS px FROM ({})",
        "SELECT *, px - s1 * (px * 10e0 / 10000 + 0.01e0) AS ox FROM ({})",
        f"SELECT *, CASE WHEN why1 IS NOT NULL THEN s1 * (ox - en1) * n1 - {fees('ox', 'n1')} - paid1 END AS pnl1, (s1 IS NULL OR why1 IS NOT NULL) AND t1 < hi - 1 AND t1 >= from_i AND bs IS NOT NULL AS asks FROM ({{}})",
    ]
    step = steps[0]
    for s in steps[1:]:
        step = s.format(step)
    places = ", ".join(f"CAST(CASE WHEN why1 IS NULL THEN {c}1 END AS DOUBLE)" for c in POSITION)
    orders = "CAST(CASE WHEN asks THEN bs END AS DOUBLE), CAST(CASE WHEN asks THEN t1 END AS DOUBLE), CASE WHEN asks THEN c - bs * sc * a END, CASE WHEN asks THEN c + tr * (c - (c - bs * sc * a)) END"
    closed = ", ".join(f"CASE WHEN why1 IS NOT NULL THEN {x} END" for x in TRADE.values())
    return [
        f"{name}_w AS (SELECT {kept}, CAST(lo - 1 AS BIGINT) AS t, 1e6 AS eq, 1e6 AS equity, {null} FROM {runs} UNION ALL SELECT {kept}, t1, eq + coalesce(pnl1, 0), {exact('eq + coalesce(pnl1, CASE WHEN s1 IS NOT NULL THEN s1 * (c - en1) * n1 END, 0)', 2)}, {places}, {orders}, {closed}, why1, skip1 FROM ({step}))",
        f"{name} AS (SELECT w.* FROM {name}_w w JOIN {runs} u USING (symbol, run) WHERE t >= lo)",
    ]


def figures(name: str, ledger: str) -> list[str]:
    """``name``: the figures of each run of ``ledger``."""
    return [
        f"{name}_p AS (SELECT *, max(equity) OVER (PARTITION BY symbol, run ORDER BY t) AS peak, lag(equity) OVER (PARTITION BY symbol, run ORDER BY t) AS past FROM {ledger})",
        f"{name} AS (SELECT symbol, run, count(reason) AS trades, count(*) AS bars, avg(CASE WHEN return_pct > 0 THEN 1e0 WHEN return_pct <= 0 THEN 0e0 END) AS win_rate, avg(return_pct) FILTER (return_pct > 0) AS avg_win_pct, avg(return_pct) FILTER (return_pct <= 0) AS avg_loss_pct, min((equity - peak) / peak) * 100 AS max_drawdown_pct, avg(r) AS expectancy_r, avg(return_pct) AS expectancy_pct, "
        f"avg(bars_held) AS avg_holding_bars, count(skipped) AS skipped, max_by(equity, t) AS final_equity, CASE WHEN count(reason) >= 20 AND count(past) >= 120 AND stddev_pop(equity / past - 1) > 0 THEN avg(equity / past - 1) / stddev_pop(equity / past - 1) * sqrt(245) END AS sharpe, CASE WHEN sum(pnl) FILTER (pnl <= 0) < 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / -sum(pnl) FILTER (pnl <= 0) END AS profit_factor, 100e0 * count(reason) / count(*) AS signals_per_100_bars FROM {name}_p GROUP BY symbol, run)",
    ]


def backtests() -> dict[str, str]:
    base = [*(DAILY if x is HOURLY else x for x in signalled()), BARS, "sn AS (SELECT symbol, max(i) + 1 AS n FROM wb GROUP BY symbol)"]
    usual = "2e0 AS sc, 2e0 AS tr, 40 AS hold"
    each = f"ru AS (SELECT symbol, k AS run, k AS kind, 0 AS lo, n AS hi, 0 AS from_i, {usual} FROM sn, range(3) z(k))"
    halves = f"sp AS (SELECT symbol, n, CAST(floor(n * 0.7e0) AS BIGINT) AS split_i FROM sn), ru AS (SELECT symbol, 0 AS run, 0 AS kind, 0 AS lo, split_i AS hi, 0 AS from_i, {usual} FROM sp WHERE split_i > 0 UNION ALL SELECT symbol, 1, 0, split_i, n, split_i, {usual} FROM sp WHERE split_i < n)"
    sets = ", ".join(f"({k}, {a}e0, {b}, {c}e0)" for k, (a, b, c) in enumerate([*product(*GRID.values()), (2.0, 40, 2.0)]))
    none = len(list(product(*GRID.values())))
    folds = [
        "f0 AS (SELECT symbol, n, CAST(floor(n * 0.6e0) AS BIGINT) AS f FROM sn)",
        "fo AS (SELECT symbol, k AS fold, f + k * step AS start, least(n, f + (k + 1) * step) AS stop_i FROM (SELECT *, greatest(1, (n - f) // 4) AS step FROM f0), range(4) z(k) WHERE least(n, f + (k + 1) * step) - (f + k * step) >= 10)",
        f"se(k, sc, hold, tr) AS (VALUES {sets})",
        f"ru AS (SELECT symbol, fold * 1000 + k AS run, 0 AS kind, 0 AS lo, start AS hi, 0 AS from_i, sc, tr, hold FROM fo, se WHERE k < {none})",
        *walk("tl", "ru"), "tg AS (SELECT symbol, run // 1000 AS fold, run % 1000 AS k, avg(r) AS e FROM tl WHERE reason IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)",
        "th AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY round(e, 9) DESC, k) AS place FROM tg)",
        f"ch AS (SELECT fo.*, coalesce(th.k, {none}) AS k, th.e FROM fo LEFT JOIN th ON th.symbol = fo.symbol AND th.fold = fo.fold AND place = 1)",
        "rv AS (SELECT symbol, fold AS run, 0 AS kind, 0 AS lo, stop_i AS hi, start AS from_i, sc, tr, hold FROM ch JOIN se USING (k))",
        *walk("vl", "rv"), *figures("fg", "vl"),
    ]
    say = lambda ctes, rest: f"WITH RECURSIVE {', '.join([*base, *ctes])} SELECT {rest}"
    of = lambda *names: ", ".join(f"round({x}, 6) AS {x}" for x in names)
    return {
        "bkt06_trades": say([each, *walk("lg", "ru")], f"symbol, run AS spec_id, t AS i, {', '.join(TRADE)}, reason FROM lg WHERE reason IS NOT NULL"),
        "bkt08_metrics": say([each, *walk("lg", "ru"), *figures("fg", "lg")], f"symbol, run AS spec_id, trades, bars, skipped, {of('win_rate', 'avg_win_pct', 'avg_loss_pct', 'max_drawdown_pct', 'expectancy_r', 'expectancy_pct', 'avg_holding_bars', 'final_equity', 'sharpe', 'profit_factor', 'signals_per_100_bars')} FROM fg"),
        "bkt09_walk_forward": say(folds, f"ch.symbol, fold, start, stop_i, se.sc AS stop_scales, se.hold AS max_hold, se.tr AS target_r, round(e, 6) AS train_expectancy_r, trades, {of('win_rate', 'expectancy_r', 'profit_factor')} FROM ch JOIN fg ON fg.symbol = ch.symbol AND fg.run = ch.fold JOIN se ON se.k = ch.k"),
        "bkt10_split": say([halves, *walk("lg", "ru"), *figures("fg", "lg")], f"fg.symbol, CASE WHEN run = 0 THEN 'in_sample' ELSE 'out_of_sample' END AS part, split_i, trades, {of('win_rate', 'expectancy_r', 'profit_factor', 'final_equity')} FROM fg JOIN sp USING (symbol)"),
    }
