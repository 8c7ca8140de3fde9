"""SQL that the queries' results are held against. Parts are common table expressions that build on one another."""

from __future__ import annotations

HOURLY = """
bars AS (
  SELECT symbol, h AS ts, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY h) - 1 AS i
  FROM (SELECT event_type AS symbol, date_trunc('hour', ts) AS h, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
               min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM events WHERE value IS NOT NULL GROUP BY 1, 2))"""
DAILY = """
bars AS (
  SELECT symbol, d AS ts, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS i
  FROM (SELECT l_returnflag AS symbol, date_trunc('day', l_shipdate) AS d, max(p) AS high, min(p) AS low, sum(l_quantity) AS volume,
               first(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS open,
               last(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS close
        FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) WHERE p IS NOT NULL GROUP BY 1, 2))"""
LINES = DAILY.replace("l_returnflag AS symbol", "l_returnflag || ' ' || l_linenumber AS symbol")
PER = "PARTITION BY symbol ORDER BY i"


def w(n: int, skip: int = 0) -> str:
    end = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return f"({PER} ROWS BETWEEN {n + skip - 1} PRECEDING AND {end})"


def full(value: str, x: str, n: int, skip: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {w(n, skip)} >= {n} THEN {value} END"


def mean(x: str, n: int, skip: int = 0) -> str:
    return full(f"avg({x}) OVER {w(n, skip)}", x, n, skip)


def total(x: str, n: int) -> str:
    return full(f"sum({x}) OVER {w(n)}", x, n)


def highest(x: str, n: int) -> str:
    return full(f"max({x}) OVER {w(n)}", x, n)


def lowest(x: str, n: int) -> str:
    return full(f"min({x}) OVER {w(n)}", x, n)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({PER})"


def select(ctes: list[str], columns: dict[str, str], source: str = "bars", keys: str = "symbol, i", exact: tuple[str, ...] = ()) -> str:
    shown = ", ".join(f"{x} AS {name}" if name in exact else f"round({x}, 6) AS {name}" for name, x in columns.items())
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT {keys}, {shown} FROM {source}"


def stage(name: str, source: str, **columns: str) -> str:
    """A table expression that adds columns to ``source``."""
    return f"{name} AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM {source})"


def smooth(name: str, source: str, x: str, period: int, alpha: str) -> list[str]:
    """(symbol, i, e): smoothing of ``x`` of ``source`` from the mean of its first ``period`` known values."""
    return [
        f"{name}_x AS (SELECT symbol, i, {x} AS x FROM {source})",
        f"{name}_f AS (SELECT symbol, min(i) AS f FROM {name}_x WHERE x IS NOT NULL GROUP BY symbol)",
        f"{name}_s AS (SELECT symbol, any_value(f) + {period - 1} AS i, avg(x) AS e FROM {name}_x JOIN {name}_f USING (symbol) WHERE i BETWEEN f AND f + {period - 1} GROUP BY symbol HAVING count(x) = {period})",
        f"{name} AS (SELECT symbol, i, e FROM {name}_s UNION ALL SELECT s.symbol, s.i, CASE WHEN s.x IS NULL THEN r.e ELSE r.e + {alpha} * (s.x - r.e) END FROM {name} r JOIN {name}_x s ON s.symbol = r.symbol AND s.i = r.i + 1)",
    ]


def with_smooth(name: str, source: str, **smoothed: str) -> str:
    """``source`` with a column ``e`` of each named smoothing."""
    joins = " ".join(f"LEFT JOIN {s} ON {s}.symbol = a.symbol AND {s}.i = a.i" for s in smoothed.values())
    return f"{name} AS (SELECT a.*, {', '.join(f'{s}.e AS {c}' for c, s in smoothed.items())} FROM {source} a {joins})"


TR = "CASE WHEN lag(close) OVER ({p}) IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER ({p})), abs(low - lag(close) OVER ({p}))) END".format(p=PER)
TYPICAL = "(high + low + close) / 3"
FLOW = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0)"


def indicators() -> dict[str, str]:
    """The SQL of the queries of ``plans.indicators`` by name."""
    H = [HOURLY]
    out = {"ind01_sma": select(H, {f"sma_{p}": mean("close", p) for p in (10, 20, 50, 100, 200)})}
    emas = {p: smooth(f"e{p}", "bars", "close", p, f"(2.0 / {p + 1})") for p in (9, 20, 50, 100, 200)}
    out["ind02_ema"] = select([HOURLY, *sum(emas.values(), []), with_smooth("z", "bars", **{f"ema_{p}": f"e{p}" for p in emas})], {f"ema_{p}": f"ema_{p}" for p in emas}, "z")
    out["ind04_true_range"] = select(H, {"tr": TR})
    tr = stage("t", "bars", tr=TR)
    reg = {"m": "regr_slope(close, i)", "b": "regr_intercept(close, i)", "yy": "regr_syy(close, i)", "xx": "regr_sxx(close, i)"}
    channel = stage("r", "bars", **{k: f"{x} OVER {w(100)}" for k, x in reg.items()}, n=f"count(close) OVER {w(100)}")
    mid, res = "b + m * i", "sqrt(greatest(yy - m * m * xx, 0) / 100)"
    known = lambda x: f"CASE WHEN n >= 100 THEN {x} END"
    out["ind05_linear_regression"] = select([HOURLY, channel], {"linreg_mid": known(mid), "linreg_slope": known("m"), "linreg_upper": known(f"{mid} + 2 * {res}"), "linreg_lower": known(f"{mid} - 2 * {res}")}, "r")
    cross = [HOURLY, stage("s", "bars", f=mean("close", 20), l=mean("close", 50)), stage("d", "s", d="f - l"), stage("c", "d", p=lag("d"))]
    out["ind06_crossovers"] = select(cross, {"ma_cross": "CASE WHEN d > 0 AND p <= 0 THEN 1 WHEN d < 0 AND p >= 0 THEN -1 ELSE 0 END"}, "c", exact=("ma_cross",))
    dm = stage("dm", "t", up=f"high - {lag('high')}", dn=f"{lag('low')} - low")
    dms = stage("dms", "dm", pdm="CASE WHEN up > dn AND up > 0 THEN up WHEN up IS NOT NULL THEN 0 END", mdm="CASE WHEN dn > up AND dn > 0 THEN dn WHEN up IS NOT NULL THEN 0 END")
    adx = [HOURLY, tr, dm, dms, *smooth("ra", "dms", "tr", 14, "(1.0 / 14)"), *smooth("rp", "dms", "pdm", 14, "(1.0 / 14)"), *smooth("rm", "dms", "mdm", 14, "(1.0 / 14)"), with_smooth("z", "dms", a="ra", p="rp", m="rm"),
           stage("y", "z", pdi="100 * p / nullif(a, 0)", mdi="100 * m / nullif(a, 0)"), stage("x", "y", dx="100 * abs(pdi - mdi) / nullif(pdi + mdi, 0)"), *smooth("rx", "x", "dx", 14, "(1.0 / 14)"), with_smooth("v", "x", adx="rx")]
    out["ind07_adx"] = select(adx, {"adx": "adx", "plus_di": "pdi", "minus_di": "mdi"}, "v")
    st = [HOURLY, tr, *smooth("ra", "t", "tr", 10, "(1.0 / 10)"), with_smooth("z", "t", a="ra"), stage("q", "z", hi="(high + low) / 2 + 3 * a", lo="(high + low) / 2 - 3 * a", pc=lag("close")),
          "q0 AS (SELECT symbol, min(i) AS i FROM q WHERE a IS NOT NULL GROUP BY symbol)",
          "st AS (SELECT q.symbol, q.i, hi AS fu, lo AS fl, 1 AS dir FROM q JOIN q0 ON q.symbol = q0.symbol AND q.i = q0.i UNION ALL "
          "SELECT symbol, i, nu, nl, CASE WHEN dir = 1 THEN CASE WHEN close < nl THEN -1 ELSE 1 END ELSE CASE WHEN close > nu THEN 1 ELSE -1 END END FROM "
          "(SELECT q.symbol, q.i, q.close, s.dir, CASE WHEN hi < s.fu OR pc > s.fu THEN hi ELSE s.fu END AS nu, CASE WHEN lo > s.fl OR pc < s.fl THEN lo ELSE s.fl END AS nl FROM st s JOIN q ON q.symbol = s.symbol AND q.i = s.i + 1))",
          "sz AS (SELECT b.symbol, b.i, CASE WHEN dir = 1 THEN fl WHEN dir = -1 THEN fu END AS line, coalesce(dir, 0) AS side FROM bars b LEFT JOIN st ON st.symbol = b.symbol AND st.i = b.i)"]
    out["ind08_supertrend"] = select(st, {"supertrend": "line", "supertrend_dir": "CAST(side AS DOUBLE)"}, "sz")
    middle = lambda n: f"({highest('high', n)} + {lowest('low', n)}) / 2"
    ichi = [HOURLY, stage("a", "bars", t=f"({middle(9)})", k=f"({middle(26)})", b=f"({middle(52)})"), stage("c", "a", sa="(t + k) / 2")]
    out["ind09_ichimoku"] = select(ichi, {"ichimoku_tenkan": "t", "ichimoku_kijun": "k", "ichimoku_span_a_raw": "sa", "ichimoku_span_b_raw": "b", "ichimoku_cloud_a": lag("sa", 26), "ichimoku_cloud_b": lag("b", 26)}, "c")
    stops = [HOURLY, stage("sb", "bars", h1=lag("high"), h2=lag("high", 2), l1=lag("low"), l2=lag("low", 2), hn=f"lead(high) OVER ({PER})", ln=f"lead(low) OVER ({PER})"),
             "ps AS (SELECT symbol, i, CASE WHEN low - ln > greatest(0, hn - high) THEN -1 ELSE 1 END AS sgn, CASE WHEN low - ln > greatest(0, hn - high) THEN high ELSE low END AS stop, CASE WHEN low - ln > greatest(0, hn - high) THEN ln ELSE hn END AS ex, 0.02e0 AS pace FROM sb WHERE i = 0 AND hn IS NOT NULL UNION ALL "
             "SELECT symbol, i, CASE WHEN flips THEN -sgn ELSE sgn END, CASE WHEN NOT flips THEN st WHEN sgn < 0 THEN least(ex, l1, low) ELSE greatest(ex, h1, high) END, CASE WHEN flips THEN CASE WHEN sgn > 0 THEN low ELSE high END WHEN further THEN far ELSE ex END, CASE WHEN flips THEN 0.02e0 WHEN further THEN least(pace + 0.02e0, 0.2e0) ELSE pace END FROM "
             "(SELECT *, sgn * (CASE WHEN sgn > 0 THEN low ELSE high END - st) < 0 AS flips, sgn * (far - ex) > 0 AS further FROM "
             "(SELECT *, CASE WHEN sgn > 0 THEN least(moved, l1, l2) ELSE greatest(moved, h1, h2) END AS st, CASE WHEN sgn > 0 THEN high ELSE low END AS far FROM "
             "(SELECT b.*, p.sgn, p.ex, p.pace, CASE WHEN b.i > 1 THEN p.stop + p.pace * (p.ex - p.stop) ELSE p.stop END AS moved FROM ps p JOIN sb b ON b.symbol = p.symbol AND b.i = p.i + 1))))",
             "pz AS (SELECT b.symbol, b.i, CASE WHEN b.i > 0 THEN stop END AS psar FROM bars b LEFT JOIN ps ON ps.symbol = b.symbol AND ps.i = b.i)"]
    out["ind10_parabolic_sar"] = select(stops, {"psar": "psar"}, "pz")
    day = "(PARTITION BY symbol, CAST(ts AS DATE) ORDER BY i)"
    out["ind11_session_vwap"] = select(H, {"vwap": f"sum({TYPICAL} * volume) OVER {day} / nullif(sum(volume) OVER {day}, 0)"})
    change = stage("g", "bars", ch=f"close - {lag('close')}")
    gains = [HOURLY, change, *smooth("rg", "g", "greatest(ch, 0) + ch * 0", 14, "(1.0 / 14)"), *smooth("rl", "g", "greatest(-ch, 0) + ch * 0", 14, "(1.0 / 14)"), with_smooth("z", "g", g="rg", l="rl"),
             stage("y", "z", rsi="CASE WHEN l = 0 AND g = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END")]
    out["ind13_rsi"] = select(gains, {"rsi": "rsi"}, "y")
    lines = [HOURLY, *smooth("e12", "bars", "close", 12, "(2.0 / 13)"), *smooth("e26", "bars", "close", 26, "(2.0 / 27)"), with_smooth("z", "bars", f="e12", s="e26"), stage("y", "z", m="f - s"), *smooth("e9", "y", "m", 9, "0.2"), with_smooth("v", "y", sig="e9")]
    out["ind14_macd"] = select(lines, {"macd": "m", "macd_signal": "sig", "macd_hist": "m - sig"}, "v")
    stoch = lambda x, low, high: f"100 * ({x} - {lowest(low, 14)}) / nullif({highest(high, 14)} - {lowest(low, 14)}, 0)"
    out["ind15_stochastic"] = select([HOURLY, stage("a", "bars", f=stoch("close", "low", "high")), stage("b", "a", k=mean("f", 3))], {"stoch_k": "k", "stoch_d": mean("k", 3)}, "b")
    out["ind16_stochastic_rsi"] = select([*gains, stage("a", "y", f=stoch("rsi", "rsi", "rsi")), stage("b", "a", k=mean("f", 3))], {"stochrsi_k": "k", "stochrsi_d": mean("k", 3)}, "b")
    out["ind17_rate_of_change"] = select(H, {"roc": f"100 * (close / nullif({lag('close', 10)}, 0) - 1)"})
    out["ind18_momentum"] = select(H, {"momentum": f"close - {lag('close', 10)}"})
    cci = [HOURLY, stage("a", "bars", t=TYPICAL), stage("b", "a", m=mean("t", 20)), "c AS (SELECT x.symbol, x.i, any_value(x.t) AS t, any_value(x.m) AS m, avg(abs(y.t - x.m)) AS d FROM b x JOIN b y ON y.symbol = x.symbol AND y.i BETWEEN x.i - 19 AND x.i GROUP BY x.symbol, x.i)"]
    out["ind19_commodity_channel"] = select(cci, {"cci": "(t - m) / nullif(0.015 * d, 0)"}, "c")
    out["ind20_williams_r"] = select(H, {"williams_r": f"-100 * ({highest('high', 14)} - close) / nullif({highest('high', 14)} - {lowest('low', 14)}, 0)"})
    out["ind21_atr"] = select([HOURLY, tr, *smooth("ra", "t", "tr", 14, "(1.0 / 14)"), with_smooth("z", "t", atr="ra")], {"atr": "atr"}, "z")
    scaled = [HOURLY, stage("t", "bars", tr=f"coalesce({TR}, high - low)"), *smooth("ra", "t", "tr", 14, "(1.0 / 14)"), with_smooth("z", "t", atr="ra")]
    out["ind22_scale"] = select(scaled, {"scale": f"greatest(coalesce(atr, avg(tr) OVER ({PER})), 1e-9)"}, "z")
    boll = [HOURLY, stage("a", "bars", m=mean("close", 20), s=full(f"stddev_pop(close) OVER {w(20)}", "close", 20)), stage("b", "a", up="m + 2 * s", lo="m - 2 * s"), stage("c", "b", wd="(up - lo) / nullif(m, 0)")]
    out["ind23_bollinger"] = select(boll, {"bb_mid": "m", "bb_upper": "up", "bb_lower": "lo", "bb_width": "wd", "bb_pct_b": "(close - lo) / nullif(up - lo, 0)"}, "c")
    out["ind24_bollinger_squeeze"] = select([*boll, stage("d", "c", q=f"quantile_cont(wd, 0.1) OVER {w(120)}", n=f"count(wd) OVER {w(120)}")], {"bb_squeeze": "coalesce(n >= 60 AND wd <= q, false)"}, "d", exact=("bb_squeeze",))
    out["ind25_keltner"] = select([HOURLY, tr, *smooth("ra", "t", "tr", 10, "(1.0 / 10)"), *smooth("e20", "t", "close", 20, "(2.0 / 21)"), with_smooth("z", "t", a="ra", m="e20")], {"kc_mid": "m", "kc_upper": "m + 2 * a", "kc_lower": "m - 2 * a"}, "z")
    out["ind26_donchian"] = select(H, {"dc_upper": highest("high", 20), "dc_lower": lowest("low", 20), "dc_mid": f"({highest('high', 20)} + {lowest('low', 20)}) / 2"})
    returns = stage("a", "bars", r=f"CASE WHEN close / nullif({lag('close')}, 0) > 0 THEN ln(close / {lag('close')}) END")
    out["ind27_historical_volatility"] = select([HOURLY, returns], {"hv": full(f"stddev_samp(r) OVER {w(20)}", "r", 20) + " * sqrt(245)"}, "a")
    out["ind28_has_volume"] = f"WITH {HOURLY} SELECT symbol, coalesce(sum(volume), 0) > 0 AS has_volume FROM bars GROUP BY symbol"
    out["ind29_volume_averages"] = select(H, {"vol_sma": mean("volume", 20), "rel_volume": f"volume / nullif({mean('volume', 20, 1)}, 0)"})
    obv = [HOURLY, stage("a", "bars", v=f"coalesce(sign(close - {lag('close')}) * volume, 0)"), stage("o", "a", obv=f"sum(v) OVER ({PER}) + first_value(volume) OVER ({PER})")]
    out["ind31_on_balance_volume"] = select(obv, {"obv": "obv"}, "o")
    out["ind32_accumulation"] = select([HOURLY, stage("a", "bars", f=FLOW)], {"ad": f"sum(f * volume) OVER ({PER})"}, "a")
    out["ind33_money_flow"] = select([HOURLY, stage("a", "bars", f=f"{FLOW} * volume")], {"cmf": f"({total('f', 20)}) / nullif({total('volume', 20)}, 0)"}, "a")
    mfi = [HOURLY, stage("a", "bars", t=TYPICAL), stage("b", "a", ch=f"t - {lag('t')}"), stage("c", "b", u="CASE WHEN ch > 0 THEN t * volume WHEN ch IS NOT NULL THEN 0 END", d="CASE WHEN ch < 0 THEN t * volume WHEN ch IS NOT NULL THEN 0 END"), stage("e", "c", us=total("u", 14), ds=total("d", 14))]
    out["ind34_money_flow_index"] = select(mfi, {"mfi": "100 * us / nullif(us + ds, 0)"}, "e")
    out["ind35_volume_dry_up"] = select(H, {"vol_dry_up": f"coalesce({mean('volume', 5)} < 0.6 * {mean('volume', 50)}, false)"}, exact=("vol_dry_up",))
    div = [*obv, stage("p", "o", dp=f"close - {lag('close', 20)}", dv=f"obv - {lag('obv', 20)}")]
    out["ind36_volume_price_divergence"] = select(div, {"vol_price_div": "CASE WHEN dp < 0 AND dv > 0 THEN 1 WHEN dp > 0 AND dv < 0 THEN -1 ELSE 0 END"}, "p", exact=("vol_price_div",))
    return out


SCALED = [HOURLY, stage("sc_t", "bars", tr=f"coalesce({TR}, high - low)"), *smooth("sc_a", "sc_t", "tr", 14, "(1.0 / 14)"), with_smooth("sc_z", "sc_t", a14="sc_a"), stage("sc", "sc_z", a=f"greatest(coalesce(a14, avg(tr) OVER ({PER})), 1e-9)")]
ZIGZAG = [
    *SCALED,
    """z AS (
  SELECT symbol, 0 AS i, '' AS seek, 0 AS hi, high AS hp, 0 AS li, low AS lp, CAST(NULL AS BIGINT) AS ei, CAST(NULL AS DOUBLE) AS ep, CAST(NULL AS VARCHAR) AS ek FROM sc WHERE i = 0
  UNION ALL
  SELECT symbol, i, CASE WHEN fire AND seek = '' THEN CASE WHEN nhi > nli THEN 'H' ELSE 'L' END WHEN fire AND seek = 'H' THEN 'L' WHEN fire THEN 'H' ELSE seek END,
         CASE WHEN fire AND seek = 'L' THEN i ELSE nhi END, CASE WHEN fire AND seek = 'L' THEN high ELSE nhp END,
         CASE WHEN fire AND seek = 'H' THEN i ELSE nli END, CASE WHEN fire AND seek = 'H' THEN low ELSE nlp END,
         CASE WHEN fire THEN CASE WHEN seek = 'H' OR seek = '' AND nli > nhi THEN nhi ELSE nli END END,
         CASE WHEN fire THEN CASE WHEN seek = 'H' OR seek = '' AND nli > nhi THEN nhp ELSE nlp END END,
         CASE WHEN fire THEN CASE WHEN seek = 'H' OR seek = '' AND nli > nhi THEN 'H' ELSE 'L' END END
  FROM (SELECT *, CASE seek WHEN '' THEN nhp - nlp >= 2 * a AND nhi <> nli AND (nhi = i OR nli = i)
                            WHEN 'H' THEN NOT high >= hp AND hp - low >= 2 * a ELSE NOT low <= lp AND high - lp >= 2 * a END AS fire
        FROM (SELECT b.symbol, b.i, b.high, b.low, b.a, s.seek, s.hp, s.lp,
                     CASE WHEN s.seek = '' AND b.high > s.hp OR s.seek = 'H' AND b.high >= s.hp THEN b.i ELSE s.hi END AS nhi,
                     CASE WHEN s.seek = '' AND b.high > s.hp OR s.seek = 'H' AND b.high >= s.hp THEN b.high ELSE s.hp END AS nhp,
                     CASE WHEN s.seek = '' AND b.low < s.lp OR s.seek = 'L' AND b.low <= s.lp THEN b.i ELSE s.li END AS nli,
                     CASE WHEN s.seek = '' AND b.low < s.lp OR s.seek = 'L' AND b.low <= s.lp THEN b.low ELSE s.lp END AS nlp
              FROM z s JOIN sc b ON b.symbol = s.symbol AND b.i = s.i + 1)))""",
    """zig AS (
  SELECT symbol, ei AS idx, ep AS price, ek AS kind, i AS confirmed_idx, false AS provisional FROM z WHERE ek IS NOT NULL
  UNION ALL
  SELECT symbol, CASE seek WHEN 'H' THEN hi ELSE li END, CASE seek WHEN 'H' THEN hp ELSE lp END, seek, i, true FROM z WHERE seek <> '' AND (symbol, i) IN (SELECT symbol, max(i) FROM bars GROUP BY symbol))""",
    "zigzag AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY provisional, confirmed_idx) - 1 AS k FROM zig)",
]
AROUND, EARLIER = f"({PER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)", f"({PER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
FRACTALS = [
    HOURLY,
    stage("fw", "bars", n=f"count(*) OVER {AROUND}", hh=f"max(high) OVER {AROUND}", ll=f"min(low) OVER {AROUND}", eh=f"max(high) OVER {EARLIER}", el=f"min(low) OVER {EARLIER}"),
    "fr AS (SELECT symbol, i AS idx, 'H' AS kind, high AS price FROM fw WHERE n = 7 AND high = hh AND high > eh UNION ALL SELECT symbol, i, 'L', low FROM fw WHERE n = 7 AND low = ll AND low < el)",
    "fl AS (SELECT *, lag(kind) OVER (PARTITION BY symbol ORDER BY idx, kind) AS pk FROM fr)",
    "fg AS (SELECT *, sum(CASE WHEN kind = pk THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY idx, kind) AS run FROM fl)",
    "fo AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY CASE WHEN kind = 'H' THEN -price ELSE price END, idx) AS place FROM fg)",
    "swings AS (SELECT symbol, idx, price, kind, idx + 3 AS confirmed_idx FROM fo WHERE place = 1)",
    "sp AS (SELECT *, lag(price) OVER (PARTITION BY symbol, kind ORDER BY idx) AS pp FROM swings)",
    "labels AS (SELECT *, CASE WHEN pp IS NOT NULL THEN CASE WHEN price > pp THEN 'H' ELSE 'L' END || kind END AS label FROM sp)",
]


#: Peaks of closes and of their negatives: the middle of a flat top; of two that are under three bars apart (so two bars) the
#: higher stays, the later if equal. Down a slope of such peaks every other one stays, so a count of steps to the top decides.
PEAKS = [
    *SCALED, "pa AS (SELECT symbol, i, z.sgn, z.sgn * close AS y FROM bars, (VALUES (1), (-1)) z(sgn))", "pb AS (SELECT *, coalesce(y <> lag(y) OVER (PARTITION BY symbol, sgn ORDER BY i), true) AS new FROM pa)",
    "pc AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, sgn ORDER BY i) AS flat FROM pb)", "pd AS (SELECT symbol, sgn, flat, any_value(y) AS y, (min(i) + max(i)) // 2 AS p FROM pc GROUP BY symbol, sgn, flat)",
    "pe AS (SELECT * FROM pd WINDOW q AS (PARTITION BY symbol, sgn ORDER BY flat) QUALIFY y > lag(y) OVER q AND y > lead(y) OVER q)",
    "pf AS (SELECT *, row_number() OVER q AS k, coalesce(p - lag(p) OVER q < 3 AND lag(y) OVER q > y, false) AS lower_than_left, coalesce(lead(p) OVER q - p < 3 AND lead(y) OVER q >= y, false) AS lower_than_right FROM pe WINDOW q AS (PARTITION BY symbol, sgn ORDER BY p))",
    "pg AS (SELECT *, k - max(CASE WHEN NOT lower_than_left THEN k END) OVER (q) AS from_left, min(CASE WHEN NOT lower_than_right THEN k END) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - k AS from_right FROM pf WINDOW q AS (PARTITION BY symbol, sgn ORDER BY k))",
    "ph AS (SELECT * FROM pg WHERE from_left % 2 = 0 AND from_right % 2 = 0)",
    "pi AS (SELECT ph.symbol, ph.sgn, ph.p, any_value(ph.y) AS y, max(a.i) FILTER (a.i < p AND a.y > ph.y) AS l, min(a.i) FILTER (a.i > p AND a.y > ph.y) AS r FROM ph JOIN pa a ON a.symbol = ph.symbol AND a.sgn = ph.sgn GROUP BY ph.symbol, ph.sgn, ph.p)",
    "pj AS (SELECT pi.symbol, pi.sgn, p, any_value(pi.y) AS y, min(a.y) FILTER (a.i <= p) AS vl, min(a.y) FILTER (a.i >= p) AS vr FROM pi JOIN pa a ON a.symbol = pi.symbol AND a.sgn = pi.sgn AND a.i > coalesce(l, -1) AND (r IS NULL OR a.i < r) GROUP BY pi.symbol, pi.sgn, p)",
    "pk AS (SELECT pj.* FROM pj JOIN (SELECT symbol, greatest(2 * median(a), 1e-9) AS least FROM sc GROUP BY symbol) m USING (symbol) WHERE y - greatest(vl, vr) >= least)",
    "pl AS (SELECT *, coalesce(sgn <> lag(sgn) OVER (PARTITION BY symbol ORDER BY p), true) AS turns FROM pk)", "pm AS (SELECT *, sum(CASE WHEN turns THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY p) AS leg FROM pl)",
    "pn AS (SELECT *, row_number() OVER (PARTITION BY symbol, leg ORDER BY y DESC, p) AS place FROM pm)",
]


def swings() -> dict[str, str]:
    trend = "recent AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC, kind DESC) AS place FROM labels)"
    counted = "counted AS (SELECT symbol, count(label) AS n, count(*) FILTER (label IN ('HH', 'HL')) AS up, count(*) FILTER (label IN ('LH', 'LL')) AS down FROM recent WHERE place <= 4 GROUP BY symbol)"
    return {
        "swg03_peaks": f"WITH RECURSIVE {', '.join(PEAKS)} SELECT symbol, p AS idx, round(sgn * y, 6) AS price, CASE WHEN sgn > 0 THEN 'H' ELSE 'L' END AS kind FROM pn WHERE place = 1",
        "swg01_zigzag": f"WITH RECURSIVE {', '.join(ZIGZAG)} SELECT symbol, k, idx, round(price, 6) AS price, kind, confirmed_idx, provisional FROM zigzag",
        "swg02_fractals": f"WITH {', '.join(FRACTALS)} SELECT symbol, idx, round(price, 6) AS price, kind, confirmed_idx FROM swings",
        "swg07_labels": f"WITH {', '.join(FRACTALS)} SELECT symbol, idx, kind, label FROM labels",
        "swg08_trend": f"WITH {', '.join([*FRACTALS, trend, counted])} SELECT symbol, CASE WHEN n < 3 THEN 'undetermined' WHEN up >= 3 AND (down = 0 OR n = 4) THEN 'uptrend' WHEN down >= 3 AND (up = 0 OR n = 4) THEN 'downtrend' ELSE 'range' END AS trend FROM counted",
    }


#: zones(symbol, place, low, ...) from ZIGZAG.
ZONES = [
    "z0 AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, (high - min(low) OVER ah) / a AS fall, (max(high) OVER ah - low) / a AS rise, CASE WHEN count(volume) OVER pv >= 5 THEN volume / nullif(avg(volume) OVER pv, 0) END AS rel FROM sc WINDOW ah AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), pv AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))",
    "z1 AS (SELECT * FROM z0 WHERE n >= 20)",
    "z2 AS (SELECT symbol, any_value(n) AS n, arg_max(close, i) AS price, arg_max(a, i) AS sc_now, max(high) AS top, min(low) AS bottom, arg_max(close, i) FILTER (i <= greatest(0, n - 6)) AS earlier, sum(volume) > 0 AS hv FROM z1 GROUP BY symbol)",
    "z3 AS (SELECT symbol, 'swing_' || kind AS source, price AS level, idx FROM zigzag WHERE NOT provisional UNION ALL SELECT symbol, 'historical_high', top, (SELECT min(y.i) FROM z1 y WHERE y.symbol = z2.symbol AND y.high = top) FROM z2 UNION ALL SELECT symbol, 'historical_low', bottom, (SELECT min(y.i) FROM z1 y WHERE y.symbol = z2.symbol AND y.low = bottom) FROM z2)",
    "z4 AS (SELECT z3.*, sc_now, row_number() OVER (PARTITION BY symbol ORDER BY level, idx, source) AS r FROM z3 JOIN z2 USING (symbol))",
    "z5 AS (SELECT symbol, r, 1 AS zone, level AS s, 1 AS m FROM z4 WHERE r = 1 UNION ALL SELECT y.symbol, y.r, CASE WHEN y.level - x.s / x.m <= 0.8 * y.sc_now THEN x.zone ELSE x.zone + 1 END, CASE WHEN y.level - x.s / x.m <= 0.8 * y.sc_now THEN x.s + y.level ELSE y.level END, CASE WHEN y.level - x.s / x.m <= 0.8 * y.sc_now THEN x.m + 1 ELSE 1 END FROM z5 x JOIN z4 y ON y.symbol = x.symbol AND y.r = x.r + 1)",
    "z6 AS (SELECT z4.symbol, z5.zone, min(level) AS lo, max(level) AS hi, count(DISTINCT idx) AS pivots, min(idx) AS first_idx, max(idx) AS pivot_idx, avg(CASE WHEN source IN ('swing_H', 'historical_high') THEN fall ELSE rise END) AS reaction, avg(rel) AS rel, bool_or(source IN ('swing_H', 'historical_high')) AND bool_or(source NOT IN ('swing_H', 'historical_high')) AS both_sides, bool_or(source LIKE 'historical%') AS extreme, "
    "string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM z4 JOIN z5 USING (symbol, r) JOIN z1 ON z1.symbol = z4.symbol AND z1.i = z4.idx GROUP BY ALL)",
    "z7 AS (SELECT z6.*, z2.* EXCLUDE (symbol), lo - 0.15 * sc_now AS zlow, hi + 0.15 * sc_now AS zhigh, (lo - 0.15 * sc_now + (hi + 0.15 * sc_now)) / 2 AS mid FROM z6 JOIN z2 USING (symbol))",
    "z8 AS (SELECT z7.symbol, z7.zone, z1.i, z1.low <= zhigh AND z1.high >= zlow AS inside, nullif(sign(close - mid), 0) AS side FROM z7 JOIN z1 USING (symbol))",
    "z9 AS (SELECT *, inside AND NOT coalesce(lag(inside) OVER o, false) AS begins, last_value(side IGNORE NULLS) OVER (PARTITION BY symbol, zone ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM z8 WINDOW o AS (PARTITION BY symbol, zone ORDER BY i))",
    "za AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY symbol, zone ORDER BY i) AS stay FROM z9)",
    "zb AS (SELECT symbol, zone, stay, min(i) FILTER (inside) AS f, max(i) FILTER (inside) AS t, count(*) FILTER (side <> was) AS crossings FROM za GROUP BY ALL)",
    "zc AS (SELECT symbol, zone, count(*) FILTER (t - f < 15) AS episodes, max(t) AS stay_idx, sum(crossings) AS crossings FROM zb GROUP BY ALL)",
    "zd AS (SELECT z7.*, zc.* EXCLUDE (symbol, zone), greatest(pivots, episodes) AS touches, greatest(pivot_idx, coalesce(stay_idx, pivot_idx)) AS last_idx FROM z7 JOIN zc USING (symbol, zone) WHERE greatest(pivots, episodes) >= 2 OR extreme)",
    "ze AS (SELECT *, CASE WHEN hv AND rel IS NOT NULL THEN greatest(0.0, least(1.0, rel / 2)) END AS vp FROM zd)",
    "zf AS (SELECT *, round(100 * (3 * least(1.0, touches / 5) + 2 * pow(0.5, (n - 1 - last_idx) / 120) + 2 * least(1.0, coalesce(reaction, 0) / 4) + CASE WHEN both_sides THEN 1.0 ELSE 0.3 END + CASE WHEN crossings > 0 THEN least(1.0, crossings / 4) ELSE 0.2 END + coalesce(vp, 0)) / (9 + CASE WHEN vp IS NULL THEN 0 ELSE 1 END), 1) AS strength, CASE WHEN CASE WHEN price BETWEEN zlow AND zhigh THEN earlier > mid ELSE mid < price END THEN 'support' ELSE 'resistance' END AS kind FROM ze)",
    "zg AS (SELECT * FROM zf QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY strength DESC, zone) <= 12)",
    "zones AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY mid) AS place, zlow AS low, zhigh AS high, mid, kind, touches, first_idx, last_idx, strength, both_sides AS role_reversals, CAST(crossings AS BIGINT) AS crossings, sources, round((mid - price) / sc_now, 2) AS distance, row_number() OVER (PARTITION BY symbol, kind ORDER BY CASE kind WHEN 'support' THEN -mid ELSE mid END) = 1 AS immediate, row_number() OVER (PARTITION BY symbol, kind ORDER BY strength DESC, mid) = 1 AS major FROM zg)",
]


def candles() -> dict[str, str]:
    x, p, a, _, f = range(5)
    o, h, l, c = (lambda k, s=s: f"{s}{k}" for s in "ohlc")  # noqa: E741
    r, body = (lambda k: f"(h{k} - l{k})"), (lambda k: f"abs(c{k} - o{k})")
    top, bottom = (lambda k: f"greatest(o{k}, c{k})"), (lambda k: f"least(o{k}, c{k})")
    up, dn = (lambda k: f"(h{k} - greatest(o{k}, c{k}))"), (lambda k: f"(least(o{k}, c{k}) - l{k})")
    bull, bear = (lambda k: f"c{k} > o{k}"), (lambda k: f"c{k} < o{k}")
    doji = lambda k: f"({r(k)} > 0 AND {body(k)} <= 0.1 * {r(k)})"
    long = lambda k: f"({body(k)} >= ab AND {r(k)} > 0 AND {body(k)} >= 0.5 * {r(k)})"
    maru = lambda k: f"({body(k)} >= 0.9 * {r(k)} AND {body(k)} >= ab)"
    small = lambda k: f"{body(k)} <= 0.5 * ab"
    tol = "(0.05 * ab + 0.002 * c0)"
    d1, d2 = f"({up(x)} <= 0.1 * {r(x)} AND {dn(x)} >= 0.6 * {r(x)})", f"({dn(x)} <= 0.1 * {r(x)} AND {up(x)} >= 0.6 * {r(x)})"
    d3 = f"({up(x)} >= 0.3 * {r(x)} AND {dn(x)} >= 0.3 * {r(x)} AND {r(x)} >= 1.5 * ab)"
    hammer, inverted = f"NOT {doji(x)} AND {dn(x)} >= 2 * {body(x)} AND {up(x)} <= 0.1 * {r(x)}", f"NOT {doji(x)} AND {up(x)} >= 2 * {body(x)} AND {dn(x)} <= 0.1 * {r(x)}"
    held = " AND ".join(f"{small(k)} AND h{k} <= h4 AND l{k} >= l4" for k in (1, 2, 3))
    star = {"bull": f"{long(a)} AND {bear(a)} AND {small(p)} AND {top(p)} <= c2 + 0.1 * ab AND {bull(x)} AND c0 > (o2 + c2) / 2", "bear": f"{long(a)} AND {bull(a)} AND {small(p)} AND {bottom(p)} >= c2 - 0.1 * ab AND {bear(x)} AND c0 < (o2 + c2) / 2"}
    forms = [
        ("doji", 1, "neutral", "indecision", 0, f"{doji(x)} AND NOT {d1} AND NOT {d2} AND NOT {d3}"),
        ("dragonfly_doji", 1, "bullish", "reversal", -1, f"{doji(x)} AND {d1}"),
        ("gravestone_doji", 1, "bearish", "reversal", 1, f"{doji(x)} AND NOT {d1} AND {d2}"),
        ("long_legged_doji", 1, "neutral", "indecision", 0, f"{doji(x)} AND NOT {d1} AND NOT {d2} AND {d3}"),
        ("hammer", 1, "bullish", "reversal", -1, f"{hammer} AND t <= 0"),
        ("hanging_man", 1, "bearish", "reversal", 1, f"{hammer} AND t >= 0"),
        ("inverted_hammer", 1, "bullish", "reversal", -1, f"{inverted} AND t <= 0"),
        ("shooting_star", 1, "bearish", "reversal", 1, f"{inverted} AND t >= 0"),
        ("spinning_top", 1, "neutral", "indecision", 0, f"NOT {doji(x)} AND {body(x)} <= 0.3 * {r(x)} AND {up(x)} >= {body(x)} AND {dn(x)} >= {body(x)}"),
        ("bullish_marubozu", 1, "bullish", "continuation", 0, f"NOT {doji(x)} AND {body(x)} >= 0.9 * {r(x)} AND {body(x)} >= 1.2 * ab AND {bull(x)}"),
        ("bearish_marubozu", 1, "bearish", "continuation", 0, f"NOT {doji(x)} AND {body(x)} >= 0.9 * {r(x)} AND {body(x)} >= 1.2 * ab AND NOT {bull(x)}"),
        ("bullish_engulfing", 2, "bullish", "reversal", -1, f"{bear(p)} AND {bull(x)} AND o0 <= c1 AND c0 >= o1 AND {body(x)} > {body(p)}"),
        ("bearish_engulfing", 2, "bearish", "reversal", 1, f"{bull(p)} AND {bear(x)} AND o0 >= c1 AND c0 <= o1 AND {body(x)} > {body(p)}"),
        ("bullish_harami", 2, "bullish", "reversal", -1, f"{long(p)} AND {bear(p)} AND {top(x)} <= o1 AND {bottom(x)} >= c1 AND {body(x)} < 0.6 * {body(p)}"),
        ("bearish_harami", 2, "bearish", "reversal", 1, f"{long(p)} AND {bull(p)} AND {top(x)} <= c1 AND {bottom(x)} >= o1 AND {body(x)} < 0.6 * {body(p)}"),
        ("piercing", 2, "bullish", "reversal", -1, f"{long(p)} AND {bear(p)} AND {bull(x)} AND o0 < c1 AND c0 > (o1 + c1) / 2 AND c0 < o1"),
        ("dark_cloud_cover", 2, "bearish", "reversal", 1, f"{long(p)} AND {bull(p)} AND {bear(x)} AND o0 > c1 AND c0 < (o1 + c1) / 2 AND c0 > o1"),
        ("tweezer_bottom", 2, "bullish", "reversal", -1, f"abs(l0 - l1) <= {tol} AND {bear(p)} AND {bull(x)}"),
        ("tweezer_top", 2, "bearish", "reversal", 1, f"abs(h0 - h1) <= {tol} AND {bull(p)} AND {bear(x)}"),
        ("matching_low", 2, "bullish", "reversal", -1, f"{bear(p)} AND {bear(x)} AND abs(c0 - c1) <= {tol} AND {long(p)}"),
        ("bullish_kicking", 2, "bullish", "reversal", 0, f"{maru(p)} AND {maru(x)} AND {bear(p)} AND {bull(x)} AND o0 > o1"),
        ("bearish_kicking", 2, "bearish", "reversal", 0, f"{maru(p)} AND {maru(x)} AND {bull(p)} AND {bear(x)} AND o0 < o1"),
        ("morning_star", 3, "bullish", "reversal", -1, f"{star['bull']} AND NOT {doji(p)}"),
        ("evening_star", 3, "bearish", "reversal", 1, f"{star['bear']} AND NOT {doji(p)}"),
        ("morning_doji_star", 3, "bullish", "reversal", -1, f"{star['bull']} AND {doji(p)}"),
        ("evening_doji_star", 3, "bearish", "reversal", 1, f"{star['bear']} AND {doji(p)}"),
        ("three_white_soldiers", 3, "bullish", "reversal", -1, " AND ".join(f"{bull(k)} AND {body(k)} >= 0.8 * ab AND {up(k)} <= 0.35 * {body(k)}" for k in (2, 1, 0)) + " AND c2 < c1 AND c1 < c0 AND o2 < o1 AND o1 <= c2 AND o1 < o0 AND o0 <= c1"),
        ("three_black_crows", 3, "bearish", "reversal", 1, " AND ".join(f"{bear(k)} AND {body(k)} >= 0.8 * ab AND {dn(k)} <= 0.35 * {body(k)}" for k in (2, 1, 0)) + " AND c2 > c1 AND c1 > c0 AND o2 > o1 AND o1 >= c2 AND o1 > o0 AND o0 >= c1"),
        ("three_inside_up", 3, "bullish", "reversal", -1, f"{long(a)} AND {bear(a)} AND {top(p)} <= o2 AND {bottom(p)} >= c2 AND {body(p)} < 0.6 * {body(a)} AND {bull(p)} AND c0 > o2"),
        ("three_inside_down", 3, "bearish", "reversal", 1, f"{long(a)} AND {bull(a)} AND {top(p)} <= c2 AND {bottom(p)} >= o2 AND {body(p)} < 0.6 * {body(a)} AND {bear(p)} AND c0 < o2"),
        ("three_outside_up", 3, "bullish", "reversal", -1, f"{bear(a)} AND {bull(p)} AND o1 <= c2 AND c1 >= o2 AND {body(p)} > {body(a)} AND c0 > c1"),
        ("three_outside_down", 3, "bearish", "reversal", 1, f"{bull(a)} AND {bear(p)} AND o1 >= c2 AND c1 <= o2 AND {body(p)} > {body(a)} AND c0 < c1"),
        ("rising_three_methods", 5, "bullish", "continuation", 1, f"{long(f)} AND {bull(f)} AND {long(x)} AND {bull(x)} AND c0 > c4 AND {held} AND c1 < c3 + 0.5 * ab"),
        ("falling_three_methods", 5, "bearish", "continuation", -1, f"{long(f)} AND {bear(f)} AND {long(x)} AND {bear(x)} AND c0 < c4 AND {held} AND c1 > c3 - 0.5 * ab"),
    ]
    lags = {f"{s[0]}{k}": lag(s, k) if k else s for s in ("open", "high", "low", "close") for k in range(5)}
    prep = [
        *ZIGZAG, *ZONES, stage("cb", "sc", **lags, bd="abs(close - open)"),
        stage("cc", "cb", am=f"CASE WHEN count(bd) OVER {w(10, 1)} >= 3 THEN avg(bd) OVER {w(10, 1)} END", an=f"avg(bd) OVER {w(11)}", n="count(*) OVER (PARTITION BY symbol)", nx=f"lead(close) OVER ({PER})",
              rv=f"volume / nullif({mean('volume', 20, 1)}, 0)", **{f"m{k}": f"({lag('close', k)} - coalesce({lag('close', k + 10)}, first_value(close) OVER ({PER}))) / greatest({lag('a', k)}, 1e-9)" for k in (1, 2, 3, 5)},
              **{f"s{k}": f"max(high) OVER {w(k)} - min(low) OVER {w(k)}" for k in (1, 2, 3, 5)}, **{f"l{k}_": f"min(low) OVER {w(k)}" for k in (1, 2, 3, 5)}, **{f"h{k}_": f"max(high) OVER {w(k)}" for k in (1, 2, 3, 5)}),
        "cd AS (SELECT *, CASE WHEN am > 0 THEN am ELSE coalesce(nullif(an, 0), 1e-9) END AS ab FROM cc)",
    ]
    widest = "greatest(" + ", ".join(f"CASE WHEN {cond.replace(' AND t <= 0', '').replace(' AND t >= 0', '')} THEN {n} ELSE 0 END" for _, n, _, _, _, cond in forms) + ")"
    mv = "CASE mx WHEN 1 THEN m1 WHEN 2 THEN m2 WHEN 3 THEN m3 WHEN 5 THEN m5 END"
    more = [
        f"ce AS (SELECT *, {widest} AS mx FROM cd WHERE h0 - l0 > 0 AND i >= 10 AND n >= 15)",
        f"cf AS (SELECT *, {mv} AS mv, {mv.replace('m', 's').replace('sx', 'mx')} AS sp FROM ce WHERE mx > 0)",
        "cg AS (SELECT *, CASE WHEN mv >= 2 THEN 1 WHEN mv <= -2 THEN -1 ELSE 0 END AS t FROM cf)",
        "ch AS (" + " UNION ALL ".join(f"SELECT *, '{name}' AS pattern_id, {n} AS candles, '{d}' AS direction, '{k}' AS kind, {need} AS need FROM cg WHERE {cond}" for name, n, d, k, need, cond in forms) + ")",
        "cx AS (SELECT ch.*, (SELECT count(*) FROM zones z WHERE z.symbol = ch.symbol) AS nz, EXISTS (SELECT 1 FROM zones z WHERE z.symbol = ch.symbol AND CASE ch.direction WHEN 'bullish' THEN CASE mx WHEN 1 THEN l1_ WHEN 2 THEN l2_ WHEN 3 THEN l3_ ELSE l5_ END ELSE CASE mx WHEN 1 THEN h1_ WHEN 2 THEN h2_ WHEN 3 THEN h3_ ELSE h5_ END END BETWEEN z.low - 0.6 * a AND z.high + 0.6 * a) AS at_zone FROM ch)",
        "ci AS (SELECT *, CASE WHEN nz > 0 AND direction <> 'neutral' THEN CASE WHEN at_zone THEN 2.0 ELSE 0.6 END END AS lc, CASE WHEN direction = 'bullish' THEN nx > close WHEN direction = 'bearish' THEN nx < close END AS ok, CASE WHEN need = 0 THEN 0.6 WHEN need = t THEN least(1.0, abs(mv) / 4) ELSE 0.1 END AS tc, greatest(0.0, least(1.0, sp / (1.2 * a))) AS sz, CASE WHEN rv IS NOT NULL THEN greatest(0.0, least(1.0, rv / 1.5)) END AS vv FROM cx)",
    ]
    last = "CASE WHEN direction = 'neutral' THEN 'n/a' WHEN nx IS NULL THEN 'pending' WHEN ok THEN 'confirmed' ELSE 'not_confirmed' END"
    score = "100 * (3 * tc + sz + coalesce(vv, 0) + CASE WHEN ok THEN 2 ELSE 0 END + coalesce(lc, 0)) / (4 + CASE WHEN lc IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN vv IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN ok IS NOT NULL THEN 2 ELSE 0 END)"
    return {"lvl01_07_zones": f"WITH RECURSIVE {', '.join([LINES, *(x for x in ZIGZAG if x != HOURLY), *ZONES])} SELECT * REPLACE (round(low, 6) AS low, round(high, 6) AS high, round(mid, 6) AS mid) FROM zones", "cdl01_35_formations": f"WITH RECURSIVE {', '.join([*prep, *more])} SELECT symbol, i, pattern_id, candles, direction, kind, round(mv, 6) AS trend_scales, {last} AS confirmation, round({score}, 6) AS score FROM ci"}


PIVOTS = [
    *ZIGZAG,
    "pw AS (SELECT *, (high - min(low) OVER pa) / a AS pu, (max(high) OVER pa - low) / a AS pd, avg(volume) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS vn, "
    f"volume / nullif({mean('volume', 20, 1)}, 0) AS rv, count(*) OVER (PARTITION BY symbol) - 1 AS last FROM sc WINDOW pa AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING))",
    "px AS (SELECT *, CASE WHEN i = 0 THEN 0 WHEN pu >= pd THEN pu ELSE -pd END AS prior FROM pw)",
    "pv AS (SELECT z.symbol, z.k, z.idx, z.price, z.kind, z.provisional, x.a, x.prior, x.vn FROM zigzag z JOIN px x ON x.symbol = z.symbol AND x.i = z.idx)",
    "r3 AS (SELECT p.symbol, CASE WHEN p.kind = 'H' THEN 1.0 ELSE -1.0 END AS s, p.idx AS i1, q.idx AS i2, r.idx AS i3, p.price AS a, q.price AS t, r.price AS b, q.a AS sq, r.a AS sr, p.prior, p.vn AS v1, r.vn AS v3, r.provisional AS unsure "
    "FROM pv p JOIN pv q ON q.symbol = p.symbol AND q.k = p.k + 1 JOIN pv r ON r.symbol = p.symbol AND r.k = p.k + 2)",
]
CLOSE = "greatest(0.0, 1 - abs({0}) / ({1}))"
CLIP = "greatest(0.0, least(1.0, {0}))"


OPTIONAL = {"m": "0.0", "ma": "0", "vm": "0.0", "va": "0", "reach": "CAST(NULL AS DOUBLE)", "retarget": "false", "wait": "60", "need": "CAST(NULL AS DOUBLE)", "rule": "0", "pts": "CAST([] AS BIGINT[])", "stop": "CAST(NULL AS DOUBLE)", "pair": "CAST(NULL AS VARCHAR)", "unsure": "false", "stopm": "0.0", "apex": "CAST(NULL AS DOUBLE)"}


def _life(candidates: str) -> list[str]:
    """Stages of candidates cand(symbol, pattern_id, sgn, i1, ix, level, inval, target, parts, n, and some of OPTIONAL), thinned out in ``best``."""
    empty = "SELECT " + ", ".join(f"{x} AS {name}" for name, x in OPTIONAL.items()) + " WHERE false"
    filled = ", ".join(f"coalesce({name}, {x}) AS {name}" for name, x in OPTIONAL.items())
    line, lost = "(level + m * (x.i - ma))", "(inval + vm * (x.i - va))"
    return [
        f"cand AS (SELECT * REPLACE ({filled}) FROM ({empty} UNION ALL BY NAME {candidates}))",
        "cl AS (SELECT c.*, x.last, x.close AS lc, x.a AS la, row_number() OVER () AS id, CASE WHEN ix + wait + 2 <= x.last THEN ix + wait + 2 END AS ex FROM cand c JOIN px x ON x.symbol = c.symbol AND x.i = x.last)",
        f"cj AS (SELECT c.*, min(x.i) FILTER (sgn * ({lost} - x.close) > 0.25 * x.a AND x.i <= ix + wait + 2) AS inv, min(x.i) FILTER (sgn * (x.close - {line}) > 0.25 * x.a AND x.i <= ix + wait + 2) AS brk, max(CASE WHEN sgn > 0 THEN x.high ELSE -x.low END) AS reached FROM cl c LEFT JOIN px x ON x.symbol = c.symbol AND x.i > c.ix GROUP BY ALL)",
        "ck AS (SELECT *, level + m * (brk - ma) AS frozen, CASE WHEN inv <= coalesce(brk, 1e9) AND inv <= coalesce(ex, 1e9) THEN 'inv' WHEN ex < coalesce(brk, 1e9) THEN 'exp' WHEN brk IS NOT NULL THEN 'brk' ELSE 'open' END AS fate FROM cj)",
        "cg AS (SELECT *, CASE WHEN retarget THEN frozen + sgn * reach ELSE target END AS goal FROM ck)",
        "cm AS (SELECT c.*, max(x.rv) FILTER (x.i = brk) AS rel, min(x.i) FILTER (x.i > brk AND CASE WHEN sgn > 0 THEN x.high >= goal ELSE x.low <= goal END) AS tgt, min(x.i) FILTER (x.i > brk AND x.i <= brk + 15 AND sgn * (frozen - x.close) > 0.25 * x.a) AS fail, "
        f"max(x.i) FILTER (x.i > brk AND CASE WHEN sgn > 0 THEN x.low - {line} ELSE {line} - x.high END <= 0.6 * x.a) AS ret FROM cg c LEFT JOIN px x ON x.symbol = c.symbol AND x.i > c.ix GROUP BY ALL)",
        "cn AS (SELECT *, CASE fate WHEN 'inv' THEN 'invalidated' WHEN 'exp' THEN 'invalidated' WHEN 'brk' THEN CASE WHEN fail < coalesce(tgt, 1e9) THEN 'failed' WHEN tgt IS NULL AND last - ret <= 2 THEN 'retesting' ELSE 'confirmed' END ELSE CASE WHEN rule = 3 AND ix = last THEN 'forming' WHEN sgn * (level + m * (last - ma) - lc) <= la THEN 'approaching_confirmation' ELSE 'forming' END END AS stage FROM cm)",
        "cn2 AS (SELECT * REPLACE (CASE WHEN fate <> 'brk' AND last > apex THEN 'invalidated' ELSE stage END AS stage) FROM cn)",
        "co AS (SELECT *, CASE WHEN fate = 'brk' THEN brk END AS conf, stage IN ('confirmed', 'retesting') AND tgt IS NOT NULL AS hit, least(last, greatest(ix, CASE fate WHEN 'inv' THEN inv WHEN 'exp' THEN ex WHEN 'brk' THEN CASE WHEN stage = 'failed' THEN fail ELSE brk END ELSE ix END)) AS fin, CASE WHEN fate = 'brk' THEN rel >= 1.5 END AS sure, "
        "CASE WHEN stage IN ('confirmed', 'retesting') THEN 1.0 WHEN stage = 'approaching_confirmation' THEN 0.6 WHEN stage = 'forming' THEN 0.4 ELSE 0.0 END AS bonus FROM cn2)",
        "cp AS (SELECT *, coalesce(conf, last) AS b, CASE WHEN sure THEN 1.0 WHEN NOT sure THEN 0.3 END AS vol, CASE WHEN rule = 2 THEN CASE WHEN coalesce(conf, ix + wait) - ix <= 3 THEN 1.0 ELSE 0.6 END END AS swift, CASE WHEN conf IS NOT NULL AND apex IS NOT NULL THEN CASE WHEN (conf - i1) / (apex - i1) BETWEEN 0.5 AND 0.85 THEN 1.0 ELSE 0.6 END END AS timing FROM co WHERE NOT (unsure AND conf IS NOT NULL) AND fin >= last - 250 AND NOT (rule = 2 AND conf IS NULL) AND NOT (rule = 1 AND conf IS NULL AND (stage = 'invalidated' OR coalesce(reached < sgn * need, true))))",
        "cq AS (SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY symbol, pattern_id, coalesce(pair, CAST(id AS VARCHAR) || '#') ORDER BY conf NULLS LAST, stage = 'invalidated', rule = 4 AND stage <> 'approaching_confirmation', sgn DESC) = 1)",
        "rk AS (SELECT *, pair IS NULL OR conf IS NOT NULL AS told, round(100 * (parts + coalesce(vol, 0) + coalesce(swift, 0) + coalesce(timing, 0) + bonus) / (n + 1 + CASE WHEN timing IS NULL THEN 0 ELSE 1 END + CASE WHEN vol IS NULL THEN 0 ELSE 1 END + CASE WHEN swift IS NULL THEN 0 ELSE 1 END), 1) AS quality FROM cq)",
        *_best("rk"),
    ]


def _best(source: str) -> list[str]:
    """``best``: rows of ``source(symbol, pattern_id, quality, i1, ix, fin, pts)`` that no better row of their kind overlaps or shares two points with."""
    return [
        f"rl AS (SELECT *, row_number() OVER (PARTITION BY symbol, pattern_id ORDER BY quality DESC, fin DESC, i1, ix) AS place FROM {source})",
        "nm AS (SELECT symbol, pattern_id, place, true AS stays, [struct_pack(s := CAST(i1 AS BIGINT), e := CAST(fin AS BIGINT), p := pts)] AS held FROM rl WHERE place = 1 UNION ALL "
        "SELECT symbol, pattern_id, place, NOT clash, CASE WHEN clash THEN held ELSE list_append(held, struct_pack(s := CAST(i1 AS BIGINT), e := CAST(fin AS BIGINT), p := pts)) END FROM ("
        "SELECT r.symbol, r.pattern_id, r.place, r.i1, r.fin, r.pts, n.held, len(list_filter(n.held, lambda y: (least(y.e, r.fin) - greatest(y.s, r.i1)) / CASE WHEN least(y.e - y.s, r.fin - r.i1) = 0 THEN 1.0 ELSE least(y.e - y.s, r.fin - r.i1) END > 0.6 OR len(list_intersect(y.p, r.pts)) >= 2)) > 0 AS clash "
        "FROM nm n JOIN rl r ON r.symbol = n.symbol AND r.pattern_id = n.pattern_id AND r.place = n.place + 1))",
        "best AS (SELECT rl.* FROM rl JOIN nm USING (symbol, pattern_id, place) WHERE stays)",
    ]


NOW = "coalesce(last - conf <= 40, false) OR (stage IN ('forming', 'approaching_confirmation', 'confirmed', 'retesting') AND fin >= last - 40) OR (stage IN ('failed', 'invalidated') AND fin >= last - 10)"


def _patterns(ctes: list[str], candidates: str, category: str = "'reversal'") -> str:
    shown = (
        "symbol, pattern_id, CASE WHEN NOT told THEN 'neutral' WHEN sgn > 0 THEN 'bullish' ELSE 'bearish' END AS direction, stage, i1 AS start_idx, fin AS end_idx, conf AS confirmation_idx, hit AS target_reached, CASE WHEN told THEN round(level + m * (b - ma), 6) END AS level, "
        f"CASE WHEN told THEN round(coalesce(stop + stopm * b, inval + vm * (b - va)), 6) END AS inval, CASE WHEN told THEN round(coalesce(level + m * (b - ma) + sgn * reach, target), 6) END AS target, quality, sure AS volume_confirmation, {category} AS category, {NOW} AS current"
    )
    return f"WITH RECURSIVE {', '.join([*ctes, *_life(candidates)])} SELECT {shown} FROM best"


def patterns() -> dict[str, str]:
    clip, close = CLIP.format, CLOSE.format
    double = [*PIVOTS, "d AS (SELECT *, s * least(s * a, s * b) AS near, s * greatest(s * a, s * b) AS far FROM r3)", "dd AS (SELECT *, s * near - s * t AS depth, i3 - i1 AS gap, s * prior AS pr FROM d)"]
    parts = " + ".join([close("a - b", "sr"), clip("depth / (5 * sr)"), clip("pr / 6"), "CASE WHEN gap BETWEEN 15 AND 80 THEN 1.0 ELSE 0.6 END", "CASE WHEN v3 < v1 THEN 1.0 ELSE 0.5 END"])
    doubles = f"SELECT symbol, CASE WHEN s > 0 THEN 'double_top' ELSE 'double_bottom' END AS pattern_id, -s AS sgn, i1, i3 AS ix, unsure, t AS level, far AS inval, t - (far - t) AS target, {parts} AS parts, 5 AS n, [i1, i2, i3] AS pts FROM dd WHERE abs(a - b) <= sr AND depth >= 2.5 * sr AND depth >= 0.008 * abs(t) AND gap BETWEEN 8 AND 120 AND pr >= 1.5"
    five = ("r5 AS (SELECT p.symbol, CASE WHEN p.kind = 'H' THEN 1.0 ELSE -1.0 END AS s, p.idx AS i1, q.idx AS i2, r.idx AS i3, y.idx AS i4, z.idx AS i5, p.vn AS v1, z.vn AS v5, p.price AS x1, q.price AS t1, r.price AS x2, y.price AS t2, z.price AS x3, z.a AS sc, p.prior, z.provisional AS unsure "
            "FROM pv p JOIN pv q ON q.symbol = p.symbol AND q.k = p.k + 1 JOIN pv r ON r.symbol = p.symbol AND r.k = p.k + 2 JOIN pv y ON y.symbol = p.symbol AND y.k = p.k + 3 JOIN pv z ON z.symbol = p.symbol AND z.k = p.k + 4)")
    triple = [*PIVOTS, five, "t5 AS (SELECT *, s * least(s * t1, s * t2) AS neck, greatest(x1, x2, x3) - least(x1, x2, x3) AS spread, s * greatest(s * x1, s * x2, s * x3) AS far, i5 - i1 AS span, s * prior AS pr FROM r5)", "t6 AS (SELECT *, s * ((x1 + x2 + x3) / 3 - neck) AS depth FROM t5)"]
    parts3 = " + ".join([close("spread", "1.2 * sc"), clip("depth / (5 * sc)"), clip("pr / 6"), close("t1 - t2", "2 * sc")])
    triples = f"SELECT symbol, CASE WHEN s > 0 THEN 'triple_top' ELSE 'triple_bottom' END AS pattern_id, -s AS sgn, i1, i5 AS ix, unsure, neck AS level, far AS inval, neck - (far - neck) AS target, {parts3} AS parts, 4 AS n, [i1, i2, i3, i4, i5] AS pts FROM t6 WHERE spread <= 1.2 * sc AND depth >= 2.5 * sc AND depth >= 0.008 * abs(neck) AND span BETWEEN 16 AND 240 AND pr >= 1.5"
    moves = [*PIVOTS, "m AS (SELECT *, abs(t - a) AS leg, abs(t - b) / nullif(abs(t - a), 0) AS back FROM r3)"]
    partsm = " + ".join([clip("leg / (10 * sq)"), clip("1 - abs(back - 0.5) / 0.25")])
    measured = f"SELECT symbol, CASE WHEN s < 0 THEN 'measured_move_up' ELSE 'measured_move_down' END AS pattern_id, -s AS sgn, i1, i3 AS ix, unsure, t AS level, b AS inval, b + (t - a) AS target, {partsm} AS parts, 2 AS n, [i1, i2, i3] AS pts FROM m WHERE leg >= 5 * sq AND leg >= 0.008 * a AND back BETWEEN 0.3 AND 0.7"
    return {"cht02_doubles": _patterns(double, doubles), "cht03_triples": _patterns(triple, triples), "cht12_measured_moves": _patterns(moves, measured, "'continuation'"), **_more_patterns(five)}





def _chain(n: int, source: str = "pv") -> str:
    """rN: runs of ``n`` swings of ``source`` as x1, i1 (price, bar) to xn, in, with the scale an, and what the first and last tell."""
    names = "pqrstu"[:n]
    columns = ", ".join(f"{t}.price AS x{k}, {t}.idx AS i{k}, {t}.a AS a{k}, {t}.vn AS v{k}" for k, t in enumerate(names, 1))
    joins = " ".join(f"JOIN {source} {t} ON {t}.symbol = p.symbol AND {t}.k = p.k + {k}" for k, t in enumerate(names) if k)
    return f"r{n}{source} AS (SELECT p.symbol, p.kind, p.prior, {names[-1]}.provisional AS unsure, {columns} FROM {source} p {joins})"


def _more_patterns(five: str) -> dict[str, str]:
    clip, close = CLIP.format, CLOSE.format
    daily = [LINES, *(x for x in PIVOTS if x != HOURLY and not x.startswith("r3 AS"))]
    sure = "pc AS (SELECT * FROM pv WHERE NOT provisional)"
    fading = "CASE WHEN {1} < {0} THEN 1.0 ELSE 0.5 END".format

    hs = [*daily, _chain(5), "h1 AS (SELECT *, CASE WHEN kind = 'H' THEN 1.0 ELSE -1.0 END AS s, (x4 - x2) / greatest(i4 - i2, 1) AS sl FROM r5pv)", "h2 AS (SELECT *, s * (x3 - (x2 + sl * (i3 - i2))) AS h, i3 - i1 AS d1, i5 - i3 AS d2, abs(sl * (i5 - i1)) AS drift, s * prior AS pr, least(s * (x3 - x1), s * (x3 - x5)) AS o FROM h1)"]
    parts = " + ".join([close("x1 - x5", "0.5 * h"), close("1 - least(d1, d2) / greatest(d1, d2)", "1.0"), clip("o / (3 * a5)"), close("drift", "0.6 * h"), clip("pr / 6"), fading("v1", "v5")])
    shoulders = f"""SELECT symbol, CASE WHEN s > 0 THEN 'head_and_shoulders' ELSE 'inverse_head_and_shoulders' END AS pattern_id, -s AS sgn, i1, i5 AS ix, unsure, x2 AS level, sl AS m, i2 AS ma, x3 AS inval, CAST(NULL AS DOUBLE) AS target, h AS reach, true AS retarget, x5 AS stop, {parts} AS parts, 6 AS n, [i1, i2, i3, i4, i5] AS pts FROM h2
        WHERE o >= a5 AND h > 0 AND h >= 0.03 * abs(x2 + sl * (i3 - i2)) AND abs(x1 - x5) <= 0.5 * h AND s * (x5 - (x2 + sl * (i5 - i2))) > 0 AND s * (x1 - (x2 + sl * (i1 - i2))) > 0 AND d2 > 0 AND d1 / d2 BETWEEN 1 / 2.5 AND 2.5 AND drift <= 0.6 * h AND pr >= 1.5"""

    dia = [*daily, sure, _chain(6, "pc"), "d1 AS (SELECT *, " + ", ".join(f"CASE WHEN kind = 'H' THEN {v}{2 * k + 1 + o} ELSE {v}{2 * k + 2 - o} END AS {n}{w}{k + 1}" for k in range(3) for v, w in (("x", ""), ("i", "i")) for n, o in (("h", 0), ("l", 1))) + " FROM r6pc)",
           "d2 AS (SELECT *, h2 - l2 AS width, (h3 - h2) / greatest(hi3 - hi2, 1) AS mu, (l3 - l2) / greatest(li3 - li2, 1) AS ml, prior >= 0 AS top FROM d1)"]
    partsd = " + ".join([clip("width / (10 * a6)"), clip("abs(prior) / 6"), clip("1 - least(1.0, abs((hi2 - hi1) - (hi3 - hi2)) / greatest(hi3 - hi1, 1))")])
    diamond = f"""SELECT symbol, CASE WHEN top THEN 'diamond_top' ELSE 'diamond_bottom' END AS pattern_id, CASE WHEN top THEN -1.0 ELSE 1.0 END AS sgn, i1, i6 AS ix, CASE WHEN top THEN l2 ELSE h2 END AS level, CASE WHEN top THEN ml ELSE mu END AS m, CASE WHEN top THEN li2 ELSE hi2 END AS ma, CASE WHEN top THEN h2 ELSE l2 END AS inval, CASE WHEN top THEN mu ELSE ml END AS vm, CASE WHEN top THEN hi2 ELSE li2 END AS va,
        CASE WHEN top THEN l2 + ml * (i6 - li2) - width ELSE h2 + mu * (i6 - hi2) + width END AS target, width AS reach, {partsd} AS parts, 3 AS n, [i1, i2, i3, i4, i5, i6] AS pts FROM d2
        WHERE h2 > h1 AND h2 > h3 AND l2 < l1 AND l2 < l3 AND width >= 4 * a6 AND width >= 0.03 * h2 AND least(h2 - h3, l3 - l2) >= 0.5 * a6"""

    vs = [*daily, _chain(2), "v1 AS (SELECT *, CASE WHEN kind = 'H' THEN 1.0 ELSE -1.0 END AS s, abs(x1 - x2) AS dr, i2 - i1 AS nb FROM r2pv)"]
    partsv = " + ".join([clip("dr / nb / (1.5 * a2)"), clip("dr / (12 * a2)")])
    reversal = f"SELECT symbol, CASE WHEN s > 0 THEN 'v_bottom' ELSE 'inverted_v_top' END AS pattern_id, s AS sgn, i1, i2 AS ix, x2 + 0.618 * (x1 - x2) AS level, x2 AS inval, x1 AS target, greatest(3, CAST(floor(1.5 * nb) AS BIGINT)) AS wait, x2 + 0.382 * (x1 - x2) AS need, 1 AS rule, {partsv} AS parts, 2 AS n, [i1, i2] AS pts FROM v1 WHERE nb BETWEEN 2 AND 20 AND dr >= 6 * a2 AND dr / nb >= 0.5 * a2 AND dr >= 0.03 * x1"

    tr = [*daily, "tw AS (SELECT *, max(high) OVER pa AS top, min(low) OVER pa AS bottom, lag(close) OVER o AS earlier, max(high) OVER ah AS peak, min(low) OVER ah AS trough FROM px WINDOW o AS (PARTITION BY symbol ORDER BY i), pa AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING), ah AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))",
          "tx AS (SELECT t.symbol, 'bull_trap' AS pattern_id, -1.0 AS sgn, t.i, top AS level, peak AS inval, bottom AS target, (SELECT min(y.i) FROM px y WHERE y.symbol = t.symbol AND y.i BETWEEN t.i AND t.i + 5 AND y.high = t.peak) AS pk FROM tw t WHERE t.i >= 40 AND t.i >= last - 120 AND close > top + 0.25 * a AND NOT earlier > top + 0.25 * a UNION ALL "
          "SELECT t.symbol, 'bear_trap', 1.0, t.i, bottom, trough, top, (SELECT min(y.i) FROM px y WHERE y.symbol = t.symbol AND y.i BETWEEN t.i AND t.i + 5 AND y.low = t.trough) FROM tw t WHERE t.i >= 40 AND t.i >= last - 120 AND close < bottom - 0.25 * a AND NOT earlier < bottom - 0.25 * a)"]
    trap = "SELECT symbol, pattern_id, sgn, i - 40 AS i1, i AS ix, level, inval, target, 5 AS wait, 2 AS rule, 1.0 AS parts, 1 AS n, [i, pk] AS pts FROM tx"

    cw = w(120)
    co = [*daily, f"b0 AS (SELECT *, {mean('close', 20)} AS mid, {full('stddev_pop(close) OVER ' + w(20), 'close', 20)} AS sd FROM px)", "b1 AS (SELECT *, 4 * sd / nullif(mid, 0) AS bw FROM b0)", f"b2 AS (SELECT *, count(bw) OVER {cw} >= 60 AND bw <= quantile_cont(bw, 0.15) OVER {cw} AS sq, CASE WHEN count(bw) OVER {cw} >= 60 THEN quantile_cont(bw, 0.5) OVER {cw} END AS usual FROM b1)",
          f"b3 AS (SELECT *, i - row_number() OVER ({PER}) AS run FROM b2 WHERE sq AND last + 1 >= 80)", "b4 AS (SELECT symbol, run, min(i) AS f, max(i) AS e, max(high) AS top, min(low) AS bottom, avg(bw) AS aw, arg_min(usual, i) AS usual, arg_max(a, i) AS a FROM b3 GROUP BY ALL HAVING count(*) >= 6)",
          "b5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY e DESC) AS place FROM b4) WHERE place <= 3 AND usual > 0 AND aw / usual <= 0.55)"]
    partsc = " + ".join([clip("(e - f + 1) / 15"), clip("1 - least(1.0, (top - bottom) / (6 * a))")])
    squeeze = f"SELECT symbol, 'compression_breakout' AS pattern_id, s AS sgn, f AS i1, e AS ix, CASE WHEN s > 0 THEN top ELSE bottom END AS level, CAST(NULL AS DOUBLE) AS inval, CASE WHEN s > 0 THEN top ELSE bottom END + s * (top - bottom) AS target, CASE WHEN s > 0 THEN bottom ELSE top END AS stop, 3 AS rule, f || '-' || e AS pair, {partsc} AS parts, 2 AS n, [f, e] AS pts FROM b5, (VALUES (1.0), (-1.0)) AS t(s)"
    upper, lower, tilt = "(mu * {0} + bu)".format, "(ml * {0} + bl)".format, "CASE WHEN abs({0} * (e - f) / md) <= 1.2 THEN 'flat' WHEN {0} > 0 THEN 'up' ELSE 'down' END".format
    tl = [*daily, "t0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY k DESC) - 1 AS back FROM pv WHERE NOT provisional)", "t1 AS (SELECT x.symbol, x.k AS anchor, c AS cnt, y.idx, y.price, y.kind FROM t0 x, (VALUES (5), (6), (7), (8), (9)) v(c) JOIN t0 y ON y.symbol = x.symbol AND y.k BETWEEN x.k - c + 1 AND x.k WHERE x.back < 10)",
          "t2 AS (SELECT symbol, anchor, cnt, min(idx) AS f, max(idx) AS e, list(idx ORDER BY idx) AS pts, " + ", ".join(f"regr_{fn}(price, idx) FILTER (kind = '{kind}') AS {n}{side}" for kind, side in (("H", "u"), ("L", "l")) for fn, n in (("slope", "m"), ("intercept", "b"))) + " FROM t1 GROUP BY ALL HAVING count(*) = cnt AND count(*) FILTER (kind = 'H') >= 2 AND count(*) FILTER (kind = 'L') >= 2 AND max(idx) - min(idx) BETWEEN 12 AND 220)",
          f"t3 AS (SELECT t2.*, max(abs(price - CASE kind WHEN 'H' THEN {upper('idx')} ELSE {lower('idx')} END)) AS gap FROM t2 JOIN t1 USING (symbol, anchor, cnt) GROUP BY ALL)",
          f"t4 AS (SELECT *, {upper('f')} - {lower('f')} AS w0, {upper('e')} - {lower('e')} AS w1 FROM t3 WHERE {upper('f')} - {lower('f')} > 0 AND {upper('e')} - {lower('e')} > 0)",
          "t5 AS (SELECT t4.symbol, anchor, cnt, quantile_cont(x.a, 0.5) AS md FROM t4 JOIN px x ON x.symbol = t4.symbol AND x.i BETWEEN f AND e GROUP BY ALL)",
          f"t6 AS (SELECT t4.*, md, avg(CASE WHEN x.close > {upper('x.i')} + 0.35 * md OR x.close < {lower('x.i')} - 0.35 * md THEN 1.0 ELSE 0.0 END) AS outside, max(x.prior) FILTER (x.i = f) AS pr, max(x.last) AS fin_i, avg(x.volume) FILTER (x.i < f + (e - f + 1) // 2) AS v0, avg(x.volume) FILTER (x.i >= f + (e - f + 1) // 2) AS v1 FROM t4 JOIN t5 USING (symbol, anchor, cnt) JOIN px x ON x.symbol = t4.symbol AND x.i BETWEEN f AND e GROUP BY ALL)",
          f"t7 AS (SELECT *, {tilt('mu')} AS su, {tilt('ml')} AS sl, w1 / w0 AS ratio, abs(mu * (e - f) / md) AS du, abs(ml * (e - f) / md) AS dl FROM t6 WHERE gap <= 0.9 * md AND outside <= 0.08)",
          "t8 AS (SELECT *, CASE WHEN ratio < 0.72 THEN CASE su || ' ' || sl WHEN 'flat up' THEN 'ascending_triangle' WHEN 'down flat' THEN 'descending_triangle' WHEN 'down up' THEN 'symmetrical_triangle' WHEN 'up up' THEN 'rising_wedge' WHEN 'down down' THEN 'falling_wedge' END WHEN ratio <= 1.4 THEN CASE su || ' ' || sl WHEN 'up up' THEN 'ascending_channel' WHEN 'down down' THEN 'descending_channel' WHEN 'flat flat' THEN CASE WHEN abs(pr) >= 3 THEN 'rectangle' ELSE 'horizontal_channel' END END "
          "ELSE CASE su || ' ' || sl WHEN 'up down' THEN CASE WHEN pr >= 3 THEN 'broadening_top' WHEN pr <= -3 THEN 'broadening_bottom' WHEN abs(du - dl) <= 0.5 * greatest(du, dl) THEN 'expanding_triangle' ELSE 'broadening_formation' END WHEN 'up flat' THEN 'broadening_formation' WHEN 'flat down' THEN 'broadening_formation' END END AS pattern FROM t7)",
          "t9 AS (SELECT *, CASE WHEN pattern IN ('ascending_triangle', 'descending_triangle', 'symmetrical_triangle') AND mu <> ml THEN (bl - bu) / (mu - ml) END AS apex FROM t8 WHERE pattern IS NOT NULL)",
          "ta AS (SELECT *, CASE WHEN pattern IN ('ascending_triangle', 'falling_wedge') THEN 1.0 WHEN pattern IN ('descending_triangle', 'rising_wedge') THEN -1.0 END AS fixed, pattern IN ('rising_wedge', 'falling_wedge') AS wedge, CASE WHEN pattern IN ('ascending_triangle', 'descending_triangle', 'symmetrical_triangle') THEN w0 ELSE w1 END AS measure FROM t9 WHERE apex IS NULL OR apex > e QUALIFY row_number() OVER (PARTITION BY symbol, anchor ORDER BY cnt DESC) = 1)",
          "tb AS (SELECT * FROM ta JOIN (VALUES (1.0), (-1.0)) v(s) ON fixed IS NULL OR fixed = s)"]
    partst = " + ".join([clip("0.4 + 0.15 * (cnt - 4)"), clip("1 - gap / (0.9 * md)"), clip("1 - outside / 0.08"), "CASE WHEN e - f BETWEEN 20 AND 150 THEN 1.0 ELSE 0.6 END", "CASE WHEN fixed IS NULL THEN 0.0 WHEN fixed * pr > 0 THEN 1.0 ELSE 0.5 END", "CASE WHEN v1 < v0 THEN 1.0 ELSE 0.5 END"])
    lines = (f"SELECT symbol, pattern AS pattern_id, s AS sgn, f AS i1, e AS ix, CASE WHEN s > 0 THEN bu ELSE bl END AS level, CASE WHEN s > 0 THEN mu ELSE ml END AS m, CASE WHEN fixed IS NOT NULL THEN CASE WHEN s > 0 THEN bl ELSE bu END END AS inval, CASE WHEN fixed IS NOT NULL THEN CASE WHEN s > 0 THEN ml ELSE mu END ELSE 0.0 END AS vm, "
             f"CASE WHEN wedge THEN CASE WHEN s > 0 THEN {upper('f')} ELSE {lower('f')} END WHEN s > 0 THEN {upper('fin_i')} + measure ELSE {lower('fin_i')} - measure END AS target, CASE WHEN NOT wedge THEN measure END AS reach, CASE WHEN s > 0 THEN bl ELSE bu END AS stop, CASE WHEN s > 0 THEN ml ELSE mu END AS stopm, apex, CASE WHEN fixed IS NULL THEN 4 ELSE 0 END AS rule, CASE WHEN fixed IS NULL THEN anchor || '-' || cnt END AS pair, {partst} AS parts, CASE WHEN fixed IS NULL THEN 5 ELSE 6 END AS n, pts FROM tb")
    kind = "CASE WHEN pattern_id IN ('symmetrical_triangle', 'expanding_triangle', 'broadening_formation', 'horizontal_channel') THEN 'bilateral' WHEN pattern_id IN ('broadening_top', 'broadening_bottom', 'rising_wedge', 'falling_wedge') THEN 'reversal' ELSE 'continuation' END"
    ae = [*daily, _chain(3), "e0 AS (SELECT *, CASE WHEN kind = 'H' THEN 1.0 ELSE -1.0 END AS s FROM r3pv)", "e1 AS (SELECT *, s * least(s * x1, s * x3) AS near, s * greatest(s * x1, s * x3) AS far FROM e0)", "e2 AS (SELECT *, s * near - s * x2 AS depth, i3 - i1 AS gp, s * prior AS pr FROM e1 WHERE abs(x1 - x3) <= a3)",
          "ew AS (SELECT x.symbol, x.i, s, 1 + (SELECT count(*) FROM px y WHERE y.symbol = x.symbol AND y.i BETWEEN x.i + 1 AND x.i + 30 AND y.i < coalesce((SELECT min(q.i) FROM px q WHERE q.symbol = x.symbol AND q.i BETWEEN x.i + 1 AND x.i + 30 AND CASE WHEN s > 0 THEN x.high - q.high ELSE q.low - x.low END > x.a), 1e9)) + (SELECT count(*) FROM px y WHERE y.symbol = x.symbol AND y.i BETWEEN x.i - 30 AND x.i - 1 AND y.i > coalesce((SELECT max(q.i) FROM px q WHERE q.symbol = x.symbol AND q.i BETWEEN x.i - 30 AND x.i - 1 AND CASE WHEN s > 0 THEN x.high - q.high ELSE q.low - x.low END > x.a), -1)) AS wd "
          "FROM px x JOIN (SELECT DISTINCT symbol, i, s FROM (SELECT symbol, i1 AS i, s FROM e2 UNION ALL SELECT symbol, i3, s FROM e2)) u ON u.symbol = x.symbol AND u.i = x.i)",
          "e3 AS (SELECT e2.*, p.wd AS wa, q.wd AS wb FROM e2 JOIN ew p ON p.symbol = e2.symbol AND p.i = e2.i1 AND p.s = e2.s JOIN ew q ON q.symbol = e2.symbol AND q.i = e2.i3 AND q.s = e2.s)"]
    partse = " + ".join([close("x1 - x3", "a3"), clip("depth / (5 * a3)"), clip("pr / 6"), "CASE WHEN gp BETWEEN 15 AND 80 THEN 1.0 ELSE 0.6 END", fading("v1", "v3")])
    adam = f"SELECT symbol, CASE WHEN s > 0 THEN 'adam_eve_top' ELSE 'adam_eve_bottom' END AS pattern_id, -s AS sgn, i1, i3 AS ix, unsure, x2 AS level, far AS inval, x2 - (far - x2) AS target, {partse} AS parts, 5 AS n, [i1, i2, i3] AS pts FROM e3 WHERE depth >= 2.5 * a3 AND depth >= 0.03 * abs(x2) AND gp BETWEEN 8 AND 120 AND pr >= 1.5 AND wa <= 5 AND wb >= greatest(2 * wa, 6)"
    return {"cht04_adam_and_eve": _patterns(ae, adam), "cht05_two_lines": _patterns(tl, lines, kind), "cht01_head_and_shoulders": _patterns(hs, shoulders), "cht09_diamonds": _patterns(dia, diamond), "cht10_v_reversals": _patterns(vs, reversal), "cht11_traps": _patterns(tr, trap), "cht13_compressions": _patterns(co, squeeze, "'bilateral'")}


def structure() -> dict[str, str]:
    sized = "sn AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM sc)"
    broken = [
        *ZIGZAG, sized,
        "ks AS (SELECT symbol, kind, idx, price, confirmed_idx, lead(confirmed_idx) OVER (PARTITION BY symbol, kind ORDER BY idx) AS until FROM zigzag WHERE NOT provisional)",
        "bk AS (SELECT k.symbol, k.kind, k.idx, any_value(k.price) AS level, min(b.i) AS i, any_value(b.n) AS n FROM ks k JOIN sn b ON b.symbol = k.symbol AND b.i >= k.confirmed_idx AND (k.until IS NULL OR b.i < k.until) WHERE CASE WHEN k.kind = 'H' THEN b.close > k.price ELSE b.close < k.price END GROUP BY k.symbol, k.kind, k.idx)",
        "ev AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY symbol ORDER BY i, kind) = kind, true) AS same FROM bk)",
        "events AS (SELECT symbol, CASE WHEN same THEN 'BOS' ELSE 'CHoCH' END AS type, CASE WHEN kind = 'H' THEN 'bullish' ELSE 'bearish' END AS direction, i, level, idx AS broken_idx FROM ev WHERE i >= n - 200)",
    ]
    future = "(PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    gaps = [*SCALED, sized, f"g0 AS (SELECT *, {lag('high', 2)} AS h2, {lag('low', 2)} AS l2, min(low) OVER {future} AS fl, max(high) OVER {future} AS fh FROM sn)",
            "g1 AS (SELECT symbol, i, a, fl, fh, 'bullish' AS direction, h2 AS lo, low AS hi FROM g0 WHERE i >= greatest(2, n - 200) UNION ALL SELECT symbol, i, a, fl, fh, 'bearish', high, l2 FROM g0 WHERE i >= greatest(2, n - 200))",
            "g2 AS (SELECT *, coalesce(CASE WHEN direction = 'bullish' THEN fl < hi ELSE fh > lo END, false) AS partly, row_number() OVER (PARTITION BY symbol ORDER BY i DESC, direction) AS place FROM g1 WHERE hi - lo > 0.1 * a AND NOT coalesce(CASE WHEN direction = 'bullish' THEN fl <= lo ELSE fh >= hi END, false))"]
    base = [*SCALED, sized, f"b0 AS (SELECT *, max(abs(close - open)) OVER {w(3)} AS body, min(low) OVER {w(3)} AS lo, max(high) OVER {w(3)} AS hi, lead(close, 3) OVER ({PER}) - close AS mv FROM sn)",
            "b1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i DESC) AS place FROM b0 WHERE i >= greatest(3, n - 200) AND body <= 0.6 * a AND abs(mv) >= 2.5 * a)"]
    traps = [*SCALED, sized, f"w0 AS (SELECT *, max(high) OVER {w(40, 1)} AS top, min(low) OVER {w(40, 1)} AS bottom FROM sn)", "w1 AS (SELECT * FROM w0 WHERE i >= greatest(40, n - 200) AND top - bottom <= 8 * a)",
             "w2 AS (SELECT symbol, 'spring' AS type, i, low AS lo, bottom AS hi FROM w1 WHERE low < bottom - 0.2 * a AND close > bottom UNION ALL SELECT symbol, 'upthrust', i, top, high FROM w1 WHERE high > top + 0.2 * a AND close < top)",
             "w3 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i DESC, type DESC) AS place FROM w2)"]
    blocks = [*broken, "o1 AS (SELECT e.symbol, e.direction, e.i AS bi, max(b.i) AS j FROM events e JOIN sc b ON b.symbol = e.symbol AND b.i < e.i AND b.i > greatest(0, e.broken_idx - 30) AND CASE WHEN e.direction = 'bullish' THEN b.close < b.open ELSE b.close > b.open END GROUP BY ALL)",
              f"fu AS (SELECT *, min(low) OVER {future} AS fl, max(high) OVER {future} AS fh FROM sc)",
              "o2 AS (SELECT o.*, b.low, b.high, CASE WHEN o.direction = 'bullish' THEN f.fl <= b.high ELSE f.fh >= b.low END AS hit, row_number() OVER (PARTITION BY o.symbol ORDER BY o.bi DESC, o.direction) AS place FROM o1 o JOIN sc b ON b.symbol = o.symbol AND b.i = o.j JOIN fu f ON f.symbol = o.symbol AND f.i = o.bi)"]
    say = lambda ctes, rest: f"WITH RECURSIVE {', '.join(ctes)} SELECT {rest}"
    return {
        "str01_breaks": say(broken, "symbol, type, direction, i, round(level, 6) AS level, broken_idx FROM events"),
        "str02_value_gaps": say(gaps, "symbol, direction, i - 1 AS i, round(lo, 6) AS low, round(hi, 6) AS high, CASE WHEN partly THEN 'partially_filled' ELSE 'open' END AS status FROM g2 WHERE place <= 10"),
        "str03_order_blocks": say(blocks, "symbol, direction, bi AS break_i, j AS i, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN coalesce(hit, false) THEN 'mitigated' ELSE 'open' END AS status FROM o2 WHERE place <= 6"),
        "str04_bases": say(base, "symbol, CASE WHEN mv > 0 THEN 'demand' ELSE 'supply' END AS type, i, round(lo, 6) AS low, round(hi, 6) AS high FROM b1 WHERE place <= 6"),
        "str05_range_traps": say(traps, "symbol, type, i, round(lo, 6) AS low, round(hi, 6) AS high FROM w3 WHERE place <= 6"),
    }


def resampling() -> dict[str, str]:
    last = "round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 8) AS volume"
    agg = "first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, min(ts) AS ts"
    place = "row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i"

    def of(bars: str, key: str) -> str:
        return f"WITH {bars}, r AS (SELECT symbol, {agg} FROM bars GROUP BY symbol, {key}) SELECT symbol, {place}, strftime(ts, '%Y-%m-%d %H:%M') AS at, {last} FROM r"

    quarter = "time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2000-01-01')"
    fives = ("bars AS (SELECT symbol, b AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume "
             "FROM (SELECT *, event_type AS symbol, time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '2000-01-01') AS b FROM events WHERE value IS NOT NULL) GROUP BY 1, 2)")
    return {
        "src_hourly_bars": f"WITH {HOURLY} SELECT symbol, i, strftime(ts, '%Y-%m-%d %H:%M') AS at, {last} FROM bars",
        "src_daily_bars": f"WITH {DAILY} SELECT symbol, i, strftime(ts, '%Y-%m-%d %H:%M') AS at, {last} FROM bars",
        "rsm03_five_to_fifteen_minutes": of(fives, quarter),
        "rsm03_hours_to_days": of(HOURLY, "CAST(ts AS DATE)"),
        "rsm05_days_to_weeks": of(DAILY, "CAST(ts AS DATE) + CAST((12 - isodow(ts)) % 7 AS INTEGER)"),
        "rsm06_days_to_months": of(DAILY, "date_trunc('month', ts)"),
    }


def _oscillators() -> tuple[list[str], ...]:
    """RSI, MACD line and histogram: ``rs``, ``mc`` and ``mh`` with (symbol, i, v)."""
    rsi = [stage("rg0", "bars", ch=f"close - {lag('close')}"), *smooth("rsg", "rg0", "greatest(ch, 0) + ch * 0", 14, "(1.0 / 14)"), *smooth("rsl", "rg0", "greatest(-ch, 0) + ch * 0", 14, "(1.0 / 14)"), with_smooth("rsz", "rg0", g="rsg", l="rsl"),
           "rs AS (SELECT symbol, i, CASE WHEN l = 0 AND g = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS v FROM rsz)"]
    macd = [*smooth("m12", "bars", "close", 12, "(2.0 / 13)"), *smooth("m26", "bars", "close", 26, "(2.0 / 27)"), with_smooth("mz", "bars", f="m12", s="m26"), "mc AS (SELECT symbol, i, f - s AS v FROM mz)"]
    hist = [*smooth("m9", "mc", "v", 9, "0.2"), with_smooth("mh0", "mc", sig="m9"), "mh AS (SELECT symbol, i, v - sig AS v FROM mh0)"]
    return rsi, macd, hist


def signalled() -> list[str]:
    """``sj``: each bar for each of the three specifications that the backtests' queries run, with the side of its signal."""
    rsi, macd, hist = _oscillators()
    return [
        *SCALED, *rsi, *macd, *hist,
        "sg AS (SELECT s.*, r.v AS rsi, h.v AS hist FROM sc s JOIN rs r ON r.symbol = s.symbol AND r.i = s.i JOIN mh h ON h.symbol = s.symbol AND h.i = s.i)",
        stage("sh", "sg", f=mean("close", 20), s=mean("close", 50), l=mean("close", 200)),
        stage("si", "sh", pf=lag("f"), ps=lag("s"), pr=lag("rsi"), ph=lag("hist")),
        "sj AS (SELECT *, 0 AS spec_id, CASE WHEN f > s AND pf <= ps THEN 1 WHEN f < s AND pf >= ps THEN -1 END AS side FROM si UNION ALL SELECT *, 1, CASE WHEN pr < 30 AND rsi >= 30 THEN 1 WHEN pr > 70 AND rsi <= 70 THEN -1 END FROM si UNION ALL SELECT *, 2, CASE WHEN hist > 0 AND ph <= 0 AND close > l THEN 1 WHEN hist < 0 AND ph >= 0 AND close < l THEN -1 END FROM si)",
    ]


def trading() -> dict[str, str]:
    rsi, macd, hist = _oscillators()
    obv = [stage("ob0", "bars", v=f"coalesce(sign(close - {lag('close')}) * volume, 0)"), f"ob AS (SELECT symbol, i, sum(v) OVER ({PER}) + first_value(volume) OVER ({PER}) AS v FROM ob0)"]
    mfi = [stage("mf0", "bars", t=TYPICAL), stage("mf1", "mf0", ch=f"t - {lag('t')}"), stage("mf2", "mf1", u="CASE WHEN ch > 0 THEN t * volume WHEN ch IS NOT NULL THEN 0 END", d="CASE WHEN ch < 0 THEN t * volume WHEN ch IS NOT NULL THEN 0 END"), stage("mf3", "mf2", us=total("u", 14), ds=total("d", 14)), "mf AS (SELECT symbol, i, 100 * us / nullif(us + ds, 0) AS v FROM mf3)"]
    div = [
        *ZIGZAG, *rsi, *macd, *obv, *mfi,
        "il AS (SELECT 'rsi' AS indicator, * FROM rs UNION ALL SELECT 'macd', * FROM mc UNION ALL SELECT 'obv', * FROM ob UNION ALL SELECT 'mfi', * FROM mf)",
        "id AS (SELECT *, coalesce(nullif(CASE WHEN count(v) OVER q >= 20 THEN stddev_samp(v) OVER q END, 0), stddev_pop(v) OVER (PARTITION BY indicator, symbol ORDER BY i)) AS d FROM il WINDOW q AS (PARTITION BY indicator, symbol ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))",
        "da AS (SELECT z.symbol, z.kind, z.idx, z.price, z.confirmed_idx, x.indicator, CASE WHEN any_value(z.kind) = 'L' THEN min(x.v) ELSE max(x.v) END AS v, max(x.d) FILTER (x.i = z.idx) AS d FROM zigzag z JOIN id x ON x.symbol = z.symbol AND x.i BETWEEN z.idx - 3 AND least(z.idx + 3, z.confirmed_idx) WHERE NOT z.provisional GROUP BY ALL)",
        "dl AS (SELECT da.*, s.a, lag(idx) OVER p AS idx1, lag(v) OVER p AS v1, lag(price) OVER p AS price1, (SELECT max(i) FROM bars b WHERE b.symbol = da.symbol) AS last FROM da JOIN sc s ON s.symbol = da.symbol AND s.i = da.idx WINDOW p AS (PARTITION BY da.symbol, indicator, kind ORDER BY idx))",
        "dx AS (SELECT *, (price - price1) / a AS dp, (v - v1) / nullif(d, 0) AS di FROM dl WHERE idx - idx1 BETWEEN 5 AND 80 AND confirmed_idx >= last - 120)",
    ]
    kind = "CASE WHEN kind = 'L' THEN CASE WHEN dp < 0 THEN 'regular_bullish' ELSE 'hidden_bullish' END ELSE CASE WHEN dp < 0 THEN 'hidden_bearish' ELSE 'regular_bearish' END END"
    ratios = ", ".join(f"('{k}', {r}, {j})" for j, (k, r) in enumerate([("retracement", r) for r in (0.236, 0.382, 0.5, 0.618, 0.786)] + [("extension", r) for r in (1.272, 1.618, 2.0, 2.618)]))
    fib = [
        *ZIGZAG, "fz AS (SELECT *, row_number() OVER (PARTITION BY symbol, provisional ORDER BY k DESC) AS place FROM zigzag)", "ff AS (SELECT * FROM fz WHERE provisional OR place <= 8)",
        "fn AS (SELECT *, lead(idx) OVER (PARTITION BY symbol ORDER BY k) AS ei2, lead(price) OVER (PARTITION BY symbol ORDER BY k) AS ep2 FROM ff)",
        "fb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(ep2 - price) DESC, k) AS best FROM fn WHERE ep2 IS NOT NULL)",
        f"fr2(rk, ratio, j) AS (VALUES {ratios})",
        "fv AS (SELECT symbol, rk, ratio, j, idx, ei2, CASE WHEN rk = 'retracement' THEN ep2 - ratio * (ep2 - price) ELSE price + ratio * (ep2 - price) END AS lv FROM fb, fr2 WHERE best = 1)",
        "fc AS (SELECT symbol, last(close ORDER BY i) AS lc FROM bars GROUP BY symbol)",
        "fw2 AS (SELECT v.*, row_number() OVER (PARTITION BY v.symbol ORDER BY abs(round(lv, 4) - lc), j) AS place FROM fv v JOIN fc USING (symbol))",
    ]
    raw = "raw AS (SELECT event_type AS symbol, CASE WHEN event_id % 50 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS ts, event_id AS pos, value - CASE WHEN user_id % 10 = 0 THEN 100 ELSE 0 END AS p FROM events)"
    marked = "marked AS (SELECT *, CASE WHEN ts IS NULL THEN 'bad' WHEN row_number() OVER (PARTITION BY symbol, ts ORDER BY pos DESC) > 1 THEN 'dup' WHEN p - 1 > 0 THEN NULL ELSE 'inv' END AS problem FROM raw)"
    good = "good AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM marked WHERE problem IS NULL)"
    val = [raw, marked, good, "gj AS (SELECT *, abs(p / lag(p) OVER q - 1) > 0.3 AS jump, date_diff('minute', lag(ts) OVER q, ts) > 90 AND CAST(ts AS DATE) = CAST(lag(ts) OVER q AS DATE) AS gap FROM good WINDOW q AS (PARTITION BY symbol ORDER BY i))",
           "gs AS (SELECT symbol, count(*) AS n, count(*) FILTER (jump) AS jumps, count(*) FILTER (gap) AS gaps FROM gj GROUP BY symbol)",
           "gc AS (SELECT symbol, count(*) AS rows_in, count(*) FILTER (problem = 'bad') AS bad, count(*) FILTER (problem = 'dup') AS dup, count(*) FILTER (problem = 'inv') AS inv FROM marked GROUP BY symbol)",
           "gr AS (SELECT *, 100 - CASE WHEN n < 60 THEN 35 WHEN n < 200 THEN 10 ELSE 0 END - least(20.0, 100 * inv / rows_in) - least(15.0, 100 * gaps / n) - CASE WHEN jumps > 0 THEN 10 ELSE 0 END AS score FROM gc JOIN gs USING (symbol))"]
    b200 = stage("al0", "bars", s5=mean("close", 50), s20=mean("close", 200), rv=f"volume / nullif({mean('volume', 20, 1)}, 0)", prev=lag("close"), n="count(*) OVER (PARTITION BY symbol)")
    b201 = stage("al1", "al0", p5=lag("s5"), p20=lag("s20"))
    rules = "ru(rule_id, condition, level, factor) AS (VALUES (0, 'price_above', 40.0, NULL), (1, 'price_below', 40.0, NULL), (2, 'cross_sma50', NULL, NULL), (3, 'cross_sma200', NULL, NULL), (4, 'ma_crossover', NULL, NULL), (5, 'unusual_volume', NULL, 1.2))"
    names = "sy AS (SELECT DISTINCT symbol FROM bars UNION ALL SELECT 'absent')"
    hit = "CASE condition WHEN 'price_above' THEN close > level AND prev <= level WHEN 'price_below' THEN close < level AND prev >= level WHEN 'cross_sma50' THEN (close - s5) * (prev - p5) < 0 WHEN 'cross_sma200' THEN (close - s20) * (prev - p20) < 0 WHEN 'ma_crossover' THEN (s5 - s20) * (p5 - p20) < 0 ELSE rv >= factor END"
    sig = signalled()
    say = lambda ctes, rest: f"WITH RECURSIVE {', '.join(ctes)} SELECT {rest}"
    return {
        "div01_divergences": say(div, f"symbol, indicator, {kind} AS type, idx1, idx AS idx2, round(v1, 6) AS ind1, round(v, 6) AS ind2, confirmed_idx AS signal_i, round(25 * least(abs(di), 2) + 50 * least(abs(dp), 3) / 3, 6) AS strength FROM dx WHERE abs(dp) >= 0.25 AND abs(di) >= 0.15 AND dp * di < 0"),
        "fib01_levels": say(fib, "symbol, rk AS kind, CAST(ratio AS DOUBLE) AS ratio, round(lv, 6) AS price, idx AS start_idx, ei2 AS end_idx, place = 1 AS nearest FROM fw2"),
        "val07_clean_bars": say([raw, marked, good], "symbol, i, strftime(ts, '%Y-%m-%d %H:%M') AS at, round(p, 6) AS open, round(p + 1, 6) AS high, round(p - 1, 6) AS low, round(p, 6) AS close, CAST(1 AS DOUBLE) AS volume FROM good"),
        "val14_report": say(val, "symbol, rows_in, bad AS bad_timestamps, dup AS duplicates, inv AS invalid_rows, n AS rows_out, 0 AS zero_volume_bars, false AS illiquid, jumps, gaps AS missing_candles, round(greatest(0, score), 6) AS score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' WHEN score >= 30 THEN 'low' ELSE 'insufficient' END AS rating FROM gr"),
        "alr_conditions": say([HOURLY, b200, b201, rules, names], f"sy.symbol, rule_id, i, condition, CASE WHEN n IS NULL THEN 'no_data' WHEN n < 30 THEN 'short_history' WHEN {hit} THEN 'hit' ELSE 'no_hit' END AS status, round(close, 6) AS price FROM sy CROSS JOIN ru LEFT JOIN (SELECT * FROM al1 WHERE i = n - 1) b ON b.symbol = sy.symbol"),
        "alr19_streamed_alerts": say([HOURLY.replace("bars AS (", "every AS (", 1), "bars AS (SELECT * FROM every WHERE ts + INTERVAL '70 minutes' <= (SELECT max(ts) FROM events WHERE value IS NOT NULL))", b200, b201, rules], f"symbol, rule_id, i, condition, round(close, 6) AS price FROM al1 CROSS JOIN ru WHERE i >= 29 AND {hit}"),
        "bkt01_03_signals": say(sig, "symbol, i, spec_id, side, round(close - side * 2 * a, 6) AS stop, round(close + 2 * (side * 2 * a), 6) AS target FROM sj WHERE side IS NOT NULL"),
    }


def harmonics() -> dict[str, str]:
    return {"cht15_17_harmonics": _harmonics(DAILY, 0.25), "cht15_17_close_harmonics": _harmonics(LINES, 0.05)}


def _harmonics(source: str, missed: float) -> str:
    within = lambda x, lo, hi: f"{x} BETWEEN {lo} * {1 - missed} AND {hi} * {1 + missed}"
    specs = {"gartley": ((0.618, 0.618), (0.382, 0.886), (1.272, 1.618), (0.786, 0.786)), "bat": ((0.382, 0.5), (0.382, 0.886), (1.618, 2.618), (0.886, 0.886)), "butterfly": ((0.786, 0.786), (0.382, 0.886), (1.618, 2.24), (1.27, 1.618)), "crab": ((0.382, 0.618), (0.382, 0.886), (2.24, 3.618), (1.618, 1.618))}
    lead = lambda c, k: f"lead({c}, {k}) OVER (PARTITION BY symbol ORDER BY k)"
    seq = "hs AS (SELECT symbol, k, idx AS i1, price AS x1, kind AS k1, " + ", ".join(f"{lead('idx', j)} AS i{j + 1}, {lead('price', j)} AS x{j + 1}, {lead('kind', j)} AS k{j + 1}" for j in range(1, 5)) + " FROM zigzag WHERE NOT provisional)"
    legs = "hl AS (SELECT *, abs(x2 - x1) AS l1, abs(x3 - x2) AS l2, abs(x4 - x3) AS l3, abs(x5 - x4) AS l4 FROM hs)"
    five = "l1 > 0 AND l2 > 0 AND l3 > 0 AND l4 > 0"
    names = [(n, f"{within('l2 / l1', *r[0])} AND {within('l3 / l2', *r[1])} AND {within('l4 / l3', *r[2])} AND {within('abs(x2 - x5) / l1', *r[3])}") for n, r in specs.items()]
    names.append(("cypher", f"{within('l2 / l1', 0.382, 0.618)} AND {within('abs(x4 - x1) / l1', 1.272, 1.414)} AND {within('l4 / greatest(abs(x4 - x1), 1e-9)', 0.786, 0.786)}"))
    parts = [f"SELECT symbol, '{n}' AS name, CASE WHEN k5 = 'L' THEN 1.0 ELSE -1.0 END AS s, i1, i5 AS ix, x5 AS d, l4 AS cd, {'NULL' if n in ('butterfly', 'crab') else 'x1'} AS x, [i1, i2, i3, i4, i5] AS pts FROM hl WHERE i5 IS NOT NULL AND {five} AND {cond}" for n, cond in names]
    parts.append(f"SELECT symbol, 'abcd', CASE WHEN k4 = 'L' THEN 1.0 ELSE -1.0 END, i1, i4, x4, l3, NULL, [i1, i2, i3, i4] FROM hl WHERE i4 IS NOT NULL AND l1 > 0 AND l2 > 0 AND l3 > 0 AND {within('l2 / l1', 0.618, 0.786)} AND {within('l3 / l2', 1.272, 1.618)}")
    ctes = [*PIVOTS, seq, legs, f"hc AS ({' UNION ALL '.join(parts)})",
            "he AS (SELECT h.*, p.last, p.close AS lc FROM hc h JOIN px p ON p.symbol = h.symbol AND p.i = p.last)",
            "hb AS (SELECT h.*, p.i AS j, p.rv, s * (d - p.close) > 0.25 * cd OR coalesce(s * (x - p.close) > 0, false) AS breach, s * (p.close - (d + s * 0.382 * cd)) > 0 AS back FROM he h LEFT JOIN px p ON p.symbol = h.symbol AND p.i > h.ix)",
            "hm AS (SELECT symbol, name, s, i1, ix, d, cd, last, lc, pts, min(j) FILTER (breach) AS inv, min(j) FILTER (back AND NOT breach) AS conf FROM hb GROUP BY ALL)",
            "hn AS (SELECT m.*, p.rv AS rel, CASE WHEN inv < coalesce(conf, 1e9) THEN 'invalidated' WHEN conf IS NOT NULL THEN 'confirmed' WHEN s * (lc - d) > 0 THEN 'approaching_confirmation' ELSE 'forming' END AS stage FROM hm m LEFT JOIN px p ON p.symbol = m.symbol AND p.i = m.conf)",
            "ho AS (SELECT *, CASE stage WHEN 'invalidated' THEN inv WHEN 'confirmed' THEN conf ELSE ix END AS fin, CASE WHEN stage = 'confirmed' THEN CASE WHEN rel >= 1.5 THEN 1.0 WHEN rel IS NOT NULL THEN 0.3 END END AS vol, CASE stage WHEN 'confirmed' THEN 1.0 WHEN 'approaching_confirmation' THEN 0.6 WHEN 'forming' THEN 0.4 ELSE 0.0 END AS bonus FROM hn)"]
    ctes.append("hp AS (SELECT *, name || CASE WHEN s > 0 THEN '_bullish' ELSE '_bearish' END AS pattern_id, round(100 * (0.7 + coalesce(vol, 0) + bonus) / (2 + CASE WHEN vol IS NULL THEN 0 ELSE 1 END), 1) AS quality FROM ho)")
    shown = "symbol, pattern_id, stage, i1 AS start_idx, fin AS end_idx, CASE WHEN stage = 'confirmed' THEN conf END AS confirmation_idx, round(d + s * 0.382 * cd + 1e-7, 4) AS level, round(d - s * 0.25 * cd + 1e-7, 4) AS inval, round(d + s * 0.618 * cd + 1e-7, 4) AS target, quality"
    ctes = [source if x is HOURLY else x for x in [*ctes, *_best("hp")]]
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT {shown} FROM best"


def impulses() -> dict[str, str]:
    lead = lambda c, k: f"lead({c}, {k}) OVER (PARTITION BY symbol ORDER BY k)"
    seq = "es AS (SELECT symbol, k, idx AS i1, price AS x1, CASE WHEN kind = 'L' THEN 1.0 ELSE -1.0 END AS s, " + ", ".join(f"{lead('idx', j)} AS i{j + 1}, {lead('price', j)} AS x{j + 1}" for j in range(1, 6)) + " FROM zigzag WHERE NOT provisional)"
    waves = "ew AS (SELECT *, s * (x2 - x1) AS w1, s * (x4 - x3) AS w3, s * (x6 - x5) AS w5 FROM es WHERE i6 IS NOT NULL)"
    rules = "w1 > 0 AND w3 > 0 AND w5 > 0 AND s * x3 > s * x1 AND w3 >= least(w1, w5) AND s * x5 > s * x2 AND w1 >= 2 * c.a"
    return {"cht18_impulses": f"WITH RECURSIVE {', '.join([*(DAILY if x is HOURLY else x for x in ZIGZAG), seq, waves])} SELECT e.symbol, CASE WHEN s > 0 THEN 'elliott_impulse_up' ELSE 'elliott_impulse_down' END AS pattern_id, i1 AS start_idx, i6 AS end_idx, round(x5 + 1e-7, 4) AS level, round(x6 + 1e-7, 4) AS inval, round(x6 - 0.382 * (x6 - x1) + 1e-7, 4) AS target, round(100 * (least(1.0, w3 / greatest(w1, 1e-9) / 1.618) + 0.4) / 2, 6) AS quality FROM ew e JOIN sc c ON c.symbol = e.symbol AND c.i = e.i2 WHERE {rules}"}


def levels() -> dict[str, str]:
    bins = [HOURLY, f"lt AS (SELECT *, {TYPICAL} AS t FROM bars)", "lb AS (SELECT *, min(t) OVER (PARTITION BY symbol) AS lo, max(t) OVER (PARTITION BY symbol) AS hi FROM lt)",
            "lc AS (SELECT symbol, lo, (hi - lo) / 30 AS wd, least(floor((t - lo) / ((hi - lo) / 30)), 29) AS bin, volume FROM lb WHERE hi > lo)",
            "ls AS (SELECT symbol, bin, sum(volume) AS volume, any_value(lo) + (bin + 0.5) * any_value(wd) AS price FROM lc GROUP BY symbol, bin HAVING sum(volume) > 0)",
            "lr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY volume DESC, bin) AS place FROM ls)"]
    last = [HOURLY, stage("la", "bars", s50=mean("close", 50), s100=mean("close", 100), s200=mean("close", 200), n="count(*) OVER (PARTITION BY symbol)"), "lz AS (SELECT * FROM la WHERE i = n - 1 AND close > 0)",
            "lq AS (SELECT *, coalesce((SELECT min(x) FROM (VALUES (0.5), (1), (5), (10), (50), (100), (500), (1000), (5000)) t(x) WHERE close / x < 40), 10000) AS step FROM lz)",
            "lv2 AS (SELECT symbol, 'sma_50' AS kind, s50 AS price FROM lq UNION ALL SELECT symbol, 'sma_100', s100 FROM lq UNION ALL SELECT symbol, 'sma_200', s200 FROM lq UNION ALL SELECT symbol, 'round', (floor(close / step) + k) * step FROM lq, (VALUES (-1), (0), (1), (2)) v(k))"]
    return {
        "lvl09_volume_at_price": f"WITH {', '.join(bins)} SELECT symbol, round(price, 6) AS price, round(volume, 6) AS volume FROM lr WHERE place <= 2",
        "lvl08_auxiliary": f"WITH {', '.join(last)} SELECT symbol, kind, round(price, 6) AS price FROM lv2 WHERE price IS NOT NULL AND (kind <> 'round' OR price > 0)",
        "src_streamed_bars": f"WITH {HOURLY} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M') AS at, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, round(volume, 8) AS volume FROM bars WHERE ts + INTERVAL '70 minutes' <= (SELECT max(ts) FROM events WHERE value IS NOT NULL)",
    }


def alerts() -> dict[str, str]:
    short = [LINES.replace("bars AS (", "every AS (", 1), "bars AS (SELECT e.* FROM every e JOIN (SELECT symbol, max(i) AS m FROM every GROUP BY symbol) USING (symbol) WHERE i < m)", *(x for x in ZIGZAG if x != HOURLY), *ZONES,
             "nw AS (SELECT symbol, max(i) AS i, arg_max(close, i) AS close, arg_max(close, i) FILTER (i < m) AS prev FROM every JOIN (SELECT symbol, max(i) AS m FROM every GROUP BY symbol) USING (symbol) GROUP BY symbol)",
             "ni AS (SELECT nw.*, (SELECT high FROM zones z WHERE z.symbol = nw.symbol AND immediate AND kind = 'resistance') AS top, (SELECT low FROM zones z WHERE z.symbol = nw.symbol AND immediate AND kind = 'support') AS bottom FROM nw)",
             "nh AS (SELECT symbol, i, close, r, c, coalesce(CASE c WHEN 'break_resistance' THEN close > top AND prev <= top ELSE close < bottom AND prev >= bottom END, false) AS hit FROM ni, (VALUES (0, 'break_resistance'), (1, 'break_support')) v(r, c))"]
    v = _more_patterns("")["cht10_v_reversals"]
    hits = {"pattern_confirmed": ("conf = last", "level + m * (b - ma)"), "pattern_invalidated": (f"({NOW}) AND stage IN ('failed', 'invalidated') AND fin = last", "inval + vm * (b - va)"), "breakout_retest": (f"({NOW}) AND stage = 'retesting'", "level + m * (b - ma)"), "bullish_reversal": ("conf = last AND sgn > 0", "level + m * (b - ma)"), "bearish_reversal": ("conf = last AND sgn < 0", "level + m * (b - ma)")}
    fired = " UNION ALL ".join(f"SELECT symbol, {k} AS r, min({price}) AS price FROM best WHERE {rule} GROUP BY symbol" for k, (rule, price) in enumerate(hits.values()))
    names = ", ".join(f"({k}, '{x}')" for k, x in enumerate(hits))
    return {
        "alr01_02_breaks": f"WITH RECURSIVE {', '.join(short)} SELECT symbol, r AS rule_id, i, c AS condition, CASE WHEN i + 1 < 30 THEN 'short_history' WHEN hit THEN 'hit' ELSE 'no_hit' END AS status, CASE WHEN hit THEN round(close, 6) END AS price FROM nh",
        "alr05_15_patterns": v[: v.rindex(" SELECT symbol, pattern_id")] + f", fh AS ({fired}), fn AS (SELECT symbol, max(i) AS i FROM bars GROUP BY symbol) SELECT fn.symbol, v.r AS rule_id, fn.i, v.c AS condition, CASE WHEN fn.i + 1 < 30 THEN 'short_history' WHEN fh.r IS NOT NULL THEN 'hit' ELSE 'no_hit' END AS status, round(fh.price, 6) AS price FROM fn CROSS JOIN (VALUES {names}) v(r, c) LEFT JOIN fh ON fh.symbol = fn.symbol AND fh.r = v.r",
        "val12_13_freshness": freshness(),
    }


def freshness() -> str:
    days = f"d AS (WITH {DAILY} SELECT * FROM bars)"
    week = "w AS (SELECT symbol, min(ts) AS ts FROM (SELECT symbol, ts, ts - INTERVAL (CAST((dayofweek(ts) + 1) % 7 AS INTEGER)) DAY AS b FROM d) GROUP BY symbol, b)"
    month = "mo AS (SELECT symbol, min(ts) AS ts FROM d GROUP BY symbol, date_trunc('month', ts))"
    hours = f"h AS (WITH {HOURLY} SELECT * FROM bars)"
    last = "l AS (SELECT symbol, '1d' AS timeframe, max(ts) AS t FROM d GROUP BY 1 UNION ALL SELECT symbol, '1w', max(ts) FROM w GROUP BY 1 UNION ALL SELECT symbol, '1M', max(ts) FROM mo GROUP BY 1 UNION ALL SELECT symbol, '1h', max(ts) FROM h GROUP BY 1)"
    now = "TIMESTAMP '2001-11-09 12:00:00'"
    close = "CASE WHEN dayofweek({0}) = 5 THEN INTERVAL '16 hours 30 minutes' ELSE INTERVAL '15 hours 30 minutes' END"
    friday = "(date_trunc('day', t) + INTERVAL (CAST((12 - dayofweek(t)) % 7 AS INTEGER)) DAY)"
    done = f"CASE timeframe WHEN '1h' THEN {now} >= t + INTERVAL '1 hour' WHEN '1d' THEN {now} >= date_trunc('day', t) + {close.format('t')} WHEN '1w' THEN {now} >= {friday} + INTERVAL '16 hours 30 minutes' ELSE CAST({now} AS DATE) > last_day(t) END"
    old = f"((epoch({now}) - epoch(t)) / 86400)"
    return f"WITH {', '.join([days, week, month, hours, last])} SELECT symbol, timeframe, strftime(t, '%Y-%m-%d %H:%M') AS last, {done} AS last_complete, round({old}, 2) AS staleness_days, {old} > 5 AS stale FROM l"


def timeframes() -> dict[str, str]:
    agg = "first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, min(ts) AS ts"
    place = "row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i"
    daily = DAILY.replace("bars AS (", "days AS (", 1)
    many = (f"bars AS (SELECT symbol || '|1d' AS symbol, ts, open, high, low, close, volume, i FROM days UNION ALL SELECT symbol || '|1w', ts, open, high, low, close, volume, {place} FROM (SELECT symbol, {agg} FROM days GROUP BY symbol, CAST(ts AS DATE) + CAST((12 - isodow(ts)) % 7 AS INTEGER)) "
            f"UNION ALL SELECT symbol || '|1M', ts, open, high, low, close, volume, {place} FROM (SELECT symbol, {agg} FROM days GROUP BY symbol, date_trunc('month', ts)))")
    adx = [stage("t", "bars", tr=TR), stage("dm", "t", up=f"high - {lag('high')}", dn=f"{lag('low')} - low"), stage("dms", "dm", pdm="CASE WHEN up > dn AND up > 0 THEN up WHEN up IS NOT NULL THEN 0 END", mdm="CASE WHEN dn > up AND dn > 0 THEN dn WHEN up IS NOT NULL THEN 0 END"),
           *smooth("ra", "dms", "tr", 14, "(1.0 / 14)"), *smooth("rp", "dms", "pdm", 14, "(1.0 / 14)"), *smooth("rm", "dms", "mdm", 14, "(1.0 / 14)"), with_smooth("az", "dms", a="ra", p="rp", m="rm"),
           stage("ay", "az", pdi="100 * p / nullif(a, 0)", mdi="100 * m / nullif(a, 0)"), stage("ax", "ay", dx="100 * abs(pdi - mdi) / nullif(pdi + mdi, 0)"), *smooth("rx", "ax", "dx", 14, "(1.0 / 14)")]
    rsi = [stage("rg0", "bars", ch=f"close - {lag('close')}"), *smooth("rsg", "rg0", "greatest(ch, 0) + ch * 0", 14, "(1.0 / 14)"), *smooth("rsl", "rg0", "greatest(-ch, 0) + ch * 0", 14, "(1.0 / 14)"), with_smooth("rsz", "rg0", g="rsg", l="rsl"),
           "rs AS (SELECT symbol, i, CASE WHEN l = 0 AND g = 0 THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS v FROM rsz)"]
    macd = [*smooth("m12", "bars", "close", 12, "(2.0 / 13)"), *smooth("m26", "bars", "close", 26, "(2.0 / 27)"), with_smooth("mz", "bars", f="m12", s="m26"), "mc AS (SELECT symbol, i, f - s AS v FROM mz)", *smooth("m9", "mc", "v", 9, "0.2")]
    zig = [many if x is HOURLY else x for x in ZIGZAG]
    label = ["zp AS (SELECT *, lag(price) OVER (PARTITION BY symbol, kind ORDER BY idx) AS pp FROM zigzag WHERE NOT provisional)", "zl AS (SELECT *, CASE WHEN pp IS NOT NULL THEN CASE WHEN price > pp THEN 'H' ELSE 'L' END || kind END AS label, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC, kind DESC) AS place FROM zp)",
             "zt AS (SELECT symbol, count(label) AS n, count(*) FILTER (label IN ('HH', 'HL')) AS up, count(*) FILTER (label IN ('LH', 'LL')) AS down FROM zl WHERE place <= 4 GROUP BY symbol)",
             "zs AS (SELECT symbol, CASE WHEN n < 3 THEN 'undetermined' WHEN up >= 3 AND (down = 0 OR n = 4) THEN 'uptrend' WHEN down >= 3 AND (up = 0 OR n = 4) THEN 'downtrend' ELSE 'range' END AS structure FROM zt)"]
    last = [stage("ta", "bars", n="count(*) OVER (PARTITION BY symbol)", **{f"s{p}": mean("close", p) for p in (10, 20, 50, 200)}), stage("tb", "ta", **{f"b{p}": lag(f"s{p}", 5) for p in (20, 50, 200)}),
            "tc AS (SELECT *, CASE WHEN n >= 220 THEN s50 WHEN n >= 60 THEN s20 ELSE s10 END AS fa, CASE WHEN n >= 220 THEN s200 WHEN n >= 60 THEN s50 ELSE s20 END AS sl, CASE WHEN n >= 220 THEN b200 WHEN n >= 60 THEN b50 ELSE b20 END AS pa, CASE WHEN n >= 220 THEN 200 WHEN n >= 60 THEN 50 ELSE 20 END AS per FROM tb WHERE i = n - 1 AND n >= 20)",
            "td AS (SELECT tc.*, rs.v AS rsi, mc.v AS macd, m9.e AS sig, rx.e AS adx, coalesce(zs.structure, 'undetermined') AS structure FROM tc LEFT JOIN rs ON rs.symbol = tc.symbol AND rs.i = tc.i LEFT JOIN mc ON mc.symbol = tc.symbol AND mc.i = tc.i LEFT JOIN m9 ON m9.symbol = tc.symbol AND m9.i = tc.i LEFT JOIN rx ON rx.symbol = tc.symbol AND rx.i = tc.i LEFT JOIN zs ON zs.symbol = tc.symbol)",
            "te AS (SELECT *, CASE WHEN close > sl THEN 1.0 ELSE -1.0 END AS c1, CASE WHEN fa > sl THEN 1.0 ELSE -1.0 END AS c2, CASE WHEN n - per + 1 > 6 THEN greatest(-1.0, least(1.0, (sl - pa) / pa * 100)) ELSE 0 END AS c3, CASE structure WHEN 'uptrend' THEN 1.0 WHEN 'downtrend' THEN -1.0 ELSE 0.0 END AS c4, CASE WHEN macd > sig THEN 0.5 ELSE -0.5 END + CASE WHEN macd > 0 THEN 0.5 ELSE -0.5 END AS c5, greatest(-1.0, least(1.0, (rsi - 50) / 20)) AS c6 FROM td)",
            "tf AS (SELECT split_part(symbol, '|', 1) AS sym, split_part(symbol, '|', 2) AS tfm, n, structure, round(100 * (coalesce(2 * c1 + 2 * c2 + 1.5 * c3, 0) + 2 * c4 + CASE WHEN macd IS NULL THEN 0 ELSE c5 END + coalesce(CASE WHEN rsi IS NULL THEN NULL ELSE c6 END, 0)) / (CASE WHEN sl IS NULL THEN 0 ELSE 5.5 END + 2 + CASE WHEN macd IS NULL THEN 0 ELSE 1 END + CASE WHEN rsi IS NULL THEN 0 ELSE 1 END) * CASE WHEN adx IS NULL THEN 1 ELSE 0.7 + 0.3 * least(1.0, adx / 25) END, 1) AS score FROM te)",
            "tg AS (SELECT *, CASE WHEN score >= 30 THEN 'bullish' WHEN score <= -30 THEN 'bearish' ELSE 'neutral' END AS trend FROM tf)"]
    ctes = ", ".join([daily, *zig, *adx, *rsi, *macd, *label, *last])
    return {
        "mtf01_assess": f"WITH RECURSIVE {ctes} SELECT sym AS symbol, tfm AS timeframe, n AS bars, score, trend, CASE WHEN abs(score) >= 65 THEN 'strong' WHEN abs(score) >= 30 THEN 'moderate' ELSE 'weak' END AS strength, structure FROM tg",
        "mtf02_combine": f"WITH RECURSIVE {ctes}, th AS (SELECT sym AS symbol, sum(w * score) / sum(w) AS s, count(*) AS n, count(*) FILTER (trend = 'bullish') AS up, count(*) FILTER (trend = 'bearish') AS down FROM tg JOIN (VALUES ('1M', 1.5), ('1w', 2.0), ('1d', 2.0)) v(t, w) ON v.t = tfm GROUP BY sym) "
        "SELECT symbol, CASE WHEN s >= 55 AND up = n THEN 'strong_bullish' WHEN s >= 20 AND down = 0 THEN 'moderate_bullish' WHEN s <= -55 AND down = n THEN 'strong_bearish' WHEN s <= -20 AND up = 0 THEN 'moderate_bearish' ELSE 'mixed' END AS alignment, round(s, 1) AS alignment_score FROM th",
    }
