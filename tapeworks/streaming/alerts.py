"""Alerts on a stream of bars: what rules need is kept as state, hits are delivered once, failures are rows.

    followed = follow(closed_bars(ticks))                 # averages and swings at each bar
    query = start(followed, rules, channels, folder)      # hits and deliveries below ``folder``
    status(query, monitor)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from tapeworks.operators import alerts
from tapeworks.operators.recursive import NAN, START, walk

#: Bars whose closes and volumes are kept: as the longest average and that of the volumes need.
LONGEST, VOLUMES, PERIOD = 200, 20, 14
STATE = "n long, last long, closes array<double>, volumes array<double>, ranges double, scale double, seeking string, top_at long, top double, bottom_at long, bottom double, width double"
FOLLOWED = "symbol string, at long, n long, close double, prev double, sma_50 double, sma_200 double, prev_sma_50 double, prev_sma_200 double, rel_volume double, scale double, turn string, turn_i long, turn_price double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _mean(x: list[float], n: int) -> float:
    """Of the last ``n`` values, summed in their order; unknown if there are fewer or one is."""
    return float(np.cumsum(x[-n:])[-1]) / n if len(x) >= n else NAN


class Follower(StatefulProcessor):
    """A series' last closes and volumes, its running scale and its walk over the swings, from bar to bar."""

    def __init__(self, width: float = 2.0):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last, closes, volumes, ranges, scale, walked = 0, None, [], [], 0.0, NAN, START
        if self.state.exists():
            n, last, closes, volumes, ranges, scale, *w = self.state.get()[:11]
            closes, volumes, walked = list(closes), [NAN if v is None else v for v in volumes], tuple(w)
        bars = pd.concat(list(rows)).sort_values("at").drop_duplicates("at")
        bars = bars if last is None else bars[bars["at"] > last]  # a bar that came before is not counted twice
        out = []
        for at, high, low, close, volume in bars[["at", "high", "low", "close", "volume"]].itertuples(index=False):
            tr = high - low if not closes else max(high - low, abs(high - closes[-1]), abs(low - closes[-1]))
            ranges += tr
            scale = ranges / (n + 1) if n < PERIOD else scale + (tr - scale) / PERIOD
            found, walked = walk(walked, [high], [low], [self.width * max(scale, 1e-9)], n)
            turn_i, turn_price, turn, *_ = found[0] if found else (None, None, None)
            prev, usual = (closes[-1] if closes else NAN), _mean(volumes, VOLUMES)
            before = _mean(closes, 50), _mean(closes, LONGEST)
            closes, volumes, n, last = [*closes[1 - LONGEST :], close], [*volumes[1 - VOLUMES :], volume], n + 1, at
            out.append((key[0], at, n, close, prev, _mean(closes, 50), _mean(closes, LONGEST), *before, volume / usual if usual else NAN, max(scale, 1e-9), turn, turn_i, turn_price))
        if out:
            self.state.update((n, int(last), closes, [None if np.isnan(v) else v for v in volumes], ranges, scale, *walked, self.width))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in FOLLOWED.split(", ")])
        yield frame.astype({"turn_i": "Int64"})

    def close(self) -> None:
        pass


def follow(bars: DataFrame, width: float = 2.0) -> DataFrame:
    """A row for each bar of the stream ``bars(symbol, ts, high, low, close, volume)``: what ``alerts.newest`` shows of it, the scale, and the swing that it confirms.

    ``n`` counts the series' bars. Bars come in any order inside a batch; one that is not later than those of earlier
    batches is left out. State is a few hundred numbers a series.
    """
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    slim = bars.select("symbol", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume")))
    followed = slim.groupBy("symbol").transformWithStateInPandas(Follower(width), outputStructType=FOLLOWED, outputMode="Append", timeMode="None")
    known = [F.nanvl(F.col(c), F.lit(None)).alias(c) for c in ("prev", "sma_50", "sma_200", "prev_sma_50", "prev_sma_200", "rel_volume")]
    return followed.select("symbol", F.timestamp_micros("at").alias("ts"), "n", "close", *known, "scale", "turn", "turn_i", "turn_price")


def hits(followed: DataFrame, rules: DataFrame, least_bars: int = 30) -> DataFrame:
    """(rule_id, symbol, ts, i, condition, price) where a bar with ``least_bars`` up to it meets a rule of its symbol."""
    rows = followed.join(rules, "symbol").where(F.col("n") >= least_bars).where(alerts.met())
    return rows.select("rule_id", "symbol", "ts", (F.col("n") - 1).alias("i"), "condition", F.col("close").alias("price"))


Channel = Callable[[dict], str]
DELIVERED = "rule_id long, symbol string, ts timestamp, channel string, ok boolean, detail string"


def deliver(found: DataFrame, channels: dict[str, Channel], wanted: DataFrame) -> DataFrame:
    """(rule_id, symbol, ts, channel, ok, detail): what became of each hit on each channel that ``wanted(rule_id, channel)`` names.

    ``channels`` are functions that send a hit (a dict) and return what they have to say. One that raises, and one that
    is not known, is a row with ``ok`` false and the reason; nothing is raised. Hits are sent by the tasks that hold them.
    """

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = []
            for hit in frame.to_dict("records"):
                channel = hit["channel"]
                try:
                    if channel not in channels:
                        raise LookupError("unknown channel")
                    told.append((True, str(channels[channel](hit))[:200]))
                except Exception as failure:  # recorded, whatever it is
                    told.append((False, str(failure)[:200]))
            yield frame[["rule_id", "symbol", "ts", "channel"]].assign(ok=[x for x, _ in told], detail=[x for _, x in told])

    return found.join(wanted.select("rule_id", "channel").distinct(), "rule_id").mapInPandas(send, DELIVERED)


def start(followed: DataFrame, rules: DataFrame, folder: str, channels: dict[str, Channel] | None = None, wanted: DataFrame | None = None, every: str | None = None, least_bars: int = 30) -> StreamingQuery:
    """Run the rules on a followed stream: hits below ``folder/hits``, deliveries below ``folder/deliveries``, one part for each batch.

    A batch that is run again after a failure overwrites its own part, so that a hit is stored once; it may be sent
    again. Started anew with the same ``folder`` the stream goes on where it stopped. Without ``every`` (as
    ``1 minute``) it ends when all that is there is read.
    """

    def store(found: DataFrame, batch: int) -> None:
        part = f"{folder}/hits/batch={batch}"
        found.write.mode("overwrite").parquet(part)
        if channels is not None and wanted is not None:
            deliver(found.sparkSession.read.schema(found.schema).parquet(part), channels, wanted).write.mode("overwrite").parquet(f"{folder}/deliveries/batch={batch}")

    writer = hits(followed, rules, least_bars).writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/state")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Monitor(StreamingQueryListener):
    """What was last heard of each query; add it with ``spark.streams.addListener``."""

    def __init__(self) -> None:
        self.heard: dict[str, dict] = {}

    def _note(self, query, **what) -> None:
        self.heard.setdefault(str(query), {"last_run": None, "last_error": None, "running": False, "batches": 0, "rows": 0}).update(what)

    def onQueryStarted(self, event) -> None:
        self._note(event.id, running=True, last_error=None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._note(p.id)
        seen = self.heard[str(p.id)]
        self._note(p.id, last_run=p.timestamp, batches=p.batchId + 1, rows=seen["rows"] + max(0, p.numInputRows))

    def onQueryIdle(self, event) -> None:
        self._note(event.id, last_run=event.timestamp)

    def onQueryTerminated(self, event) -> None:
        self._note(event.id, running=False, last_error=event.exception[:200] if event.exception else None)


def status(query: StreamingQuery, monitor: Monitor, live: bool = False) -> dict:
    """What can honestly be said of a query: whether it runs, when it last did, its last error, and whether anything is watched at all.

    ``live`` says that new data reach the stream's source while it runs.
    """
    heard = {"last_run": None, "last_error": None, "running": False, "batches": 0, "rows": 0} | monitor.heard.get(str(query.id), {})
    running = query.isActive
    notes = [] if running else ["Not running: rules are evaluated when the stream is started."]
    notes += [] if live else ["No live source: rules see stored bars only, and meet new ones when these are added."]
    return heard | {"running": running, "monitoring": running and live, "notes": notes, "asked_at": datetime.now(UTC).isoformat()}


def read(spark: SparkSession, folder: str, what: str, schema: str) -> DataFrame:
    """The stored ``hits`` or ``deliveries``; of none, an empty frame."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{what}")
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{folder}/{what}/batch=*") if exists else spark.createDataFrame([], schema)


HITS = "rule_id long, symbol string, ts timestamp, i long, condition string, price double"
