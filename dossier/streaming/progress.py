"""Progress feeds: lines of JSON, and the percentage shown, which never falls within a phase."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

LINE = "status string, completed bigint, total bigint"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines with status, completed and total; broken ones and those without a status go. Works on streams."""
    parsed = F.from_json(F.col(column), LINE)
    keep = [c for c in lines.columns if c != column]
    return lines.select(*keep, parsed.alias("p")).where("p.status is not null").select(*keep, "p.*")


def percent(completed: Column, total: Column) -> Column:
    """Whole percent between 0 and 100; null without a positive total."""
    return F.when(completed.isNotNull() & (total > 0), F.least(F.lit(100), F.greatest(F.lit(0), F.floor(completed * 100 / total))).cast("int"))


def running_max(rows: DataFrame, job: str, seq: str, phase: str = "phase", pct: str = "pct") -> DataFrame:
    """Adds ``shown``: the largest percentage since the phase began; a phase that returns begins anew."""
    w = Window.partitionBy(job).orderBy(seq)
    marked = rows.withColumn("_new", F.when(F.lag(phase).over(w).eqNullSafe(F.col(phase)), 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(w))
    return marked.withColumn("shown", F.max(pct).over(Window.partitionBy(job, "_run").orderBy(seq))).drop("_new", "_run")


SHOWN = "job string, seq bigint, phase string, shown int"
SAVED = "key string, ts timestamp, changes bigint"
#: What a session has to be set to for the streams here that keep state of their own.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Shown(StatefulProcessor):
    """Of each job its phase and the largest percentage since that began."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("shown", "phase string, top int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        phase, top = self.state.get() if self.state.exists() else (None, 0)
        for part in rows:
            part = part.sort_values("seq")
            shown = []
            for p, pct in zip(part["phase"], part["pct"], strict=True):
                top = pct if p != phase else max(top, pct)
                phase = p
                shown.append(int(top))
            yield pd.DataFrame({"job": key[0], "seq": part["seq"], "phase": part["phase"], "shown": shown})
        self.state.update((phase, int(top)))

    def close(self) -> None:
        pass


def shown_stream(rows: DataFrame) -> DataFrame:
    """(job, seq, phase, shown) of a stream (job string, seq long, phase string, pct int), each job's rows coming in order of seq."""
    return rows.groupBy("job").transformWithStateInPandas(statefulProcessor=Shown(), outputStructType=SHOWN, outputMode="Append", timeMode="None")


class Saved(StatefulProcessor):
    """Of each key the first and last change since it was saved, and how many; a timer saves when a pause or the longest wait is over."""

    def __init__(self, pause_ms: int, longest_ms: int) -> None:
        self.pause, self.longest = pause_ms, longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("changes", "first long, last long, n long")

    def _due(self, first: int, last: int) -> int:
        return min(last + self.pause, first + self.longest)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        open_ = self.state.get() if self.state.exists() else None
        out = []
        if open_:
            self.handle.deleteTimer(self._due(open_[0], open_[1]))
        for ms in sorted(int(t.timestamp() * 1000) for part in rows for t in part["ts"]):
            if open_ and ms >= self._due(open_[0], open_[1]):
                out.append((self._due(open_[0], open_[1]), open_[2]))
                open_ = None
            open_ = (open_[0], max(open_[1], ms), open_[2] + 1) if open_ else (ms, ms, 1)
        if open_:
            self.state.update(open_)
            self.handle.registerTimer(self._due(open_[0], open_[1]))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            first, last, n = self.state.get()
            self.state.clear()
            yield self._rows(key, [(self._due(first, last), n)])

    @staticmethod
    def _rows(key: tuple, out: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({"key": key[0], "ts": pd.to_datetime([ms for ms, _ in out], unit="ms"), "changes": [n for _, n in out]})

    def close(self) -> None:
        pass


def saves_stream(rows: DataFrame, pause: int = 59, longest: int = 600) -> DataFrame:
    """(key, ts, changes): when changes (key string, ts timestamp, dirty boolean, has_data boolean) of a stream are saved.

    Changes are saved when ``pause`` seconds have gone without another, and ``longest`` seconds after the first that is
    not saved at the latest. Rows that are not dirty or hold no data change nothing. The stream needs a watermark on ts;
    rows behind it are late and dropped, and a save comes out once the watermark has passed its time. Sessions set
    ``STATE_STORE`` and the time zone UTC.
    """
    return rows.where("dirty and has_data").groupBy("key").transformWithStateInPandas(
        statefulProcessor=Saved(pause * 1000, longest * 1000), outputStructType=SAVED, outputMode="Append", timeMode="EventTime"
    )


def saves(rows: DataFrame, pause: int = 59, longest: int = 600) -> DataFrame:
    """The same for a table, in which all changes have come: (key, ts, changes).

    Pauses cut a key's changes into bursts by windows; only the changes of one burst are put in order together.
    """
    w = Window.partitionBy("key").orderBy("ms")
    ms = rows.where("dirty and has_data").select("key", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    paused = F.coalesce(F.col("ms") - F.lag("ms").over(w) >= pause * 1000, F.lit(True))
    bursts = ms.withColumn("paused", paused.cast("int")).withColumn("burst", F.sum("paused").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = bursts.groupBy("key", "burst").agg(F.array_sort(F.collect_list("ms")).alias("at"))
    due = lambda s: F.least(s["last"] + pause * 1000, s["first"] + longest * 1000)
    new = lambda t: F.struct(t.alias("first"), t.alias("last"), F.lit(1).cast("long").alias("n"))
    kind = "struct<done:array<struct<ts:long,n:long>>,open:struct<first:long,last:long,n:long>>"
    saved = lambda s: F.concat(s["done"], F.array(F.struct(due(s["open"]).alias("ts"), s["open"]["n"].alias("n"))))

    def step(s: Column, t: Column) -> Column:
        more = F.struct(s["open"]["first"].alias("first"), t.alias("last"), (s["open"]["n"] + 1).alias("n"))
        return (
            F.when(s["open"].isNull(), F.struct(s["done"].alias("done"), new(t).alias("open")))
            .when(t >= due(s["open"]), F.struct(saved(s).alias("done"), new(t).alias("open")))
            .otherwise(F.struct(s["done"].alias("done"), more.alias("open")))
        )

    none = F.struct(F.array().cast("array<struct<ts:long,n:long>>").alias("done"), F.lit(None).cast("struct<first:long,last:long,n:long>").alias("open")).cast(kind)
    rows = own.select("key", F.explode(F.aggregate("at", none, step, saved)).alias("x"))
    return rows.select("key", F.timestamp_millis("x.ts").alias("ts"), F.col("x.n").alias("changes"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A stream of progress lines from text files."""
    return parse_lines(spark.readStream.text(path))


def debounced(rows: DataFrame, key: str, ts: str, gap: str = "59 seconds") -> DataFrame:
    """The last of each burst of saves: rows closer than a gap are one session. Works on streams with a watermark."""
    return rows.groupBy(key, F.session_window(ts, gap).alias("session")).agg(F.max(ts).alias("saved_at"), F.count("*").alias("changes"))


def recovery(primary: Column, recovered: Column, valid: Column) -> Column:
    """What to do with a recovery file: 'none', 'discard_invalid', 'discard_stale' or 'offer'."""
    return F.when(recovered.isNull(), "none").when(~valid, "discard_invalid").when(primary.isNotNull() & (primary >= recovered), "discard_stale").otherwise("offer")
