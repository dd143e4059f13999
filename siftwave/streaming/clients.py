"""State per client: repeats bounded by count, and request windows that start with a client's request.

Both keep one small row of state for a client. Inside a micro-batch a client's rows
are taken in the order of ``(ts, event_id)``; time never runs backwards for a client,
so a row that comes late counts at the latest time seen. A task holds the narrow
columns of one client's rows in one micro-batch, which ``maxFilesPerTrigger`` bounds.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed_values as fv
from ..functions.text import text_key
from ..session import cut

REMEMBERED = 500  # texts of a client


def _rows(chunks: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(chunks)).sort_values(["ts", "event_id"], kind="stable", ignore_index=True)


def first_texts(stream: DataFrame, capacity: int = REMEMBERED) -> DataFrame:
    """``(client, event_id, ts, key, fresh)`` of ``stream(client, event_id, ts, text)``.

    A text is fresh unless it is among the client's last ``capacity`` fresh ones; a
    repeat doesn't make it younger. An empty text is never fresh.
    """

    def run(client: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = OrderedDict.fromkeys(state.get[0].split(" ") if state.exists and state.get[0] else [])
        rows, fresh = _rows(chunks), []
        for key in rows["key"]:
            new = bool(key) and key not in held
            if new:
                held[key] = None
                if len(held) > capacity:
                    held.popitem(last=False)
            fresh.append(new)
        state.update((" ".join(held),))
        yield rows.assign(fresh=fresh)[["client", "event_id", "ts", "key", "fresh"]]

    text = F.coalesce(text_key(F.col("text")), F.lit(""))
    keyed = stream.select("client", "event_id", "ts", F.when(text == "", "").otherwise(F.md5(text)).alias("key"))
    return keyed.groupBy("client").applyInPandasWithState(
        run, f"client {_kind(stream)}, event_id long, ts timestamp, key string, fresh boolean", "held string", "append", GroupStateTimeout.NoTimeout
    )


def _kind(df: DataFrame) -> str:
    return df.schema["client"].dataType.simpleString()


def limit_clients(stream: DataFrame, limit: int = fv.REQUESTS_PER_WINDOW, window: str = "60 seconds", lateness: str = "10 minutes") -> DataFrame:
    """``(client, event_id, ts, window_start, refused)`` of ``stream(client, event_id, ts)``.

    A window starts with the first request that no window of the client holds, and lasts
    ``window``; it serves ``limit`` requests. The state of a client goes when the watermark
    passes the end of its window.
    """
    span = pd.Timedelta(window)

    def run(client: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used, last = (pd.Timestamp(state.get[0], unit="us"), state.get[1], pd.Timestamp(state.get[2], unit="us")) if state.exists else (None, 0, None)
        rows, starts, refused = _rows(chunks), [], []
        for ts in rows["ts"]:
            last = ts if last is None else max(ts, last)
            if start is None or last >= start + span:
                start, used = last, 0
            used += 1
            starts.append(start)
            refused.append(used > limit)
        state.update((_micros(start), used, _micros(last)))
        state.setTimeoutTimestamp(max(_micros(start + span) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield rows.assign(window_start=starts, refused=refused)[["client", "event_id", "ts", "window_start", "refused"]]

    timed = stream.select("client", "event_id", "ts").withWatermark("ts", lateness)
    return timed.groupBy("client").applyInPandasWithState(
        run, f"client {_kind(stream)}, event_id long, ts timestamp, window_start timestamp, refused boolean", "start long, used long, last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def _micros(t: pd.Timestamp) -> int:
    return int(t.value // 1000)


def window_starts(requests: DataFrame, window_seconds: int = 60) -> DataFrame:
    """``(client, event_id, t)`` of the requests that start a window, of ``requests(client, event_id, ts)``; ``t`` in microseconds.

    Every request points to the one that would start the next window if it started one
    itself: the first at least ``window_seconds`` later. The starts are what a client's
    first request reaches over these pointers, found by doubling them. Nothing holds all
    requests of a client: they are sorted in slots of one window's length.
    """
    span = window_seconds * 1_000_000
    rows = requests.select("client", "event_id", F.unix_micros("ts").alias("t")).withColumn("slot", F.floor(F.col("t") / span).cast("long"))
    rows = cut(rows.filter("client IS NOT NULL AND t IS NOT NULL"))
    first = F.min(F.struct("t", "event_id")).alias("first")
    slots = cut(rows.groupBy("client", "slot").agg(first))
    by_slot = Window.partitionBy("client").orderBy("slot")
    ahead = slots.select("client", "slot", *[F.lead(F.struct("slot", "first"), k).over(by_slot).alias(f"lead{k}") for k in (1, 2)])
    later = F.when(F.col("lead1.slot") > F.col("slot") + 1, F.col("lead1.first")).otherwise(F.col("lead2.first"))
    beyond = cut(ahead.select("client", "slot", later.alias("later")))  # first request two slots on, or more
    # in the next slot: the last row met when its requests and the ends of windows are read backwards
    ends = rows.select("client", (F.col("slot") + 1).alias("slot"), (F.col("t") + span).alias("at"), F.lit(0).alias("real"), F.struct("t", "event_id").alias("of"))
    real = rows.select("client", "slot", F.col("t").alias("at"), F.lit(1).alias("real"), F.struct("t", "event_id").alias("of"))
    backwards = Window.partitionBy("client", "slot").orderBy(F.desc("at"), F.desc("real"), F.desc("of")).rowsBetween(Window.unboundedPreceding, 0)
    met = ends.unionByName(real).withColumn("near", F.last(F.when(F.col("real") == 1, F.col("of")), ignorenulls=True).over(backwards)).filter("real = 0")
    jumps = met.withColumn("slot", F.col("slot") - 1).join(beyond, ["client", "slot"], "left")
    jumps = cut(jumps.select("client", F.col("of").alias("a"), F.coalesce("near", "later").alias("b")).filter("b IS NOT NULL"))
    reached = cut(slots.groupBy("client").agg(F.min("first").alias("a")))
    while True:
        more = reached.join(jumps, ["client", "a"]).select("client", F.col("b").alias("a"))
        if more.isEmpty():
            return reached.select("client", "a.event_id", "a.t")
        reached = cut(reached.unionByName(more).distinct())
        onward = jumps.select("client", F.col("a").alias("b"), F.col("b").alias("c"))
        jumps = cut(jumps.join(onward, ["client", "b"]).select("client", "a", F.col("c").alias("b")))


def limited_requests(requests: DataFrame, limit: int = fv.REQUESTS_PER_WINDOW, window_seconds: int = 60) -> DataFrame:
    """Batch twin of ``limit_clients``; requests without a client or a time are left out."""
    span = window_seconds * 1_000_000
    starts = window_starts(requests, window_seconds).select("client", F.col("t").alias("start"))
    slot = F.floor(F.col("start") / span).cast("long")
    held = starts.select("client", "start", F.explode(F.array(slot, slot + 1)).alias("slot"))  # a window reaches into one more slot
    held = cut(held.groupBy("client", "slot").agg(F.sort_array(F.collect_set("start")).alias("starts")))  # two at most
    rows = requests.select("client", "event_id", "ts", F.unix_micros("ts").alias("t")).withColumn("slot", F.floor(F.col("t") / span).cast("long"))
    own = F.element_at(F.filter("starts", lambda s: s <= F.col("t")), -1)
    placed = cut(rows.join(held, ["client", "slot"]).select("client", "event_id", "ts", own.alias("start")))
    rank = F.row_number().over(Window.partitionBy("client", "start").orderBy("ts", "event_id"))
    served = placed.withColumn("_rank", rank).filter(F.col("_rank") <= F.lit(limit)).select("client", "event_id", F.lit(False).alias("refused"))
    judged = placed.join(served, ["client", "event_id"], "left")
    return judged.select("client", "event_id", "ts", F.timestamp_micros("start").alias("window_start"), F.coalesce("refused", F.lit(True)).alias("refused"))
