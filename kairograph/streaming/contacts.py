"""Structured Streaming over contacts ``from, to, ts``: counts by window, and Katz scores with state."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def contact_stream(spark: Any, path: str, schema: str, format: str = "parquet", per_trigger: int = 1) -> DataFrame:
    """A stream of files as they arrive."""
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", per_trigger).load(path)


def windowed_counts(contacts: DataFrame, window: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``window_start, contacts, senders`` in tumbling or sliding windows; later rows are dropped."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return contacts.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("contacts"), F.approx_count_distinct("from").alias("senders")).select(F.col("w.start").alias("window_start"), "contacts", "senders")


def windowed_degree(contacts: DataFrame, window: str, late: str = "10 minutes") -> DataFrame:
    """``window_start, node, contacts`` of every vertex."""
    ends = contacts.withWatermark("ts", late).select("ts", F.explode(F.array("from", "to")).alias("node"))
    return ends.groupBy(F.window("ts", window).alias("w"), "node").agg(F.count("*").alias("contacts")).select(F.col("w.start").alias("window_start"), "node", "contacts")


def stream_katz(contacts: DataFrame, beta: float = 0.1, decay: float = 0.0, late: str = "10 minutes") -> DataFrame:
    """``session, node, value``: Katz scores kept by session.

    An instant is applied only once the watermark has passed it, so all contacts
    of one instant read what was known before it, whatever order they came in.
    Contacts that are later than the watermark are dropped.
    """
    rows = contacts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("session", "from", "to", "ts", (F.unix_micros("ts") / 1e6).alias("t"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, scores, last, held = state.get if state.exists else ([], [], -math.inf, [])
        x, held = dict(zip(names, scores, strict=True)), [tuple(h) for h in held]
        for pdf in batches:
            held += [(float(t), a, b) for t, a, b in zip(pdf["t"], pdf["from"], pdf["to"], strict=True)]
        mark = state.getCurrentWatermarkMs() / 1000 if state.hasTimedOut or state.exists else -math.inf
        ready = sorted(h for h in held if h[0] <= mark)
        held = [h for h in held if h[0] > mark]
        changed = set()
        while ready:
            now = [h for h in ready if h[0] == ready[0][0]]
            ready = ready[len(now) :]
            if decay and last > -math.inf:
                x = {v: s * math.exp(-decay * (now[0][0] - last)) for v, s in x.items()}
            before, last = dict(x), now[0][0]
            for _, a, b in now:
                x[b] = x.get(b, 0.0) + beta * (before.get(a, 0.0) + 1)
                changed.add(b)
        state.update((list(x), list(x.values()), last, [list(h) for h in held]))
        if held:
            state.setTimeoutTimestamp(int(min(h[0] for h in held) * 1000) + 1 if min(h[0] for h in held) * 1000 > mark * 1000 else int(mark * 1000) + 1)
        yield pd.DataFrame({"session": key[0], "node": sorted(changed), "value": [x[v] for v in sorted(changed)]})

    kept = "names array<string>, scores array<double>, last double, held array<struct<t:double,a:string,b:string>>"
    return rows.groupBy("session").applyInPandasWithState(step, "session string, node string, value double", kept, "append", GroupStateTimeout.EventTimeTimeout)
