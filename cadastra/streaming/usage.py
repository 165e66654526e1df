"""Stateful reads of the request stream: rate limits, usage windows, first-seen ids, file arrival.

``limit_rows`` is the rule itself, over one client's requests in time order; the streaming operator keeps its state per
client in ``transformWithStateInPandas`` and the batch form applies it per client, so both give the same verdicts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cadastra.runtime import ship_package


@dataclass(frozen=True)
class Tier:
    per_minute: int
    per_hour: int
    burst: int


#: Requests allowed to each tier; a client without one is anonymous.
TIERS = {"internal": Tier(1000, 50_000, 100), "premium": Tier(500, 20_000, 50), "standard": Tier(100, 5000, 20), "anonymous": Tier(500, 10_000, 50)}
#: tokens, last request, minute, requests in it, hour, requests in it.
START = (-1.0, 0.0, -1, 0, -1, 0)
VERDICTS = "client long, event_id long, allowed boolean, reason string"


def limit_rows(state: tuple, tier: Tier, seconds: list[float]) -> tuple[tuple, list[str]]:
    """State after the requests, and for each '' or what stopped it: minute, then hour, then burst."""
    tokens, last, minute, in_minute, hour, in_hour = state
    out = []
    for now in seconds:
        tokens = float(tier.burst) if tokens < 0 else min(float(tier.burst), tokens + (now - last) * tier.per_minute / 60)
        last = now
        if minute != now // 60:
            minute, in_minute = int(now // 60), 0
        if hour != now // 3600:
            hour, in_hour = int(now // 3600), 0
        if in_minute >= tier.per_minute:
            out.append("minute")
        elif in_hour >= tier.per_hour:
            out.append("hour")
        elif tokens < 1:
            out.append("burst")
        else:
            tokens, in_minute, in_hour = tokens - 1, in_minute + 1, in_hour + 1
            out.append("")
    return (tokens, last, minute, in_minute, hour, in_hour), out


def _verdicts(client: int, rows: pd.DataFrame, state: tuple, tiers: dict[str, Tier]) -> tuple[tuple, pd.DataFrame]:
    rows = rows.sort_values(["ts", "event_id"])
    name = rows["tier"].iloc[0]
    tier = tiers.get("anonymous" if pd.isna(name) else name, tiers["standard"])
    state, reasons = limit_rows(state, tier, (rows["ts"].astype("int64") / 10 ** {"ns": 9, "us": 6, "ms": 3}[rows["ts"].dt.unit]).tolist())
    return state, pd.DataFrame({"client": client, "event_id": rows["event_id"].to_numpy(), "allowed": [not r for r in reasons], "reason": reasons})


def rate_limits(requests: DataFrame, tiers: dict[str, Tier] | None = None) -> DataFrame:
    """Batch form. ``requests``: client, event_id, tier, ts."""
    ship_package(requests.sparkSession)
    rules = tiers or TIERS

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _verdicts(int(key[0]), rows, START, rules)[1]

    return requests.select("client", "event_id", "tier", "ts").groupBy("client").applyInPandas(run, VERDICTS)


class Limiter(StatefulProcessor):
    def __init__(self, tiers: dict[str, Tier] | None = None) -> None:
        self.tiers = tiers or TIERS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, last double, minute long, in_minute long, hour long, in_hour long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = tuple(self.state.get()) if self.state.exists() else START
        after, out = _verdicts(int(key[0]), pd.concat(list(rows)), before, self.tiers)
        self.state.update(after)
        yield out

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, tiers: dict[str, Tier] | None = None) -> DataFrame:
    """Streaming form; needs the RocksDB state store. Requests of one client must arrive in time order across batches."""
    ship_package(requests.sparkSession)
    # the process that prepares the processor on the driver doesn't load shipped archives: send the code itself
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return requests.select("client", "event_id", "tier", "ts").groupBy("client").transformWithStateInPandas(Limiter(tiers), VERDICTS, "append", "none")


def usage_windows(requests: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests, errors and mean time of each endpoint and window; rows later than ``late`` are dropped by the watermark."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    out = timed.groupBy(F.window("ts", length).alias("w"), "endpoint").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.round(F.avg("ms"), 4).alias("avg_ms"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "endpoint", "requests", "errors", "avg_ms")


def sessions(requests: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a client: requests no more than ``gap`` apart (an extension of what the registry records)."""
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", gap) if timed.isStreaming else timed
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "client").agg(F.count(F.lit(1)).alias("requests"))
    return out.select("client", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "requests")


def first_seen(rows: DataFrame, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Rows whose key hasn't been seen: within the watermark in a stream, at all in a batch."""
    if rows.isStreaming:
        return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])
