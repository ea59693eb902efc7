"""A quota gate over a stream of calls: each is charged or blocked by what its account has used in its month, as it comes."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Calls of a month that each plan includes, None being without end, and the plan of accounts that name none.
QUOTAS = {"free": 10, "pro": 100, "team": 500, "enterprise": None}
DEFAULT_PLAN = "free"
VERDICTS = "account string, period string, event_id long, ts timestamp, plan string, verdict string, used long, quota long"
#: Keys that a stream's state needs a store for that keeps timers.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class QuotaGate(StatefulProcessor):
    """One number for each account and month: the calls charged so far. It goes when the watermark is past the month."""

    def __init__(self, quotas: dict[str, int | None]) -> None:
        self.quotas = quotas

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.charged = handle.getValueState("charged", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["ts", "event_id"], kind="stable")
        if self.charged.exists():
            used = self.charged.get()[0]
        else:
            used = 0
            self.handle.registerTimer(month_end(key[1]))
        quota = batch["plan"].map(self.quotas).astype("Int64")  # an account that changes its plan is judged by the plan of the call
        open_ = quota.isna()
        if quota.nunique(dropna=False) == 1:  # the usual case: the calls up to the quota are charged
            good = open_ | (pd.Series(range(len(batch)), index=batch.index) + used < quota.fillna(0))
            before = used + good.cumsum() - good
        else:
            good, before = [], []
            for q in quota:
                ok = q is pd.NA or used + sum(good) < q
                before.append(used + sum(good))
                good.append(ok)
            good, before = pd.Series(good, index=batch.index), pd.Series(before, index=batch.index)
        self.charged.update((int(used + good.sum()),))
        out = batch.assign(account=key[0], period=key[1], verdict=good.map({True: "CHARGED", False: "BLOCKED"}), used=before.astype("int64"), quota=quota)
        yield out[["account", "period", "event_id", "ts", "plan", "verdict", "used", "quota"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.charged.clear()
        yield from ()

    def close(self) -> None:
        pass


def month_end(period: str) -> int:
    """Milliseconds at which a month, yyyy-MM, is over."""
    year, month = map(int, period.split("-"))
    return int(datetime(year + month // 12, month % 12 + 1, 1, tzinfo=timezone.utc).timestamp() * 1000)


def gated(calls: DataFrame, quotas: dict[str, int | None] = QUOTAS, late: str = "1 day") -> DataFrame:
    """A stream of calls (account, plan, event_id, ts) with a verdict for each: account, period (the month), event_id, ts, plan,
    verdict CHARGED or BLOCKED, used (charged before it) and quota (null: without end).

    An account's calls are judged in the order of (ts, event_id) within a batch, and batch after batch. Unknown and null plans are
    DEFAULT_PLAN; null accounts are one account; calls without a time belong to no month and are left out. Calls that are later than `late` are left out, as in every stream with a watermark.
    State is one number for each account and month, and is dropped when the watermark passes the month's end. A task holds the calls
    that one account makes in one month within one batch.
    """
    known = F.col("plan").isin(list(quotas))
    rows = calls.select(F.coalesce(F.col("account").cast("string"), F.lit("")).alias("account"), F.when(known, F.col("plan")).otherwise(DEFAULT_PLAN).alias("plan"), "event_id", F.col("ts").cast("timestamp").alias("ts")).where("ts IS NOT NULL")
    timed = rows.withWatermark("ts", late).withColumn("period", F.date_format("ts", "yyyy-MM"))
    return timed.groupBy("account", "period").transformWithStateInPandas(QuotaGate(quotas), VERDICTS, "Append", "EventTime")


def run_gate(spark: SparkSession, calls: DataFrame, out: str, quotas: dict[str, int | None] = QUOTAS, late: str = "1 day") -> DataFrame:
    """Judges all calls that a stream has now and returns all verdicts so far, which stand as Parquet under out.

    The stream's place and state stand there too: a run that ends, or is lost, goes on where its last whole batch ended, and no
    verdict is written twice.
    """
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        stream = gated(calls, quotas, late).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}/state")
        stream.trigger(availableNow=True).start(f"{out}/verdicts").awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(VERDICTS).parquet(f"{out}/verdicts")
