"""Ledgers as streams: every entry is chained to the one before it in its key, whatever batch that came in.

State is kept for each key: how many entries are chained, the order and the hash of the last one, and which claims were made. A
batch's entries of a key are chained in order; one that comes after a later one was chained is reported as late and left
unchained, never dropped. A key that gets nothing for some time is sealed once with its head, and goes on if more comes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.shipping import ship

#: Keyed state with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "`order` long, status string, seq long, line string, prev_hash string, first_claim boolean"


class Chain(StatefulProcessor):
    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "n long, last long, hash string")
        self.claims = handle.getMapState("claims", "claim string", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = sorted(((r.order, r.line, r.claim) for r in rows), key=lambda r: r[:2])
        # every look at the state is a round trip to Spark: one for the head, and one for each claim that an earlier batch may have made
        head = self.head.get()
        n, last, before = head if head is not None else (0, None, None)
        earlier, made = n > 0, set()
        for order, line, claim in new:
            if last is not None and order < last:
                yield self._row(key, order, "late", line=line)
                continue
            first = None
            if claim is not None:
                first = claim not in made and not (earlier and self.claims.containsKey((claim,)))
                made.add(claim)
                if first:
                    self.claims.updateValue((claim,), (n,))
            yield self._row(key, order, "chained", n, line, before, first)
            n, last, before = n + 1, order, hashlib.sha256(line.encode()).hexdigest()
        if n:
            self.head.update((n, last, before))
        if self.idle_ms is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head = self.head.get()
        if head is not None:
            n, last, before = head
            yield self._row(key, last, "sealed", n, None, before)

    def _row(self, key, order, status, seq=None, line=None, prev_hash=None, first=None) -> Row:
        return Row(key=key[0], order=order, status=status, seq=seq, line=line, prev_hash=prev_hash, first_claim=first)

    def close(self) -> None:
        pass


def chained(entries: DataFrame, by: str, order: str, line: Column, claim: Column, idle_ms: int | None = None) -> DataFrame:
    """by, order, status, seq, line, prev_hash, first_claim for each entry of a stream: seq counts from 0 in each key,
    prev_hash is the sha256 of the previous line; first_claim says whether an entry's claim (null: none) is the first of its kind
    in the key. status is chained, late, or sealed (a key's head after idle_ms without entries; seq is then how many there are).
    Entries of one batch that share an order go by line; null keys are left out, null orders and lines are -1 and empty.
    """
    from pyspark.sql import functions as F

    spark = ship(entries.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind = entries.schema[by].dataType.simpleString()
    rows = entries.filter(F.col(by).isNotNull()).select(F.col(by).alias("key"), F.coalesce(F.col(order).cast("long"), F.lit(-1)).alias("order"), F.coalesce(line, F.lit("")).alias("line"), claim.cast("string").alias("claim"))
    mode = "None" if idle_ms is None else "ProcessingTime"
    got = rows.groupBy("key").transformWithState(Chain(idle_ms), f"key {kind}, {SCHEMA}", "Append", mode)
    return got.withColumnRenamed("key", by)
