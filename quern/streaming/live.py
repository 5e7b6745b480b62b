"""Live queries: what enters, changes and leaves a result as its table changes.

A micro-batch of changes is merged into the state by clock (older records than the
state's are dropped), the query is run over the state before and after, and the two
results are compared by key. State and events are tables in the checkpoint folder, one
version per batch, so that a batch that is run again gives the same events.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.replicated import last_write


def changes(before: DataFrame, after: DataFrame, key: str = "_key", tolerance: float | None = None) -> DataFrame:
    """key, change (ENTER, UPDATE or LEAVE) and the new values (null for LEAVE).

    tolerance: a row whose score moved by no more than this, and nothing else of it, isn't an update.
    """
    cols = [c for c in after.columns if c != key]
    old = before.select(key, F.struct(*cols).alias("__old"))
    new = after.select(key, F.struct(*cols).alias("__new"))
    both = old.join(new, key, "full").filter(~F.col("__old").eqNullSafe(F.col("__new")))
    if tolerance is not None:
        rest = [F.col(f"__old.{c}").eqNullSafe(F.col(f"__new.{c}")) for c in cols if c != "score"]
        near = F.abs(F.col("__old.score") - F.col("__new.score")) <= tolerance
        both = both.filter(~F.coalesce(reduce(lambda x, y: x & y, rest, near), F.lit(False)))
    change = F.when(F.col("__old").isNull(), "ENTER").when(F.col("__new").isNull(), "LEAVE").otherwise("UPDATE")
    return both.select(key, change.alias("change"), *[F.col(f"__new.{c}").alias(c) for c in cols])


def cleared(before: DataFrame, key: str = "_key") -> DataFrame:
    """The events of a map that is cleared: every member leaves."""
    return changes(before, before.filter("false"), key)


def latest_operations(batch: DataFrame, key: str, at: Column) -> DataFrame:
    """The last operation of each key in a batch; earlier ones have no effect of their own."""
    cols = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*cols), at).alias("v")).select(key, "v.*")


def applied(state: DataFrame, operations: DataFrame, key: str) -> DataFrame:
    """The state after operations (key, deleted, and the state's columns), one a key."""
    kept = state.join(operations.select(key), key, "left_anti")
    return kept.unionByName(operations.filter("not deleted").select(*state.columns))


def top(df: DataFrame, column: str, limit: int, key: str = "_key", descending: bool = False) -> DataFrame:
    by = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(by, key).limit(limit)


class LiveQuery:
    """A standing query over a stream of change records (key, clock columns, deleted, values)."""

    def __init__(self, spark: SparkSession, query: Callable[[DataFrame], DataFrame], schema: str, folder: str, clock: tuple[str, ...] = ("millis", "counter", "node_id"), key: str = "_key"):
        self.spark, self.query, self.schema, self.folder, self.clock, self.key = spark, query, schema, folder, clock, key

    def _state(self, version: int) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/state/{version}") if version >= 0 else empty

    def apply(self, batch: DataFrame, version: int) -> DataFrame:
        """The events of one batch; the state after it is written as ``version``."""
        values = [f.name for f in self._state(-1).schema.fields if f.name != self.key]
        before = self._state(version - 1)
        merged = last_write(before.unionByName(batch.select(before.columns)), [self.key], values, F.struct(*self.clock))
        merged.write.mode("overwrite").parquet(f"{self.folder}/state/{version}")
        shown = lambda s: self.query(s.filter("not deleted"))
        return changes(shown(before), shown(self._state(version)), self.key)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """Run on a stream; events go to folder/events/VERSION."""

        def each(batch: DataFrame, version: int) -> None:
            self.apply(batch, version).write.mode("overwrite").parquet(f"{self.folder}/events/{version}")

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, at: str, late: str, width: str, *by: str) -> DataFrame:
    """Counts per event-time window (an extension): works on streams and tables."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
