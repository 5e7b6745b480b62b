"""Replicated state from change logs: registers, sets, counters, journals, digests."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CLOCK = ("millis", "counter", "node_id")


def clock(*names: str) -> Column:
    """A hybrid logical clock: ordered by millis, then counter, then node."""
    return F.struct(*[F.col(n).alias(c) for n, c in zip(names or CLOCK, CLOCK, strict=True)])


def format_clock(at: Column) -> Column:
    return F.concat_ws(":", at["millis"].cast("string"), at["counter"].cast("string"), at["node_id"])


def parse_clock(text: Column) -> Column:
    """millis:counter:node, where the node may hold colons; null if it isn't that."""
    part = lambda i: F.regexp_extract(text, r"^(\d+):(\d+):(.*)$", i)
    return F.when(text.rlike(r"^\d+:\d+:"), F.struct(part(1).cast("long").alias("millis"), part(2).cast("long").alias("counter"), part(3).alias("node_id")))


@dataclass
class Clock:
    """Makes clock values that never go back: (millis, counter, node)."""

    node: str
    wall: Callable[[], int]
    strict: bool = False
    most_drift: int = 60_000
    at: tuple[int, int] = field(default=(0, 0))

    def now(self) -> tuple[int, int, str]:
        t = self.wall()
        self.at = (t, 0) if t > self.at[0] else self._next(self.at[0], self.at[1])
        return (*self.at, self.node)

    def update(self, millis: int, counter: int) -> None:
        """Takes a remote value in, so that the next one of this clock is greater; strict: one too far ahead is an error."""
        t = self.wall()
        if self.strict and millis - t > self.most_drift:
            raise ValueError(f"the remote clock is {millis - t} ms ahead")
        held = max((m, c) for m, c in (self.at, (millis, counter)))
        self.at = (t, 0) if t > held[0] else self._next(*held)

    @staticmethod
    def _next(millis: int, counter: int) -> tuple[int, int]:
        return (millis, counter + 1) if counter < 2**32 - 1 else (millis + 1, 0)


def last_write(log: DataFrame, key: Sequence[str], values: Sequence[str], at: Column | None = None) -> DataFrame:
    """The values of each key's newest record. Partial maxima are made before the shuffle."""
    newest = log.groupBy(*key).agg(F.max_by(F.struct(*values), at if at is not None else clock()).alias("v"))
    return newest.select(*key, *[F.col(f"v.{v}").alias(v) for v in values])


def visible(state: DataFrame, deleted: str, millis: str, ttl: str, now_millis: int) -> DataFrame:
    """Without tombstones and expired records."""
    return state.filter(~F.col(deleted) & (F.col(ttl).isNull() | (F.col(millis) + F.col(ttl) >= now_millis)))


def without_old_tombstones(state: DataFrame, deleted: str, millis: str, watermark: int) -> DataFrame:
    return state.filter(~(F.col(deleted) & (F.col(millis) < watermark)))


def merged(resident: DataFrame, durable: DataFrame, key: str, at: Column) -> DataFrame:
    """Both sources, the newest of a key; the resident one in ties."""
    both = resident.withColumn("__r", F.lit(1)).unionByName(durable.withColumn("__r", F.lit(0)))
    names = [c for c in resident.columns if c != key]
    return last_write(both, [key], names, F.struct(at, "__r"))


def observed_set(adds: DataFrame, tombstones: DataFrame, key: str, tag: str, value: str, at: Column | None = None) -> DataFrame:
    """key, values: values of tags that no tombstone removes (an observed-remove set); of records with one tag the newest counts."""
    newest = adds.groupBy(tag).agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), at if at is not None else clock()).alias("x"))
    live = newest.join(tombstones.select(tag).distinct(), tag, "left_anti")
    return live.groupBy(F.col("x.k").alias(key)).agg(F.sort_array(F.collect_set("x.v")).alias("values"))


def tombstones_for(adds: DataFrame, value: str, removed) -> DataFrame:
    """The tags observed for an equal value."""
    return adds.filter(F.col(value) == removed).select("tag").distinct()


def counter(rows: DataFrame, name: str, node: str, up: str, down: str) -> DataFrame:
    """name, value: per node the greatest of each sum, then their difference."""
    per = rows.groupBy(name, node).agg(F.max(up).alias("p"), F.max(down).alias("n"))
    return per.groupBy(name).agg((F.sum("p") - F.sum("n")).alias("value"))


#: Ways to resolve concurrent values: an aggregate over a key's records.
RESOLVERS = {
    "LAST_WRITE_WINS": lambda v, at: F.max_by(v, at),
    "FIRST_WRITE_WINS": lambda v, at: F.min_by(v, at),
    "NUMERIC_MIN": lambda v, at: F.min(v),
    "NUMERIC_MAX": lambda v, at: F.max(v),
    "NON_NEGATIVE": lambda v, at: F.max_by(v, F.when(v >= 0, at)),
    "ARRAY_UNION": lambda v, at: F.sort_array(F.array_distinct(F.flatten(F.collect_list(v)))),
    "IMMUTABLE": lambda v, at: F.min_by(v, at),
}


def resolve(log: DataFrame, key: str, value: str, how: str, at: Column, owner: str | None = None, author: str | None = None, version: str | None = None) -> DataFrame:
    """key, value.

    SERVER_ONLY takes writes by "server" or "server:..."; OWNER_ONLY takes the first write, and after it those by the
    owner that the value then held names (null: by anyone); VERSION_INCREMENT takes writes whose version is one more than
    that of the value held (at first 0). These two are decided record by record in the order of the clock.
    """
    if how == "SERVER_ONLY":
        log, how = log.filter((F.col(author) == "server") | F.col(author).startswith("server:")), "LAST_WRITE_WINS"
    elif how == "OWNER_ONLY":
        return folded(log, key, value, at, F.col(owner), F.col(author), lambda held, first, o, a: first or held is None or a == held)
    elif how == "VERSION_INCREMENT":
        return folded(log, key, value, at, F.col(version), F.lit(None), lambda held, first, v, _: v == (0 if first or held is None else held) + 1)
    return log.groupBy(key).agg(RESOLVERS[how](F.col(value), at).alias(value))


def folded(log: DataFrame, key: str, value: str, at: Column, mark: Column, author: Column, takes: Callable) -> DataFrame:
    """key, value after each key's records in order, of which ``takes(mark held, none held yet, mark, author)`` tells the accepted ones.

    Records stream through a task sorted by key and clock, so that a key of any size takes the memory of one record.
    """
    rows = log.select(key, at.alias("__at"), F.col(value).alias(value), mark.alias("__mark"), author.alias("__author"))
    schema = T.StructType([log.schema[key], log.schema[value]])

    def run(batches):
        here, first, held, out = None, True, None, None
        for b in batches:
            done = []
            for k, v, m, a in zip(*(b.column(c).to_pylist() for c in (key, value, "__mark", "__author")), strict=True):
                if here is None or k != here[0]:
                    if here is not None and not first:
                        done.append((here[0], out))
                    here, first, held, out = (k,), True, None, None
                if takes(held, first, m, a):
                    first, held, out = False, m, v
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip((key, value), x)) for x in done], to_arrow_schema(schema))
        if here is not None and not first:
            yield pa.RecordBatch.from_pylist([{key: here[0], value: out}], to_arrow_schema(schema))

    return rows.repartition(key).sortWithinPartitions(key, "__at").select(key, value, "__mark", "__author").mapInArrow(run, schema)


def deep_merge(log: DataFrame, key: str, value: str, at: Column) -> DataFrame:
    """key, value: of maps, the newest entry for each map key."""
    entries = log.select(key, at.alias("__at"), F.explode(value).alias("k", "v"))
    newest = entries.groupBy(key, "k").agg(F.max_by("v", "__at").alias("v"))
    return newest.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(value))


def _put(v: Column, more: Column) -> Column:
    """A map with entries added or replaced; null is an empty map."""
    return F.coalesce(F.map_concat(F.map_filter(v, lambda k, _: ~F.array_contains(F.map_keys(more), k)), more), more)


def processed(v: Column, name: str, *args) -> Column:
    """The value after an entry processor."""
    a = [x if isinstance(x, Column) else F.lit(x) for x in args]
    steps = {
        "INCREMENT": lambda: F.coalesce(v, F.lit(0)) + a[0],
        "DECREMENT": lambda: F.coalesce(v, F.lit(0)) - a[0],
        "DECREMENT_FLOOR": lambda: F.greatest(F.coalesce(v, F.lit(0)) - a[0], F.lit(0)),
        "MULTIPLY": lambda: F.coalesce(v, F.lit(1)) * a[0],
        "PUT_IF_ABSENT": lambda: F.coalesce(v, a[0]),
        "REPLACE": lambda: F.when(v.isNotNull(), a[0]),
        "REPLACE_IF_EQUALS": lambda: F.when(v.eqNullSafe(a[0]), a[1]).otherwise(v),
        "DELETE_IF_EQUALS": lambda: F.when(~v.eqNullSafe(a[0]), v),
        "ARRAY_PUSH": lambda: F.array_append(F.coalesce(v, F.array().cast("array<string>")), a[0]),
        "ARRAY_POP": lambda: F.coalesce(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.array().cast("array<string>")),
        "ARRAY_REMOVE": lambda: F.coalesce(F.filter(v, lambda _, i: i + 1 != F.array_position(v, a[0])), F.array().cast("array<string>")),
        "SET_PROPERTY": lambda: _put(v, F.create_map(a[0], a[1])),
        "DELETE_PROPERTY": lambda: F.map_filter(v, lambda k, _: k != a[0]),
        "GET": lambda: v,
        # Maps of strings: the version under "version" must be the expected one, and goes up by one.
        "CONDITIONAL_UPDATE": lambda: F.when(v["version"] == a[0].cast("string"), _put(_put(v, a[1]), F.create_map(F.lit("version"), (a[0] + 1).cast("string")))).otherwise(v),
        "MERGE": lambda: _put(v, a[0]),
    }
    return steps[name]()


def journal(log: DataFrame, key: str, value: str, deleted: str, sequence: str) -> DataFrame:
    """sequence, type (PUT, UPDATE or DELETE), key, value, previous value."""
    w = Window.partitionBy(key).orderBy(sequence)
    was, gone = F.lag(value).over(w), F.coalesce(F.lag(deleted).over(w), F.lit(True))
    kind = F.when(F.col(deleted), "DELETE").when(gone, "PUT").otherwise("UPDATE")
    return log.select(F.col(sequence).alias("sequence"), kind.alias("type"), F.col(key).alias("key"), F.when(~F.col(deleted), F.col(value)).alias("value"), F.when(~gone, was).alias("previous"))


def journal_page(events: DataFrame, start: int, limit: int, kind: str | None = None, map_name: str | None = None) -> DataFrame:
    """Events from a sequence on, of one type or map where given."""
    held = events.filter(F.col("sequence") >= start)
    held = held if kind is None else held.filter(F.col("type") == kind)
    return (held if map_name is None else held.filter(F.col("map") == map_name)).orderBy("sequence").limit(limit)


def journal_read(events: DataFrame, start: int, limit: int, kind: str | None = None, map_name: str | None = None) -> tuple[list, bool]:
    """The page's rows and whether there are more."""
    got = journal_page(events, start, limit + 1, kind, map_name).collect()
    return got[:limit], len(got) > limit


def journal_ring(events: DataFrame, capacity: int) -> DataFrame:
    """The newest events by sequence; older ones are evicted."""
    return events.orderBy(F.desc("sequence")).limit(capacity)


def replayed(events: DataFrame) -> DataFrame:
    """key, value: the state that the events lead to."""
    last = events.groupBy("key").agg(F.max_by(F.struct("type", "value"), "sequence").alias("v"))
    return last.filter("v.type <> 'DELETE'").select("key", "v.value")


def digest(state: DataFrame, key: str, at: Sequence[str], buckets: int = 256) -> DataFrame:
    """bucket, n, hash: sums of record hashes, to compare replicas with."""
    h = F.crc32(F.concat_ws("|", F.col(key).cast("string"), *[F.col(c).cast("string") for c in at]))
    return state.groupBy(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"), F.sum(h).alias("hash"))


def differing(left: DataFrame, right: DataFrame, key: str, at: Sequence[str], buckets: int = 256) -> DataFrame:
    """Keys that the replicas hold differently; only rows of differing buckets are compared."""
    a, b = digest(left, key, at, buckets), digest(right, key, at, buckets)
    off = a.join(b, "bucket", "full").filter(~a["hash"].eqNullSafe(b["hash"]) | ~a["n"].eqNullSafe(b["n"])).select("bucket")
    held = lambda d: d.select(key, F.struct(*at).alias("at"), F.pmod(F.crc32(F.col(key).cast("string")), F.lit(buckets)).alias("bucket")).join(off, "bucket", "left_semi").drop("bucket")
    x, y = held(left), held(right).withColumnRenamed("at", "other")
    return x.join(y, key, "full").filter(~F.col("at").eqNullSafe(F.col("other"))).select(key)
