"""Structured queries: filter, aggregate, sort, keyset pages, projection."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.predicates import compile_predicate, where

CURSOR_MILLIS, SEARCH_CURSOR_MILLIS = 600_000, 300_000


@dataclass(frozen=True)
class QuerySpec:
    predicate: Mapping[str, Any] | None = None
    where: Mapping[str, Any] | None = None
    group_by: Sequence[str] = ()
    aggregations: Sequence[tuple[str, str | None]] = ()  # (function, column)
    sort: Sequence[tuple[str, str]] = ()  # (column, "asc" or "desc")
    limit: int | None = None
    offset: int | None = None
    cursor: str | None = None
    fields: Sequence[str] | None = None
    context: Mapping[str, Any] = field(default_factory=dict)


@dataclass
class Page:
    rows: list[dict]
    has_more: bool
    next_cursor: str | None
    cursor_status: str


def condition(spec: QuerySpec) -> Column | None:
    if spec.predicate and spec.where:
        raise ValueError("give predicate or where, not both")
    if spec.predicate:
        return compile_predicate(spec.predicate, spec.context)
    return where(spec.where) if spec.where else None


def aggregate(df: DataFrame, by: Sequence[str], specs: Sequence[tuple[str, str | None]]) -> DataFrame:
    """Groups with __count and __function_column of each specification that has a column."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = [F.count(F.lit(1)).alias("__count")]
    for name, c in specs:
        if name == "count" or c is None:
            continue
        x = F.col(c) if isinstance(kinds[c], T.NumericType) else F.lit(None).cast("double")
        out.append({"sum": F.coalesce(F.sum(x), F.lit(0)), "min": F.min(x), "max": F.max(x), "avg": F.avg(x)}[name].alias(f"__{name}_{c}"))
    return df.groupBy(*by).agg(*out)


def group_key(by: Sequence[str]) -> Column:
    """A text that is different for different groups: each value with its length, N for null."""
    text = lambda c: F.col(c).cast("string")
    return F.concat(*[F.when(F.col(c).isNull(), "N").otherwise(F.concat(F.lit("S"), F.octet_length(text(c)), F.lit(":"), text(c))) for c in by])


def order(sort: Sequence[tuple[str, str]], tie: str | None = "_key") -> list[Column]:
    """Nulls last both ways; ties by the key, ascending."""
    out = [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in sort]
    return out + ([F.col(tie).asc()] if tie else [])


def after(sort: Sequence[tuple[str, str]], values: Sequence[Any], key: str, tie: str = "_key") -> Column:
    """Rows strictly after the place of ``values`` and ``key`` in the order."""
    same, out = F.lit(True), F.lit(False)
    for (c, d), v in zip(sort, values, strict=True):
        x = F.col(c)
        if v is not None:
            out = out | (same & (F.coalesce(x < v if d == "desc" else x > v, F.lit(False)) | x.isNull()))
        same = same & x.eqNullSafe(F.lit(v))
    return out | (same & (F.col(tie) > key))


def shape_hash(spec: QuerySpec) -> str:
    shape = [spec.predicate, spec.where, list(spec.group_by), list(spec.aggregations), list(spec.sort)]
    return hashlib.sha256(json.dumps(shape, sort_keys=True, default=str).encode()).hexdigest()[:16]


def encode_cursor(spec: QuerySpec, values: Sequence[Any], key: str, now_millis: int) -> str:
    body = json.dumps({"v": list(values), "k": key, "h": shape_hash(spec), "t": now_millis}, default=str)
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_cursor(spec: QuerySpec, now_millis: int) -> tuple[dict | None, str]:
    """The cursor's content and its status: none, expired, invalid or valid."""
    if not spec.cursor:
        return None, "none"
    try:
        c = json.loads(base64.urlsafe_b64decode(spec.cursor + "=" * (-len(spec.cursor) % 4)))
        c["v"], c["k"], c["h"], age = c["v"], c["k"], c["h"], now_millis - c["t"]
    except (ValueError, KeyError, TypeError):
        return None, "invalid"
    if age > CURSOR_MILLIS:
        return None, "expired"
    return (c, "valid") if c["h"] == shape_hash(spec) and len(c["v"]) == len(spec.sort) else (None, "invalid")


def encode_search_cursor(query: str, score: float, key: Any, now_millis: int) -> str:
    """The place of a hit in the results of a search: its score and key."""
    body = json.dumps({"s": score, "k": key, "q": hashlib.sha256(query.encode()).hexdigest()[:16], "t": now_millis})
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_search_cursor(cursor: str | None, query: str, now_millis: int) -> tuple[tuple[float, Any] | None, str]:
    """(score, key) or None, and the cursor's status: none, expired, invalid or valid."""
    if not cursor:
        return None, "none"
    try:
        c = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        place, same, age = (float(c["s"]), c["k"]), c["q"] == hashlib.sha256(query.encode()).hexdigest()[:16], now_millis - c["t"]
    except (ValueError, KeyError, TypeError):
        return None, "invalid"
    if age > SEARCH_CURSOR_MILLIS:
        return None, "expired"
    return (place, "valid") if same else (None, "invalid")


def furthest(places: Sequence[tuple[float, Any]]) -> tuple[float, Any]:
    """Of the places that several partial results ended at, the one furthest down (score descending, key ascending)."""
    lowest = min(score for score, _ in places)
    return lowest, max(key for score, key in places if score == lowest)


def rows(df: DataFrame, spec: QuerySpec, cursor: dict | None = None) -> DataFrame:
    """All of the query but limit and projection. df has a _key unless the query groups."""
    c = condition(spec)
    out = df if c is None else df.filter(c)
    if spec.group_by:
        out = aggregate(out, spec.group_by, spec.aggregations).withColumn("_key", group_key(spec.group_by))
    return out.filter(after(spec.sort, cursor["v"], cursor["k"])) if cursor else out


def plan(df: DataFrame, spec: QuerySpec, extra: int = 0) -> DataFrame:
    """The query as a DataFrame; extra rows beyond the limit tell whether there are more."""
    out = rows(df, spec)
    if spec.sort or spec.limit is not None:
        out = out.orderBy(*order(spec.sort))
    if spec.offset:
        out = out.offset(spec.offset)
    if spec.limit is not None:
        out = out.limit(spec.limit + extra)
    return project(out, spec.fields)


def project(df: DataFrame, fields: Sequence[str] | None) -> DataFrame:
    """The named columns that exist."""
    return df if fields is None else df.select(*[f for f in fields if f in df.columns])


def page(df: DataFrame, spec: QuerySpec, now_millis: int, most: int = 10_000) -> Page:
    """One page, of ``most`` rows at most. The cursor is taken before the projection."""
    cursor, status = decode_cursor(spec, now_millis)
    limit = min(spec.limit if spec.limit is not None else most, most)
    out = rows(df, spec, cursor).orderBy(*order(spec.sort))
    if spec.offset:
        out = out.offset(spec.offset)
    got = [r.asDict() for r in out.limit(limit + 1).collect()]
    more, got = len(got) > limit, got[:limit]
    following = encode_cursor(spec, [got[-1][c] for c, _ in spec.sort], got[-1]["_key"], now_millis) if more and got and spec.sort else None
    shown = got if spec.fields is None else [{f: r[f] for f in spec.fields if f in r} for r in got]
    return Page(shown, more, following, status)
