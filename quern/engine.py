"""The engine: named maps, and the ways to ask about them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from fnmatch import translate as glob_pattern
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.predicates import compile_predicate
from quern.functions.text import all_text, words
from quern.operators import search as s
from quern.operators.replicated import journal_read
from quern.plans.query import Page, QuerySpec, page, plan
from quern.sources.tables import MapSchema, inferred
from quern.streaming.live import LiveQuery


class UnknownMap(LookupError):
    """No map of this name is registered."""


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.maps: dict[str, DataFrame] = {}
        self.schemas: dict[str, MapSchema] = {}
        self.policies: list[tuple[re.Pattern, bool, Column]] = []

    def register_map(self, name: str, df: DataFrame, schema: MapSchema | None = None, view: str | None = None) -> None:
        """A map by name; SQL sees it as the view (by default of the same name)."""
        self.maps[name] = df
        if schema:
            self.schemas[name] = schema
        df.createOrReplaceTempView(view or name)

    def allow(self, maps: str, condition: Column | None = None, deny: bool = False) -> None:
        """A policy on the maps that a glob names: rows under the condition are allowed, or denied."""
        self.policies.append((re.compile(glob_pattern(maps)), deny, F.lit(True) if condition is None else condition))

    def map(self, name: str) -> DataFrame:
        """The map's rows under its policies; without any, all."""
        if name not in self.maps:
            raise UnknownMap(name)
        df, own = self.maps[name], [(deny, c) for p, deny, c in self.policies if p.match(name)]
        if own:
            yes, no = F.lit(False), F.lit(False)
            for deny, c in own:
                yes, no = (yes, no | F.coalesce(c, F.lit(False))) if deny else (yes | F.coalesce(c, F.lit(False)), no)
            df = df.filter(yes & ~no)
        return df

    def list_maps(self) -> list[str]:
        return sorted(self.maps)

    def query(self, name: str, spec: QuerySpec, now_millis: int | None = None) -> Page:
        return page(self.map(name), spec, int(time.time() * 1000) if now_millis is None else now_millis)

    def frame(self, name: str, spec: QuerySpec) -> DataFrame:
        return plan(self.map(name), spec)

    def count(self, name: str, predicate=None) -> int:
        df = self.map(name)
        return (df.filter(compile_predicate(predicate)) if predicate else df).count()

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text)

    def search(self, name: str, fields: dict[str, float] | None, query: str, limit: int = 10, min_score: float = 0.0) -> DataFrame:
        """_key, score; without fields all strings of a row are one text."""
        df, terms = self.map(name), query.lower().split()
        if fields is None:
            return s.bm25(df, "_key", words(all_text(df.drop("_key"))), terms, min_score).select("_key", "score").orderBy(F.desc("score"), "_key").limit(limit)
        return s.search(df, "_key", fields, terms, limit, min_score)

    def vector_search(
        self, name: str, column: str, query: Sequence[float], k: int = 10, metric: str = "cosine", min_score: float | None = None, predicate=None, post_filter: bool = False,
    ) -> DataFrame:
        condition = None if predicate is None else compile_predicate(predicate)
        return s.nearest(self.map(name), "_key", column, query, k, metric, min_score, condition, post_filter)

    def hybrid_search(self, name: str, predicate=None, text: tuple[str, str] | None = None, vector: tuple[str, Sequence[float]] | None = None, k: int = 10, min_score: float = 0.0) -> DataFrame:
        """_key, score, and the rows' values: exact matches (all of rank 1), full text and vectors, fused by rank."""
        df = self.map(name)
        exact = None if predicate is None else compile_predicate(predicate)
        best = s.hybrid(df, "_key", exact, (text[0], text[1].lower().split()) if text else None, vector, k, min_score)
        return best.join(df, "_key")

    def journal_read(self, name: str, start: int = 0, limit: int = 100, kind: str | None = None, map_name: str | None = None) -> tuple[list, bool]:
        """Events of a journal (a map with sequence, type, key, value) from a sequence on, and whether there are more."""
        return journal_read(self.map(name), start, limit, kind, map_name)

    def subscribe(self, stream: DataFrame, query: Callable[[DataFrame], DataFrame], schema: str, folder: str, checkpoint: str, **trigger):
        """Start a standing query over a stream of change records; its events go to folder/events."""
        return LiveQuery(self.spark, query, schema, folder).start(stream, checkpoint, **trigger)

    def describe(self, name: str) -> DataFrame:
        df = self.map(name)
        return inferred(df, df.columns)

    def explain(self, name: str, spec: QuerySpec) -> dict:
        """Rows, matches, selectivity and advice."""
        df = self.map(name)
        c = compile_predicate(spec.predicate) if spec.predicate else F.lit(True)
        n, m = df.agg(F.count("*"), F.count(F.when(c, 1))).first()
        share = m / n if n else 0.0
        advice = []
        if spec.predicate is None and n > 100:
            advice.append("add a filter")
        elif share < 0.1:
            advice.append("sort or partition the table by the filter's columns")
        elif share > 0.5 and n > 1000:
            advice.append("the filter keeps most rows: project fewer columns")
        return {"total": n, "matching": m, "selectivity": share, "advice": advice}
