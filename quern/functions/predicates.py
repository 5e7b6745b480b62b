"""Predicate trees as Spark columns.

A predicate is a dict: ``{"op": ..., "attribute": ..., "value": ...}`` or, for and, or
and not, ``{"op": ..., "children": [...]}``. A leaf over a null is false, and so true under
a not. Leaves that no not stands above are left bare, so that they reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import words

Predicate = Mapping[str, Any]


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _like(c: Column, pattern: str) -> Column:
    return c.ilike(pattern.replace("\\", "\\\\"))


def _regex(c: Column, pattern: str) -> Column:
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return c.rlike(pattern)


def _between(c: Column, bounds, p: Predicate) -> Column:
    if len(bounds) != 2:
        return F.lit(False)
    low = c >= bounds[0] if p.get("from_inclusive", True) else c > bounds[0]
    return low & (c <= bounds[1] if p.get("to_inclusive", True) else c < bounds[1])


def _match(c: Column, text: str, p: Predicate) -> Column:
    """A word of the text stands in the column; all of them with operator "and"."""
    terms = _terms(text)
    if not terms:
        return F.lit(False)
    return F.size(F.array_except(_array(terms), words(c))) == 0 if p.get("operator") == "and" else F.arrays_overlap(words(c), _array(terms))


def _phrase(c: Column, text: str, p: Predicate) -> Column:
    return F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" ")).contains(f" {' '.join(_terms(text))} ")


def _terms(text: str) -> list[str]:
    """The words of a query, as ``words`` makes them of a column."""
    return [t for t in re.split(r"[\W_]+", text.lower()) if 2 <= len(t) <= 40]


#: Comparison and string tests by name; each takes the column, the value and the predicate.
LEAVES: dict[str, Callable[[Column, Any, Predicate], Column]] = {
    "eq": lambda c, v, p: c == v,
    "neq": lambda c, v, p: c != v,
    "gt": lambda c, v, p: c > v,
    "gte": lambda c, v, p: c >= v,
    "lt": lambda c, v, p: c < v,
    "lte": lambda c, v, p: c <= v,
    "like": lambda c, v, p: _like(c, v),
    "regex": lambda c, v, p: _regex(c, v),
    "in": lambda c, v, p: c.isin(list(v)),
    "notIn": lambda c, v, p: ~c.isin(list(v)),
    "between": lambda c, v, p: _between(c, v, p),
    "isNull": lambda c, v, p: c.isNull(),
    "isNotNull": lambda c, v, p: c.isNotNull(),
    "has": lambda c, v, p: c.isNotNull(),
    "hasElement": lambda c, v, p: F.array_contains(c, v),
    "containsAll": lambda c, v, p: F.size(F.array_except(_array(v), c)) == 0 if v else F.lit(True),
    "containsAny": lambda c, v, p: F.arrays_overlap(c, _array(v)) if v else F.lit(False),
    "textContains": lambda c, v, p: F.lower(c).contains(v.lower()),
    "textContainsAll": lambda c, v, p: reduce(lambda a, b: a & b, [F.lower(c).contains(x.lower()) for x in v], F.lit(True)),
    "textContainsAny": lambda c, v, p: reduce(lambda a, b: a | b, [F.lower(c).contains(x.lower()) for x in v], F.lit(False)),
    "startsWith": lambda c, v, p: c.startswith(v),
    "endsWith": lambda c, v, p: c.endswith(v),
    "match": _match,
    "matchPhrase": _phrase,
    "matchPrefix": lambda c, v, p: F.exists(words(c), lambda t: t.startswith(v.lower())),
}


def compile_predicate(p: Predicate, context: Mapping[str, Any] | None = None, under_not: bool = False) -> Column:
    """The condition of p. context: values for ``value_ref`` paths such as auth.id."""
    op = p["op"]
    if op in ("and", "or"):
        parts = [compile_predicate(c, context, under_not) for c in p.get("children", [])]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts) if parts else F.lit(op == "and")
    if op == "not":
        children = p.get("children", [])
        return ~compile_predicate(children[0], context, True) if children else F.lit(True)
    if op == "multiMatch":
        fields = [{**p, "op": "match", "attribute": a} for a in p["attributes"]]
        return compile_predicate({"op": "or", "children": fields}, context, under_not or len(fields) > 1)
    value = p.get("value")
    if "value_ref" in p:
        ref = p["value_ref"]
        if ref.startswith("data."):
            value = F.col(ref.removeprefix("data."))
        elif context is None or ref not in context or context[ref] is None:
            return F.lit(False)
        else:
            value = context[ref]
    test = LEAVES[op](F.col(p["attribute"]), value, p)
    return F.coalesce(test, F.lit(False)) if under_not else test


def where(equalities: Mapping[str, Any]) -> Column:
    """All of the named columns equal the values; a null value matches nothing."""
    return compile_predicate({"op": "and", "children": [{"op": "eq", "attribute": k, "value": v} for k, v in equalities.items()]}) if equalities else F.lit(True)
