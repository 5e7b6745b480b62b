"""Tokenisers and token filters as column expressions; stemming as an Arrow UDF."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The English words that search leaves out.
STOPWORDS = list(dict.fromkeys("""
a an the i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing will would
shall should can could may might must ought about above across after against along among around at before behind below beneath beside between beyond
by down during except for from in inside into near of off on onto out outside over past since through throughout to toward towards under underneath
until up upon with within without and but or nor so yet both either neither not only as if than when while although because unless whether here there
where when how why all each every any some no none more most other such own same too very just also now then again ever once few many much several s
t d ll m ve re
""".split()))


# Tokenisers: a text column to an array of tokens.


def words(c: Column, least: int = 2, most: int = 40) -> Column:
    """Lower-case runs of letters and digits of least to most characters."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t).between(least, most))


def whitespace(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def word_boundary(c: Column) -> Column:
    """Runs of ASCII letters, digits and underscores."""
    return F.filter(F.split(c, r"\W+"), lambda t: t != "")


def ngrams(c: Column, n: int = 3) -> Column:
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


# Token filters: an array of tokens to another.


def lowercase(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def without_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(STOPWORDS))


def at_least(tokens: Column, n: int = 2) -> Column:
    return F.filter(tokens, lambda t: F.length(t) >= n)


def at_most(tokens: Column, n: int = 50) -> Column:
    return F.filter(tokens, lambda t: F.length(t) <= n)


def trimmed(tokens: Column) -> Column:
    """Without blanks at the ends; tokens of blanks only go."""
    return F.filter(F.transform(tokens, lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")


def unique(tokens: Column) -> Column:
    return F.array_distinct(tokens)


def pipeline(tokenizer: Callable[[Column], Column], *filters: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A tokeniser followed by filters, as one function of a text column."""
    return lambda c: reduce(lambda tokens, f: f(tokens), filters, tokenizer(c))


#: The ready-made pipelines.
PIPELINES = {
    "minimal": pipeline(word_boundary, lowercase),
    "simple": pipeline(word_boundary, lowercase, at_least),
    "search": pipeline(word_boundary, lowercase, at_least, without_stopwords),
}


def all_text(df: DataFrame) -> Column:
    """Every string of a row, in nested fields too, joined by blanks."""

    def leaves(c: Column, kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StringType):
            return [c]
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in leaves(c.getField(f.name), f.dataType)]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return [F.array_join(c, " ")]
        return []

    return F.concat_ws(" ", *[x for f in df.schema.fields for x in leaves(F.col(f"`{f.name}`"), f.dataType)])


TURN = 500_000  # tokens stemmed at once

# Porter's algorithm, after the published description.
_STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True)


def _shape(stem: str) -> str:
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("vc", re.sub(r"(.)\1*", r"\1", _shape(stem))))


def _cvc(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def stem(w: str) -> str:
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w[-1:] == w[-2:-1] and _shape(w)[-1:] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in _STEP4:
        if w.endswith(end):
            s = w[: -len(end)]
            if _measure(s) > 1 and (end != "ion" or s[-1:] in ("s", "t")):
                w = s
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stemmed(lists: pa.ListArray) -> pa.ListArray:
    """The stem of each token; only the distinct ones of TURN tokens are strings of Python at a time."""
    flat, out = lists.flatten(), []
    for at in range(0, len(flat), TURN):
        part = flat.slice(at, TURN).dictionary_encode()
        out.append(pa.array([stem(t) for t in part.dictionary.to_pylist()], pa.string()).take(part.indices))
    ends = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(out) if out else pa.array([], pa.string()), mask=lists.is_null())


def stems(tokens: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        return stemmed(lists)

    return run(tokens)


def search_tokens(c: Column) -> Column:
    """Words without stopwords, stemmed; the stems have 2 to 40 characters."""
    return F.filter(stems(without_stopwords(words(c, most=2**31 - 1))), lambda t: F.length(t).between(2, 40))


def fnv1a64(token: str) -> int:
    h = 0xCBF29CE484222325
    for b in token.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def embedded(c: Column, size: int = 64) -> Column:
    """A bag of words as a unit vector: each token adds 1 or -1 (the hash's top bit) to the place its hash names.

    A text without tokens that isn't blank counts as one token, always 1; a blank one is all zeros.
    """

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def one(text: str | None) -> np.ndarray | None:
            if text is None:
                return None
            v = np.zeros(size, np.float32)
            tokens = [t.lower() for t in re.split(r"[\W_]+", text) if t]
            for t in tokens:
                h = known[t] if t in known else known.setdefault(t, fnv1a64(t))
                v[h % size] += -1 if h >> 63 else 1
            if not tokens and text.strip():
                v[fnv1a64(text.strip()) % size] = 1
            norm = np.sqrt((v * v).sum())
            return v / norm if norm else v

        return s.map(one)

    return run(c)
