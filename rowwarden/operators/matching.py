"""Pairs of alike names. Each list of names is that of one file: short arrays in a row, paired greedily in their order."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import compact, norm, similarity

ALIKE = 0.8
_PAIRS = "array<struct<declared:string,column:string>>"


def _greedy(names: Column, free: Column, form, threshold: float) -> Column:
    """Struct of pairs and of the free names left: each name takes the most alike free one (of equals the last in text order)."""
    start = F.struct(F.array().cast(_PAIRS).alias("pairs"), free.alias("free"))

    def step(acc, n):
        scored = F.transform(acc["free"], lambda u: F.struct(similarity(form(n), form(u)).alias("score"), u.alias("u")))
        best = F.array_max(scored)
        taken = best["score"] >= threshold
        return F.when(F.coalesce(taken, F.lit(False)), F.struct(F.concat(acc["pairs"], F.array(F.struct(n.alias("declared"), best["u"].alias("column")))).alias("pairs"), F.filter(acc["free"], lambda u: u != best["u"]).alias("free"))).otherwise(acc)

    return F.aggregate(names, start, step)


def similar_names(missing: Column, undeclared: Column, threshold: float = ALIKE) -> Column:
    """Declared names missing from a file and undeclared columns of alike names, one to one."""
    return _greedy(missing, undeclared, norm, threshold)["pairs"]


def pair_spelling(missing: Column, extra: Column, threshold: float = ALIKE) -> Column:
    """Struct of pairs, missing and extra: first columns of equal compact spelling (two names may share one), then alike ones."""
    spelled = F.transform(extra, compact)
    back = lambda m: F.array_position(F.reverse(spelled), compact(m))
    same = F.filter(missing, lambda m: (compact(m) != "") & (back(m) > 0))
    pairs = F.transform(same, lambda m: F.struct(m.alias("declared"), F.element_at(F.reverse(extra), back(m).cast("int")).alias("column")))
    used = F.transform(pairs, lambda p: p["column"])
    rest = _greedy(F.filter(missing, lambda m: ~F.array_contains(same, m)), F.filter(extra, lambda e: ~F.array_contains(used, e)), compact, threshold)["pairs"]
    whole = F.concat(pairs, rest)
    return F.struct(whole.alias("pairs"), F.array_except(missing, F.transform(whole, lambda p: p["declared"])).alias("missing"), F.array_except(extra, F.transform(whole, lambda p: p["column"])).alias("extra"))


def same_columns(header: Column, other: Column, most: int = 30) -> Column:
    """Struct of missing, extra (normalised names, at most `most`) and same_columns for a table in another format."""
    names = lambda h: F.array_distinct(F.transform(F.filter(h, lambda x: x != ""), norm))
    missing, extra = F.array_except(names(header), names(other)), F.array_except(names(other), names(header))
    cut = lambda a: F.slice(F.array_sort(a), 1, most)
    return F.struct(cut(missing).alias("missing"), cut(extra).alias("extra"), ((F.size(missing) == 0) & (F.size(extra) == 0)).alias("same_columns"))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def by_position(names: pd.Series, keys: pd.Series, header: pd.Series, header_keys: pd.Series) -> pd.Series:
    """Names that differ but stand in the same place between names that agree: equal-length replaced runs of an alignment.
    keys and header_keys are the normalised names. An alignment has no built-in form."""

    def one(n, a, h, b):
        out = {}
        for op, i, j, k, m in difflib.SequenceMatcher(None, list(a), list(b), autojunk=False).get_opcodes():
            if op == "replace" and j - i == m - k:
                out |= dict(zip(n[i:j], h[k:m], strict=True))
        return out

    return pd.Series([one(*x) for x in zip(names, keys, header, header_keys, strict=True)])


def oracle(names: Column, header: Column) -> Column:
    """How far extracted names agree with a file's header: recall, precision, exact_match and levenshtein; null without a header."""
    h, n = F.array_distinct(F.transform(header, norm)), F.array_distinct(F.transform(names, norm))
    both = F.size(F.array_intersect(h, n))
    part = lambda x, of: F.round(F.coalesce(F.try_divide(x.cast("double"), of), F.lit(0.0)), 4)
    best = F.transform(header, lambda x: F.coalesce(F.array_max(F.transform(names, lambda y: F.when(x == y, F.lit(1.0)).otherwise(similarity(x, y)))), F.lit(0.0)))
    total = F.aggregate(best, F.lit(0.0), lambda a, b: a + b)
    found = F.struct(F.size(header).alias("header_columns"), F.size(names).alias("extracted"), part(both, F.size(h)).alias("recall"), part(both, F.size(n)).alias("precision"), part(F.size(F.filter(header, lambda x: F.array_contains(names, x))), F.size(header)).alias("exact_match"), part(total, F.size(header)).alias("levenshtein"))
    return F.when(F.size(header) > 0, found)


def agreement(o: Column) -> Column:
    return F.coalesce(F.least(o["recall"], o["precision"]), F.lit(0.0))




def with_spelling(missing: Column, extra: Column) -> Column:
    """Struct of paired names of two formats of a table, and whether they differ in spelling only."""
    paired = pair_spelling(missing, extra)
    return F.struct(paired["pairs"].alias("spelling"), ((F.size(paired["missing"]) == 0) & (F.size(paired["extra"]) == 0)).alias("spelling_only"))


def similar_of(record: Column, *keys: str) -> Column:
    """The pairs of alike names of a stored record (JSON): under the first of its keys that has any."""
    found = [F.get_json_object(record, f"$.{k}") for k in keys or ("similar_names", "probable_typos")]
    return F.coalesce(*[F.when(~x.isin("{}", ""), F.from_json(x, "map<string,string>")) for x in found], F.create_map().cast("map<string,string>"))
