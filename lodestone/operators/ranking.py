"""Filters on results and ranking by weighted signals, as columns; a greedy re-rank for diversity."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"text_relevance": 0.3, "semantic": 0.25, "recency": 0.15, "popularity": 0.15, "symbol_weight": 0.1, "file_weight": 0.05}
SYMBOL_WEIGHTS = {
    "class": 1.0, "function": 0.9, "method": 0.8, "interface": 0.85, "variable": 0.6, "constant": 0.7, "import": 0.5, "export": 0.5, "type": 0.7, "enum": 0.6, "namespace": 0.8, "module": 0.7, "unknown": 0.3,
}
FILE_WEIGHTS = {"python": 1.0, "javascript": 0.9, "typescript": 0.9, "java": 0.8, "cpp": 0.8, "rust": 0.85, "go": 0.8, "c": 0.7, "ruby": 0.6, "php": 0.6, "unknown": 0.3}
SEVERITIES = ("critical", "high", "medium", "low", "info")


def looked_up(value: Column, table: dict[str, float], default: float = 0.3) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value), F.lit(default))


def text_relevance(content: Column, keywords: Column, terms: list[str]) -> Column:
    """Terms in the content, and half of those in keywords, over twice the number of terms; 1 at most."""
    low = F.lower(F.coalesce(content, F.lit("")))
    hits = sum((low.contains(t).cast("int") for t in terms), F.lit(0)) + 0.5 * sum((_holding(keywords, t) for t in terms), F.lit(0))
    return F.least(F.lit(1.0), hits / (2.0 * max(1, len(terms))))


def _holding(keywords: Column, term: str) -> Column:
    return F.size(F.filter(keywords, lambda w: F.lower(w).contains(term)))


def recency(updated_at: Column, now: str) -> Column:
    """By whole days before an instant that is given, never the clock's."""
    age = F.floor((F.lit(now).cast("timestamp").cast("double") - updated_at.cast("double")) / 86400)
    return F.when(age < 1, 1.0).when(age < 7, 0.8).when(age < 30, 0.6).when(age < 90, 0.4).otherwise(0.2)


def popularity(content: Column) -> Column:
    n = F.coalesce(F.length(content), F.lit(0))
    return F.when(n > 1000, 1.0).when(n > 500, 0.8).when(n > 100, 0.6).otherwise(0.4)


def signals(units: DataFrame, terms: list[str], now: str) -> DataFrame:
    """``units`` (content, keywords, updated_at, symbol_type, file_type, semantic) with a column for each signal; a missing semantic one counts 0."""
    return units.withColumns(
        {
            "text_relevance": text_relevance(F.col("content"), F.col("keywords"), terms), "semantic": F.coalesce("semantic", F.lit(0.0)), "recency": recency(F.col("updated_at"), now), "popularity": popularity(F.col("content")),
            "symbol_weight": F.when(F.col("symbol_type").isNull(), 0.0).otherwise(looked_up(F.col("symbol_type"), SYMBOL_WEIGHTS)), "file_weight": looked_up(F.col("file_type"), FILE_WEIGHTS),
        }
    )


def score(weights: dict[str, float] = WEIGHTS) -> Column:
    return F.round(sum((F.lit(w) * F.col(name) for name, w in weights.items()), F.lit(0.0)), 6)


def ranked(signalled: DataFrame, weights: dict[str, float] = WEIGHTS, k: int = 20) -> DataFrame:
    """(id, score) of the best k by the weighted signals."""
    return signalled.select("id", score(weights).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def learned(clicks: list[tuple[int, dict[str, float]]], weights: dict[str, float] = WEIGHTS) -> dict[str, float]:
    """Weights after clicks (position, signals of what was clicked): strong signals grow, the more the nearer to the top, and all are scaled to a sum of 1."""
    now, least = dict(weights), {"text_relevance": 0.7, "symbol_weight": 0.8, "file_weight": 0.8}
    for position, said in clicks:
        rate = 0.1 * (1 - position / 10)
        for name, bound in least.items():
            if said.get(name, 0) > bound:
                now[name] *= 1 + rate * said[name]
        total = sum(now.values())
        now = {name: w / total for name, w in now.items()}
    return now


def learning_stats(clicks: list, weights: dict[str, float] = WEIGHTS) -> dict:
    """How many clicks there were and what they changed."""
    now = learned(clicks, weights)
    return {"feedback_count": len(clicks), "changes": {n: now[n] - weights[n] for n in weights}, "current": now}


def similarity(a: str, b: str) -> Column:
    """How alike two units are whose columns have the prefixes a and b: file, symbol type and length."""
    x, y = F.length(F.coalesce(F.col(f"{a}content"), F.lit(""))), F.length(F.coalesce(F.col(f"{b}content"), F.lit("")))
    return similarity_by_length(a, b, x, y)


def similarity_by_length(a: str, b: str, x: Column, y: Column) -> Column:
    """``similarity`` where the lengths are known: a content is counted once, not once a pair."""
    # 0.3 of the ratio, multiplied before it is divided: a product of whole numbers is exact
    ratio = F.when((x > 0) & (y > 0), 3 * F.least(x, y) / F.lit(10.0) / F.greatest(x, y)).otherwise(0.0)
    same = lambda c, w: F.when(F.col(f"{a}{c}") == F.col(f"{b}{c}"), w).otherwise(0.0)
    return F.least(F.lit(1.0), same("file_path", 0.4) + same("symbol_type", 0.3) + ratio)


def diverse(signalled: DataFrame, k: int, factor: float = 0.3, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(id, score, rank): the best k, taken one by one; each that is taken lowers the rest by what they share with it.

    Only the k best by score take part, so the greedy part sees k rows.
    """
    best = signalled.select("id", "file_path", "symbol_type", F.length(F.coalesce("content", F.lit(""))).alias("n"), score(weights).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        out = []
        while len(rows):
            top, rows = rows.iloc[0], rows.iloc[1:].copy()
            out.append((top["id"], float(top["score"]), len(out) + 1))
            if len(rows):
                low, high = rows["n"].clip(upper=top["n"]), rows["n"].clip(lower=top["n"])
                near = 0.4 * (rows["file_path"] == top["file_path"]) + 0.3 * (rows["symbol_type"] == top["symbol_type"]) + 0.3 * (low / high.where(high > 0, 1))
                rows["score"] *= 1 - factor * near.clip(upper=1.0)
                rows = rows.sort_values(["score", "id"], ascending=[False, True])
        return pd.DataFrame(out, columns=["id", "score", "rank"])

    return best.groupBy().applyInPandas(take, "id string, score double, rank int")


def processor_ranked(units: DataFrame, terms: list[str], k: int) -> DataFrame:
    """(id, score): a term adds 1 in the content, 0.5 in each keyword, 2 in the symbol's name and 0.3 in the path."""
    total = F.lit(0.0)
    for t in terms:
        in_ = lambda c, t=t: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(t).cast("int")
        total = total + in_("content") + 0.5 * _holding(F.col("keywords"), t) + 2 * in_("name") + 0.3 * in_("file_path")
    return units.select("id", F.round(total, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def by_severity(findings: DataFrame, most: int = 100) -> DataFrame:
    """Findings from critical to info, as many as a report shows."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return findings.orderBy(F.when(place > 0, place).otherwise(len(SEVERITIES) + 1), "id", "line_number", "issue").limit(most)


_FILTERS = {"file": r"file:(\S+)", "type": r"type:(\S+)", "lang": r"lang:(\S+)", "date": r"date:(\d{4}-\d{2}-\d{2})"}


def filters_in(text: Column) -> dict[str, Column]:
    """The first filter of each kind that a query's text names; null where it names none."""
    return {name: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for name, pattern in _FILTERS.items()}


def parsed_filters(text: str) -> dict[str, str]:
    """Filters written as k:v,k2:v2; parts without a colon are passed over."""
    return {k.strip(): v.strip() for k, _, v in (part.partition(":") for part in text.split(",")) if _}


def post_filter(results: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Results that pass all filters: file_path and language as substrings in any case, symbol_type as it is; units without a symbol pass that."""
    for name, value in filters.items():
        if name == "file_path":
            results = results.where(F.lower("file_path").contains(value.lower()))
        elif name == "symbol_type":
            results = results.where(F.col("symbol_type").isNull() | (F.col("symbol_type") == value))
        elif name == "language":
            results = results.where(F.lower("file_type").contains(value.lower()))
    return results


def page(results: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """The results from an offset on, in order; a limit of 0 or less takes all."""
    out = results.orderBy(*order).offset(offset)
    return out.limit(limit) if limit > 0 else out


def compared(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows that pass filters on columns: >x, >=x, <x, <=x, =x, /regex/, or a substring. Strings are cast to the column's type."""
    for name, value in filters.items():
        kind = rows.schema[name].dataType
        if m := re.match(r"(>=|<=|>|<|=)(.*)", value, re.S):
            bound = F.lit(m[2].strip()).cast(kind)
            column = F.col(name)
            rows = rows.where({">": column > bound, "<": column < bound, ">=": column >= bound, "<=": column <= bound, "=": column == bound}[m[1]])
        elif len(value) > 1 and value[0] == value[-1] == "/":
            rows = rows.where(F.col(name).rlike(value[1:-1]))
        else:
            rows = rows.where(F.lower(name).contains(value.lower()))
    return rows
