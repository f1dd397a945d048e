"""The inverted index as a table of postings, and retrieval over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T


def postings(units: DataFrame, unit_id: str, content: str) -> DataFrame:
    """(term, unit_id), distinct: content terms, stemmed before stop words and short words go."""
    term = units.select(F.col(unit_id).alias("unit_id"), F.explode(T.words(F.col(content))).alias("word")).select("unit_id", T.stem(F.col("word")).alias("term"))
    return term.where(T.is_term(F.col("term"))).select("term", "unit_id").distinct()


def without_units(index: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings but those of the units that are gone."""
    return index.join(gone.select("unit_id"), "unit_id", "left_anti").select(index.columns)


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def top(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), "unit_id").limit(k)


def scored_search(index: DataFrame, terms: list[str], k: int, weight: float = 1.0) -> DataFrame:
    """(unit_id, score): each query term that a unit has adds weight * ln(V / (df + 1)); repeated terms add again."""
    vocabulary = index.select("term").distinct().count()
    hit = index.where(F.col("term").isin(terms))
    rate = document_frequency(hit).select("term", (weight * F.ln(F.lit(float(vocabulary)) / (F.col("df") + 1))).alias("gain"))
    times = F.lit(0)
    for t in dict.fromkeys(terms):
        times = F.when(F.col("term") == t, terms.count(t)).otherwise(times)
    # one row a query term at most: the query bounds the broadcast side
    scores = hit.join(F.broadcast(rate), "term").groupBy("unit_id").agg(F.round(F.sum(F.col("gain") * times), 6).alias("score"))
    return top(scores, k)


def text_search(index: DataFrame, terms: list[str], k: int) -> DataFrame:
    return top(index.where(F.col("term").isin(terms)).groupBy("unit_id").agg(F.count("*").alias("score")), k)


def near_terms(index: DataFrame, term: Column | str, most: int, k: int) -> DataFrame:
    """(term, df, distance) of the k vocabulary terms nearest to a term, itself excluded."""
    distance = F.levenshtein(F.col("term"), F.lit(term))
    return (
        document_frequency(index).where(F.abs(F.length("term") - F.length(F.lit(term))) <= most)
        .withColumn("distance", distance).where((F.col("distance") > 0) & (F.col("distance") <= most))
        .orderBy("distance", "term").limit(k)
    )


def fuzzy_search(index: DataFrame, terms: list[str], k: int, most: int = 2, near: int = 10) -> DataFrame:
    found = None
    for t in terms:
        part = index.join(F.broadcast(near_terms(index, t, most, near).select("term")), "term")
        found = part if found is None else found.union(part)
    return top(found.groupBy("unit_id").agg(F.count("*").alias("score")), k)


def phrase_search(index: DataFrame, terms: list[str]) -> DataFrame:
    """Units that have every term."""
    return index.where(F.col("term").isin(terms)).groupBy("unit_id").agg(F.count("*").alias("n")).where(F.col("n") == len(set(terms))).select("unit_id")


def fuse(lists: list[tuple[float, DataFrame]], k: int) -> DataFrame:
    """Reciprocal-rank fusion of (unit_id, score) lists, each with its weight."""
    parts = None
    for weight, hits in lists:
        ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "unit_id"))).select("unit_id", (F.lit(weight) / F.col("rank")).alias("part"))
        parts = ranked if parts is None else parts.union(ranked)
    return top(parts.groupBy("unit_id").agg(F.round(F.sum("part"), 6).alias("score")), k)


def reranked(hits: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Hits (unit_id, score) by 0.7 over their rank and 0.3 of the cosine of (unit_id, embedding, q); a unit without a vector has 0."""
    ranked = hits.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "unit_id")))
    near = vectors.join(ranked.select("unit_id"), "unit_id", "left_semi").select("unit_id", F.round(T.cosine(F.col("embedding"), F.col("q")), 6).alias("near"))
    return top(ranked.join(near, "unit_id", "left").select("unit_id", F.round(0.7 / F.col("r") + 0.3 * F.coalesce("near", F.lit(0.0)), 6).alias("score")), k)
