"""Hashed embeddings of text, as column expressions: tokens with their n-grams, weights, signed hash places, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

DIMENSIONS = 384
COMMON, RARE = "etaoinshrdlu", "zqxjkvbpygfw"
FEATURES = ("has_functions", "has_classes", "has_imports", "has_comments", "complexity", "identifier_density", "keyword_density")
_SIGNS = {
    "has_functions": ("def ", "function ", "func "), "has_classes": ("class ", "interface ", "struct "), "has_imports": ("import ", "from ", "using ", "include "), "has_comments": ("#", "//", "/*", "*", "<!--"),
}
_COMPLEX = ("if", "else", "for", "while", "switch", "try", "catch")
_KEYWORDS = ("def", "class", "import", "from", "return", "if", "else", "for", "while", "try")


def tokens(text: Column) -> Column:
    """Words of the lower-cased text in order, each long one followed by its character n-grams."""
    return F.flatten(F.transform(T.words(text), lambda w: T.subwords(w)))


def char_frequency(token: Column) -> Column:
    """Share of common letters less the share of rare ones."""
    common, rare = (F.length(F.regexp_replace(token, f"[^{s}]", "")) for s in (COMMON, RARE))
    return (common - rare) / F.length(token)


def idf(token: Column) -> Column:
    """A guess at how telling a token is, from its length and letters alone; may be negative."""
    return 1 + F.ln(F.least(F.lit(2.0), F.length(token) / 3) / (1 + F.greatest(F.lit(-0.99), char_frequency(token))))


def place(token: Column, k: int) -> Column:
    """Dimension that the k-th hash of a token falls in: the digest as one number, modulo DIMENSIONS."""
    said = F.concat(token, F.lit(f"_{k}"))
    digest = (F.md5(said), F.sha1(said), F.sha2(said, 256))[k]
    parts = (32, 40, 64)[k] // 8
    numbers = F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(parts)])
    # 2 ** 32 leaves 256 when divided by 384
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: (a * 256 + x) % DIMENSIONS).cast("int")


def weights(units: DataFrame, unit: str, text: str) -> DataFrame:
    """(unit, token, weight): the frequency of each token among its unit's, times its idf."""
    t = tokens(F.col(text))
    said = units.where(f"coalesce(length({text}), 0) > 0").select(F.col(unit).alias("unit"), F.size(t).alias("n"), F.explode(t).alias("token"))
    counted = said.groupBy("unit", "n", "token").agg(F.count("*").alias("times"))
    return counted.select("unit", "token", (F.col("times") / F.col("n") * idf(F.col("token"))).alias("weight"))


def embed(units: DataFrame, unit: str, text: str) -> DataFrame:
    """(unit, embedding): vectors of length 1 for every unit; an empty or null text has zeros.

    Tokens add their weight at three hashed places, with the signs + - +. Places are
    summed by unit and place; only the places that occur travel.
    """
    spread = weights(units, unit, text).select("unit", F.explode(F.array(*[F.struct(place(F.col("token"), k).alias("at"), (F.col("weight") * s).alias("w")) for k, s in ((0, 1), (1, -1), (2, 1))])).alias("p"))
    summed = spread.groupBy("unit", "p.at").agg(F.sum("p.w").alias("w"))
    parts = summed.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.try_divide(F.try_element_at(F.col("m"), i), F.col("size")), F.lit(0.0)))
    return units.select(F.col(unit).alias("unit")).join(parts, "unit", "left").select("unit", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), DIMENSIONS)).otherwise(dense).alias("embedding"))


def _count(text: Column, word: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)


def features(text: Column) -> dict[str, Column]:
    """The seven features of a text, each between 0 and 1."""
    low = F.lower(text)
    spaced = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    some = F.greatest(spaced, F.lit(1))
    out = {name: F.when(_either(low, signs), 1.0).otherwise(0.0) for name, signs in _SIGNS.items()}
    out["complexity"] = F.least(F.lit(1.0), sum((_count(low, w) for w in _COMPLEX), F.lit(0)) / 10)
    out["identifier_density"] = F.least(F.lit(1.0), F.regexp_count(text, F.lit(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b")) / some)
    out["keyword_density"] = F.least(F.lit(1.0), sum((_count(low, w) for w in _KEYWORDS), F.lit(0)) / some)
    return out


def _either(text: Column, words: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | text.contains(w)
    return test


def embed_with_features(units: DataFrame, unit: str, text: str) -> DataFrame:
    """(unit, embedding): the hashed vector with the seven features behind it."""
    more = units.select(F.col(unit).alias("unit"), F.array(*features(F.coalesce(F.col(text), F.lit(""))).values()).alias("features"))
    return embed(units, unit, text).join(more, "unit").select("unit", F.concat("embedding", "features").alias("embedding"))


def unit_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``vectors`` with each vector brought to length 1, so that a cosine is one sum of products; zeros stay."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return vectors.select(F.col(key).alias("id"), F.transform(x, lambda v: F.coalesce(F.try_divide(v, size), F.lit(0.0))).alias("v"))
