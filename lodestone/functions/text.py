"""Text scalars as column expressions, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = (
    "a after all also an and any are as at back be because been being but by can come could day did do does each even first for from give good had has "
    "have he her him how if in into is it its just know like look make many may might more most much must new no now of on only other our out over people "
    "said see shall should so some take than that the their them then there these they think this time to two up us use very want was way well what when "
    "which will with work would year your"
).split()
SUFFIXES = ("ing", "ed", "er", "est", "ly", "tion", "s", "es")
WORD = r"[\p{L}\p{N}_]+"


def stem(word: Column) -> Column:
    """The word without the first of SUFFIXES that leaves more than two characters."""
    out = F
    for suffix in SUFFIXES:
        n = len(suffix)
        out = out.when(word.endswith(suffix) & (F.length(word) > n + 2), F.left(word, F.length(word) - F.lit(n)))
    return out.otherwise(word)


def stem_sql(word: str) -> str:
    cases = " ".join(f"WHEN {word} LIKE '%{s}' AND length({word}) > {len(s) + 2} THEN left({word}, length({word}) - {len(s)})" for s in SUFFIXES)
    return f"(CASE {cases} ELSE {word} END)"


def words(text: Column) -> Column:
    """Lower-case words in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def words_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{WORD}')"


def plain(term: Column) -> Column:
    """Lower case without punctuation."""
    return F.regexp_replace(F.lower(term), r"[^\p{L}\p{N}_\s]", "")


def is_term(word: Column) -> Column:
    return (F.length(word) > 2) & ~word.isin(STOP_WORDS)


def is_term_sql(word: str) -> str:
    return f"length({word}) > 2 AND {word} NOT IN ({', '.join(repr(w) for w in STOP_WORDS)})"


def query_terms(query: str, stemmed: bool = True) -> list[str]:
    """Index terms of a query, repeats kept and stop words left out."""
    out = []
    for raw in query.lower().split():
        word = "".join(c for c in raw if c.isalnum() or c == "_")
        if stemmed:
            word = next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) > len(s) + 2), word)
        if word and word not in STOP_WORDS:
            out.append(word)
    return out


def subwords(token: Column) -> Column:
    """The token and, where it is longer than six, its character n-grams of 3 to 6."""
    n = F.length(token)
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(3), F.least(F.lit(6), n - 1)),
            lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(token, i, k)),
        )
    )
    return F.when(n > 6, F.concat(F.array(token), grams)).otherwise(F.array(token))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either has no length."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))

    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    size = F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))) * total(F.transform(b, lambda x: x.cast("double") * x.cast("double"))))
    return F.coalesce(F.try_divide(dot, size), F.lit(0.0))
