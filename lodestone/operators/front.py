"""The query front end: intents by weighted rules, cache keys, and results as text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In this order, which breaks ties.
INTENTS = ("search", "find", "analyze", "graph", "help")
#: (intent, score, pattern), on the lower-cased text.
PATTERNS = (
    ("search", 0.6, r"\b(search|find|look for|show me|get|what|where|when|how|why)\b"), ("search", 0.6, r"\b(search for|find|look for)\b.*\b(in|from|at)\b"), ("search", 0.2, r"\b(list|display|show)\b.*\b(all|every|each)\b"),
    ("find", 0.2, r"^find:"), ("find", 0.2, r"^exact:"), ("find", 0.2, r"^match:"), ("find", 0.2, r"\b(exactly|precisely|specifically)\b"), ("find", 0.2, r"\b(file|symbol|function|class|method)\s*:\s*"),
    ("analyze", 0.2, r"\b(analyze|analysis|stats|statistics|metrics|measure)\b"), ("analyze", 0.4, r"\b(how many|count|total|sum|average)\b"), ("analyze", 0.2, r"\b(complexity|performance|quality|health)\b"), ("analyze", 0.2, r"\b(report|overview|summary)\b"),
    ("graph", 0.2, r"\b(graph|relationship|connection|dependency|link)\b"), ("graph", 0.6, r"\b(call graph|dependency graph|inheritance)\b"), ("graph", 0.8, r"\b(connected to|related to|depends on|uses)\b"), ("graph", 0.2, r"\b(traverse|path|route|flow)\b"),
    ("help", 0.6, r"\b(help|how to|what is|explain|describe)\b"), ("help", 0.2, r"\b(tutorial|guide|documentation|manual)\b"), ("help", 0.2, r"\b(learn|understand|example)\b"), ("help", 0.2, r"\?$"),
)


def _weights(text: str) -> dict[str, float]:
    return {k: float(v) for k, v in (x.split("=") for x in text.split())}


KEYWORDS = {
    "search": _weights("search=1.0 find=0.9 look=0.7 show=0.8 get=0.8 what=0.6 where=0.6 when=0.5 how=0.6 why=0.5 list=0.7 display=0.7"),
    "find": _weights("find=1.0 exact=0.9 match=0.9 precisely=0.8 specifically=0.8 file=0.7 symbol=0.7 function=0.6 class=0.6 method=0.6"),
    "analyze": _weights("analyze=1.0 analysis=0.9 stats=0.8 statistics=0.8 metrics=0.8 measure=0.7 count=0.7 total=0.6 sum=0.6 average=0.6 complexity=0.7 performance=0.7 quality=0.6 health=0.6 report=0.7 overview=0.7 summary=0.7"),
    "graph": _weights("graph=1.0 relationship=0.9 connection=0.8 dependency=0.9 link=0.7 call=0.6 inheritance=0.7 connected=0.7 related=0.7 depends=0.8 uses=0.7 traverse=0.8 path=0.7 route=0.6 flow=0.6"),
    "help": _weights("help=1.0 how=0.7 tutorial=0.8 guide=0.8 documentation=0.8 manual=0.7 learn=0.7 understand=0.7 explain=0.8 describe=0.8 what=0.6 example=0.7"),
}
TECHNICAL = ("dependency", "relationship", "connection", "graph", "network")
SIMPLE = (
    ("search", ("search", "find", "look for", "show me")), ("find", ("find:", "exact:", "match:")), ("analyze", ("analyze", "analysis", "stats", "metrics")), ("graph", ("graph", "relationships", "connections", "dependencies")),
    ("help", ("help", "how to", "what is", "explain")),
)
THRESHOLD = 0.3


def pattern_score(low: Column, intent: str) -> Column:
    """The best score of the intent's patterns that match."""
    return F.greatest(F.lit(0.0), *[F.when(low.rlike(p), score).otherwise(0.0) for i, score, p in PATTERNS if i == intent])


def keyword_score(low: Column, intent: str) -> Column:
    """Weight of the intent's words in the text, over that of all its words."""
    words, table = F.split(low, r"\s+"), KEYWORDS[intent]
    weight = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    hits = F.aggregate(F.array_distinct(words), F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(weight, w), F.lit(0.0)))
    return hits / sum(table.values())


def structural_score(low: Column, intent: str) -> Column:
    """What the text's form says: a question mark, a colon, length, technical terms."""
    words = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    has = {
        "help": F.when(low.contains("?"), 0.3).otherwise(0.0), "analyze": F.when(low.contains("?"), 0.3).otherwise(0.0) + F.when(words > 5, 0.2).otherwise(0.0), "find": F.when(low.contains(":"), 0.4).otherwise(0.0),
        "graph": F.when(low.rlike("|".join(TECHNICAL)), 0.3).otherwise(0.0),
    }
    return has.get(intent, F.lit(0.0))


def context_score(context: dict[str, str], expected: dict[str, tuple[str, ...]]) -> float:
    """Half a point for each key of the context that holds an expected word, 1 at most."""
    return min(1.0, 0.5 * sum(any(w in str(context.get(k, "")).lower() for w in words) for k, words in expected.items()))


def intent_scores(text: Column, context: dict[str, float] | None = None) -> dict[str, Column]:
    """The score of each intent: 0.4 pattern, 0.3 keywords, 0.2 context (given by intent), 0.1 form."""
    low = F.trim(F.lower(text))
    return {
        i: F.round(0.4 * pattern_score(low, i) + 0.3 * keyword_score(low, i) + 0.2 * F.lit((context or {}).get(i, 0.0)) + 0.1 * structural_score(low, i), 9) for i in INTENTS
    }


def classified(queries: DataFrame, text: str, context: dict[str, float] | None = None) -> DataFrame:
    """``queries`` with intent and confidence: the best score, the first of equal ones; below the threshold it is search."""
    scores = F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, s) in enumerate(intent_scores(F.col(text), context).items())])
    best = F.array_max(scores)
    return queries.withColumn("b", best).withColumns({"intent": F.when(F.col("b.s") < THRESHOLD, "search").otherwise(F.col("b.name")), "confidence": F.col("b.s")}).drop("b")


def simple_intent(text: Column) -> Column:
    """The first intent of which a word is in the text, or search."""
    low, out = F.lower(text), F
    for intent, words in SIMPLE:
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        out = out.when(test, intent)
    return out.otherwise("search")


def cache_key(kind: Column, text: Column, filters: Column, limit: Column, offset: Column) -> Column:
    return F.md5(F.concat_ws("|", kind, text, filters, limit.cast("string"), offset.cast("string")))


def shortened(text: Column, n: int) -> Column:
    """At most n characters; what was cut ends in dots."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 3)), F.lit("..."))).otherwise(text)


def formatted(hits: DataFrame, form: str = "text") -> DataFrame:
    """(line) of hits (rank, id, name, symbol_type, file_path, content, score) as text, json, table or markdown."""
    name = F.coalesce("name", F.col("file_path"))
    line = {
        "text": lambda: F.format_string("%d. %s (%s) - %s [%.4f]", "rank", name, F.coalesce("symbol_type", F.lit("file")), "file_path", "score"),
        "json": lambda: F.to_json(F.struct("rank", "id", "name", "symbol_type", "file_path", "score")),
        "table": lambda: F.concat(*[x for c, n in ((name, 30), (F.col("file_path"), 40)) for x in (F.rpad(shortened(c, n), n, " "), F.lit(" | "))], F.format_string("%.4f", "score")),
        "markdown": lambda: F.format_string("### %d. `%s`\n\n%s\n\n```\n%s\n```", "rank", name, "file_path", shortened(F.coalesce("content", F.lit("")), 500)),
    }[form]()
    return hits.select("rank", line.alias("line")).orderBy("rank").select("line")


def findings_report(findings: DataFrame) -> DataFrame:
    """(line): a line for each finding."""
    return findings.select(F.format_string("[%s] %s:%d %s", F.upper("severity"), "file_path", "line_number", "issue").alias("line"))


def command(text: str) -> tuple[str, str]:
    """What a typed line is: ('search', rest) after /, ('command', rest) after :, else ('query', text)."""
    said = text.strip()
    return ("search", said[1:].strip()) if said.startswith("/") else ("command", said[1:].strip()) if said.startswith(":") else ("query", said)


def glob_regex(pattern: str) -> str:
    """A file name pattern as a regular expression that Java reads."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = re.sub(r"([\\\[&])", r"\\\1", pattern[i:end])
            out += f"[{'^' + inner[1:] if inner.startswith('!') else inner}]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"
