"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression on surface counts of the whole text gives each document its
own evidence, as a log likelihood ratio. Half of the labelled documents tell which
words toxic ones have; a second regression, on the most telling word of the other
half, says what such a word means, and where it speaks more against a document it
stands for its evidence. The documents' probabilities are summed by host and by path of the
host; the rate of a path is shrunk towards its host's and the rate of a host
towards the corpus's, the more the fewer documents it has, with strengths
estimated from the spread between sites (method of moments). The posterior of a
document combines its own evidence with the shrunk rate of its path among the other
documents: its own evidence is left out of the site's, so that it counts once.

``source`` is read as host/path; the path is its first segment, with the
language as the section of a source that has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm import textbytes as tb
from lodestone.operators.durable import durable

#: Labelled documents that the regression is fitted on, at most: those of the least hash of doc_id.
MAX_LABELLED = 20_000
#: Posterior probability of good quality from which a document stays.
KEEP_FROM = 0.5
#: Sites up to which their rates are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SITES = 500_000

#: A word speaks if so many toxic documents have it, and so great a share of them: rarer ones may owe it to a few copies of one text.
LEAST_DOCS, LEAST_SHARE = 4, 0.05

FEATURES = ("words", "distinct", "repeats", "upper", "symbols", "digits", "pauses", "spaces", "length", "pipes", "marked", "toxic")


def _packed(*classes: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint64)
    for k, members in enumerate(classes):
        table[list(members)] += np.uint64(1 << (21 * k))
    return table


_UPPER, _LOWER = bytes(range(65, 91)), bytes([*range(97, 123), *range(0xC3, 0xF5)])
_PAUSE, _SPACE = b".,;:?!'\"-()", b" \t\r\n"
_OTHER = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _PAUSE + b"|_")
_CLASSES = ((_UPPER, _LOWER, _OTHER), (b"0123456789", _PAUSE, _SPACE), (b"|", b"!", b"\n"))
_MASK = np.uint64((1 << 21) - 1)
_TABLES = tuple(_packed(*c) for c in _CLASSES)


def _counted(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Bytes of each of the nine classes in each row; three counters share a word where no row is too long for it."""
    if np.diff(at).max(initial=0) <= int(_MASK):
        counts = []
        for table in _TABLES:
            total = np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data])])[at])
            counts += [((total >> np.uint64(21 * k)) & _MASK).astype(float) for k in range(3)]
        return counts
    return [np.array([np.isin(data[x:y], np.frombuffer(c, np.uint8)).sum() for x, y in zip(at[:-1].tolist(), at[1:].tolist())], float) for three in _CLASSES for c in three]


Words = tuple[np.ndarray, np.ndarray]  # sorted hashes, and their weights


def features(texts: pa.Array, toxic: Words | None = None) -> np.ndarray:
    """One row of FEATURES for each text; zeros for a text without a word. toxic: the telling words."""
    data, at = tb.buffers(texts)
    upper, lower, other, digits, pauses, spaces, pipes, bangs, _ = _counted(data, at)
    w = tb.words(texts)
    n = np.diff(w.first).astype(float)
    held, bounds = tb.distinct_by_row(w.hash, w.first)
    same = np.concatenate([[0], np.cumsum(w.hash[1:] == w.hash[:-1])]) if len(w.hash) else np.zeros(1)
    last, first = np.maximum(w.first[1:] - 1, 0), np.minimum(w.first[:-1], max(len(w.hash) - 1, 0))
    repeats = np.where(n > 1, same[last] - same[first], 0)
    worst = np.zeros(len(n))
    if toxic is not None and len(toxic[0]) and len(held):
        known, weight = toxic
        at_ = np.minimum(np.searchsorted(known, held), len(known) - 1)
        some = np.flatnonzero(n)
        worst[some] = np.maximum(0, np.maximum.reduceat(np.where(known[at_] == held, weight[at_], 0), bounds[:-1][some]))
    some = np.maximum(n, 1)
    size = np.maximum(np.diff(at).astype(float), 1)
    x = np.stack(
        [
            np.log1p(n),
            np.diff(bounds) / some,
            repeats / some,
            upper / np.maximum(upper + lower, 1),
            np.minimum(other / some, 5),
            digits / size,
            np.minimum(pauses / some, 3),
            spaces / size,
            (upper + lower) / some,
            np.minimum(pipes / some, 2),
            np.minimum(bangs / some, 3),
            worst,
        ],
        axis=1,
    )
    x[n == 0] = 0
    return x


def telling(found: np.ndarray, toxic: int, other: int) -> Words:
    """Words with their log odds less twice the standard error, from how many toxic and other documents have them (rows hash, toxic, other)."""
    if not len(found) or not toxic or not other:
        return np.zeros(0, np.uint64), np.zeros(0)
    found = found[found[:, 1] >= max(LEAST_DOCS, LEAST_SHARE * toxic)]
    word, a, b = found[:, 0].astype(np.int64).view(np.uint64), found[:, 1], found[:, 2]
    said = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (other + 1)) - 2 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    order = np.argsort(word)
    order = order[said[order] > 0]
    return word[order], said[order]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> dict:
    """Ridge logistic regression by Newton steps; intercept last. Without both classes the evidence is nil."""
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = {"mean": np.zeros(x.shape[1]), "scale": np.ones(x.shape[1]), "weights": np.zeros(x.shape[1] + 1), "prior": np.log(rate / (1 - rate))}
    if not len(y) or y.min() == y.max():
        model["weights"][-1] = model["prior"]
        return model
    model["mean"], model["scale"] = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - model["mean"]) / model["scale"], np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    model["weights"] = w
    return model


def _llr(x: np.ndarray, fitted: dict) -> np.ndarray:
    z = (x - fitted["mean"]) / fitted["scale"] @ fitted["weights"][:-1] + fitted["weights"][-1]
    return np.clip(z - fitted["prior"], -20, 20)


def evidence(x: np.ndarray, model: dict) -> np.ndarray:
    """Log likelihood ratio of good against bad, between -20 and 20; nil for a text without a word.

    It is that of the quality, or that of being not toxic where the text has a
    telling word and this is the less.
    """
    own, worst = _llr(x[:, :-1], model["quality"]), x[:, -1:]
    # brought to the prior of quality, so that with it the logit of being not toxic comes out
    other = np.clip(_llr(worst, model["not_toxic"]) + model["not_toxic"]["prior"] - model["prior"], -20, 20)
    own = np.where(worst[:, 0] > 0, np.minimum(own, other), own)
    return np.where(x.any(axis=1), own, 0.0)


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, other): how many toxic and other documents of a part of a batch have a word."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for i, texts in tb.chunks(tb.string_array(batch.column("text"))):
            w = tb.words(texts)
            held, bounds = tb.distinct_by_row(w.hash, w.first)
            word, at = np.unique(held, return_inverse=True)
            bad = np.repeat(toxic[i : i + len(texts)], np.diff(bounds))
            a = np.bincount(at, bad, len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (word.view(np.int64), a, np.bincount(at, minlength=len(word)) - a)], ["word", "toxic", "other"])


def _features_of(toxic: Words):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in tb.chunks(tb.string_array(batch.column("text"))):
                x = features(texts, toxic)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, len(texts)) for c in ("quality", "toxic", "for_words")), lists], ["quality", "toxic", "for_words", "x"])

    return emit


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """The weights of words and the regressions, fitted on at most ``max_labelled`` labelled documents.

    Labels with a null quality or doc_id are left out, a null toxic counts as 0;
    of several labels of a document, the worst counts.
    """
    some = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
        .select("doc_id", "toxic", F.col("quality").cast("int").alias("quality"), (F.xxhash64("doc_id") % 2 == 0).alias("for_words"))
    )
    rows = durable(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").select("text", "toxic", "quality", "for_words"))
    teach = rows.where("for_words")
    whole = teach.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("a"), F.count("*").alias("n")).first()
    counted = teach.select("text", "toxic").mapInArrow(_words_of, "word long, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    # the share bounds their number
    some = counted.where(F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * whole["a"])).toPandas().to_numpy(np.int64)
    toxic = telling(some, whole["a"], whole["n"] - whole["a"])
    table = rows.select("text", "quality", "toxic", "for_words").mapInArrow(_features_of(toxic), "quality int, toxic int, for_words boolean, x array<double>").toPandas()
    x = np.stack(table["x"].to_list()) if len(table) else np.zeros((0, len(FEATURES)))
    order = np.lexsort(x.T)
    x, quality, bad, words = x[order], *(table[c].to_numpy(float)[order] for c in ("quality", "toxic", "for_words"))
    # what is learnt from words must not be judged on the documents that taught them
    fitted = {"quality": fit(x[:, :-1], quality), "not_toxic": fit(x[words == 0][:, -1:], 1 - bad[words == 0])}
    return fitted | {"prior": fitted["quality"]["prior"], "toxic": toxic}


def _score(model: dict):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            texts = tb.string_array(row.field("text"))
            llr, blank = np.zeros(len(texts)), np.zeros(len(texts), bool)
            for i, part in tb.chunks(texts):
                x = features(part, model["toxic"])
                llr[i : i + len(part)] = evidence(x, model)
                blank[i : i + len(part)] = ~x.any(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(blank, np.nan, llr))], [*batch.schema.names, "llr"])

    return score


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc, host, path, llr): each row of ``docs`` as one struct, with its place and its own evidence (NaN for a text without a word)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), _host().alias("host"), _path().alias("path"))
    return rows.mapInArrow(_score(model), StructType([*rows.schema.fields, StructField("llr", DoubleType())]))


def _host() -> Column:
    return F.element_at(F.split(F.coalesce("source", F.lit("")), "/"), 1)


def _path() -> Column:
    parts = F.split(F.coalesce("source", F.lit("")), "/")
    return F.coalesce(F.get(parts, 1), F.concat(F.lit("~"), F.coalesce("lang", F.lit(""))))


def _strength(groups: DataFrame, mean: str, n: str, of: str) -> Column:
    """Pseudo-count of the prior: the mean's own variance over the spread between groups that chance doesn't explain."""
    w = F.sum(n)
    spread = F.try_divide(F.sum(F.expr(f"{n} * pow({mean} - {of}, 2)")), w)
    chance = F.try_divide(F.sum(F.expr(f"{of} * (1 - {of})")), w)
    level = F.try_divide(F.sum(F.expr(f"{n} * {of} * (1 - {of})")), w)
    beyond = F.greatest(spread - chance, F.lit(1e-6))
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), level / beyond - 1))


def site_rates(rows: DataFrame, prior: float) -> DataFrame:
    """(host, path, n, s, host_n, host_s, overall, kh, kp) of each path, from rows (host, path, llr).

    n and s: documents and their summed probability of being good; kh and kp: the
    strengths with which hosts are drawn to the corpus's rate and paths to their host's.
    """
    p = F.expr(f"1 / (1 + exp(-(llr + {prior!r})))")
    paths = durable(rows.where("not isnan(llr)").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(p).alias("s")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = (total["s"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    hosts = durable(hosts.withColumns({"overall": F.lit(float(rate)), "host_mean": F.col("host_s") / F.col("host_n")}))
    kh = hosts.agg(_strength(hosts, "host_mean", "host_n", "overall").alias("k")).first()["k"] or 1.0
    hosts = hosts.withColumn("host_rate", (F.col("host_s") + F.lit(kh * rate)) / (F.col("host_n") + F.lit(kh)))
    both = paths.join(hosts, "host").withColumn("path_mean", F.col("s") / F.col("n"))
    kp = both.agg(_strength(both, "path_mean", "n", "host_rate").alias("k")).first()["k"] or 1.0
    return both.select("host", "path", "n", "s", "host_n", "host_s", "overall", F.lit(float(kh)).alias("kh"), F.lit(float(kp)).alias("kp"))


def judged(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc, host, path, llr, rate, posterior): every row of ``docs`` as the struct doc, and what is made of it.

    A null source or language counts as an empty one. A null or empty text, or
    one without a word, gets a posterior of 0 and no rate. Rows are judged one by one, so
    repeated rows get the same posterior, and a null doc_id is judged like any
    other. Without labels of both kinds there is no evidence and every text with a
    word gets the rate of its site. An empty table gives an empty result. Other
    columns are carried along in doc, whatever their names. Texts of any length are read whole.
    """
    model = train(docs, labels, max_labelled)
    prior = float(model["prior"])
    bare = docs.select("text", *(F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")))
    rates = durable(site_rates(scored(bare, model), prior))
    sites = F.broadcast(rates) if rates.count() <= BROADCAST_SITES else rates
    own = F.expr(f"1 / (1 + exp(-(llr + {prior!r})))")
    whole = scored(docs, model).join(sites, ["host", "path"], "left").withColumn("own", F.when(F.isnan("llr"), None).otherwise(own))
    # what the other documents of the host and the path say
    host_rate = F.expr("(host_s - own + kh * overall) / (host_n - 1 + kh)")
    rate = (F.col("s") - F.col("own") + F.col("kp") * host_rate) / (F.col("n") - 1 + F.col("kp"))
    whole = whole.withColumn("rate", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), rate)))
    logit = F.expr("ln(rate / (1 - rate)) + llr")
    return whole.select("doc", "host", "path", "llr", "rate", F.when(F.isnan("llr"), 0.0).otherwise(1 / (1 + F.exp(-logit))).alias("posterior"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents whose posterior is at least ``keep_from``, with the columns they had."""
    return judged(docs, labels).where(F.col("posterior") >= keep_from).select("doc.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality and decision for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = judged(docs.select("doc_id", "text", "source", "lang"), labels)
    return out.select(
        "doc.doc_id",
        "host",
        "path",
        F.round("llr", 6).alias("evidence"),
        F.round("rate", 6).alias("site_rate"),
        F.round("posterior", 6).alias("posterior"),
        (F.col("posterior") >= KEEP_FROM).alias("keep"),
    )


QUERIES = {"op3_quality": op3_quality}
