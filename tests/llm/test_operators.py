"""Each operator against brute force, and its edge cases: nulls, empty, long, tied and repeated rows, clashing columns."""

import gzip
import itertools
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import audio, capture_index, decontaminate, jaccard_join, language, line_dedup, packing, pii, quality, site_style_tree
from lodestone.llm import textbytes as tb

DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, bucket int, grams string"


def docs(spark, texts, first=0):
    rows = [(first + i, t, "en", "site/a", None if t is None else len(t), "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(1)
    long = words(r, 30_000)
    rows = docs(spark, [None, "", " ", long, long, "a b c", "a b c", "é ü ß 語", "\n\n"])
    return rows.union(rows.where("doc_id = 5")).union(spark.createDataFrame([(None, "null id", None, None, None, None, None, None)], DOCS))


# --- 6: Jaccard join ---


def test_jaccard_join_finds_what_brute_force_finds(spark):
    r = random.Random(3)
    texts = []
    for _ in range(60):
        base = words(r, r.randint(5, 120)).split()
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            copy = list(base)
            for _ in range(int(len(copy) * r.choice((0, 0.03, 0.08, 0.3)))):
                copy[r.randrange(len(copy))] = words(r, 1)
            texts.append(" ".join(copy))
    sets = [set(t.split()) for t in texts]
    near = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    group = {r_["doc_id"]: r_["group_id"] for r_ in jaccard_join.near_duplicate_groups(docs(spark, texts)).collect()}
    found = sum(group.get(i, -1) == group.get(j, -2) for i, j in near)
    assert found >= 0.95 * len(near)
    edges = jaccard_join.near_duplicate_edges(docs(spark, texts)).collect()
    assert all((min(e["center"], e["doc_id"]), max(e["center"], e["doc_id"])) in near for e in edges)


def test_jaccard_join_finds_pairs_behind_strangers(spark):
    # short documents of few common words: nearly every lesser id is a stranger
    r = random.Random(11)
    known = words(r, 60).split()
    texts = [" ".join(r.sample(known, r.randint(4, 30))) for _ in range(1500)]
    long = [" ".join(r.sample(known, 50) + words(r, 60).split()) for _ in range(100)]
    for t in texts[-100:] + long:
        copy = t.split()
        copy[r.randrange(len(copy))] = "another"
        texts += [t, " ".join(copy)]
    sets = [set(t.split()) for t in texts]
    near = set()
    for (i, x), (j, y) in itertools.combinations(enumerate(sets), 2):
        if len(x & y) >= 0.8 * len(x | y):
            near.add((i, j))
    rows = docs(spark, texts).repartition(5)
    want = components(near, len(texts))
    edges = jaccard_join.near_duplicate_edges(rows).collect()
    assert {tuple(sorted((e["center"], e["doc_id"]))) for e in edges} <= near
    assert components([(e["center"], e["doc_id"]) for e in edges], len(texts)) == want


def components(pairs, n):
    """The groups of two or more that pairs of numbers below n make."""
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    groups = {}
    for x in range(n):
        groups.setdefault(root(x), set()).add(x)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("parts, part, known", [(1, 1 << 16, 1 << 20), (32, 3, 1 << 20), (7, 3, 0)])
def test_jaccard_join_groups_are_those_of_all_pairs(spark, monkeypatch, parts, part, known):
    # whatever the partitions, the length of a list's rows and the way the labels travel
    monkeypatch.setattr(jaccard_join, "PART", part)
    monkeypatch.setattr(jaccard_join, "LABELS", known)
    r = random.Random(21)
    texts = []
    for size, copies in ((12, 25), (40, 40), (150, 30), (90, 1), (7, 6)):
        base = words(r, size).split()
        for _ in range(copies):
            # a copy of a copy now and then, so that not all are like the first
            copy = list(r.choice(texts[-5:]).split() if texts and r.random() < 0.3 and len(texts[-1].split()) == size else base)
            for _ in range(r.randint(0, max(1, size // 12))):
                copy[r.randrange(size)] = words(r, 1)
            texts.append(" ".join(copy))
    r.shuffle(texts)
    sets = [set(t.split()) for t in texts]
    near = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = {}
    for x in jaccard_join.near_duplicate_groups(docs(spark, texts).repartition(parts)).collect():
        got.setdefault(x["group_id"], set()).add(x["doc_id"])
    assert {frozenset(g) for g in got.values()} == components(near, len(texts))


def test_jaccard_join_counts_all_documents(spark):
    many = 25_000
    rows = spark.range(many).selectExpr("id as doc_id", "concat('w', id % 50, ' x', id, ' X', id) as text")
    want = Counter()
    for start in range(0, many, 5000):
        texts = pa.array([f"w{i % 50} x{i}" for i in range(start, start + 5000)], pa.large_string())
        want.update(jaccard_join._counter(tb.words(texts).hash).tolist())
    for parts in (1, 5):
        number = jaccard_join.gram_counts(rows.repartition(parts), 1)
        assert number.sum() == 2 * many
        assert {int(i): int(number[i]) for i in np.flatnonzero(number)} == want
    weight = jaccard_join.gram_weights(rows, 1)
    held = np.flatnonzero(number)
    assert (np.diff(weight[held[np.argsort(number[held])]].astype(int)) <= 0).all()
    assert (jaccard_join.gram_weights(rows.limit(0), 1) == 1).all()


def test_jaccard_join_groups_are_the_same_by_any_weights(spark, monkeypatch):
    r = random.Random(8)
    texts = []
    for size in (5, 12, 30, 62, 70, 110, 400) * 4:
        base = words(r, size).split()
        for changes in (0, size // 20, size // 9, size // 5):
            copy = list(base)
            for i in r.sample(range(size), changes):
                copy[i] = words(r, 1)
            texts.append(" ".join(copy))
    rows = docs(spark, texts)
    want = sorted(jaccard_join.keep_one(rows).select("doc_id").toPandas()["doc_id"])
    weights = np.random.default_rng(8).integers(1, 300, jaccard_join.COUNTERS).astype(np.int16)
    for other in (np.ones_like(weights), weights):
        monkeypatch.setattr(jaccard_join, "gram_weights", lambda *_, other=other: other)
        assert sorted(jaccard_join.keep_one(rows).select("doc_id").toPandas()["doc_id"]) == want
    assert len(want) < len(texts)


def test_jaccard_join_signatures_take_as_many_bytes_in_many_buckets(spark):
    texts = pa.array([" ".join(f"w{i * 200 + k}" for k in range(70 + i % 100)) for i in range(3000)], pa.large_string())
    ids = np.arange(3000) * 7 - 10**17
    batch = pa.RecordBatch.from_arrays([pa.array(ids), texts], ["doc_id", "text"])
    weights = np.ones(jaccard_join.COUNTERS, np.int16)
    took, seen = {}, {}
    for buckets in (12, 600):
        rows = list(jaccard_join._emit_signatures(1, 0.8, weights, buckets)([batch]))
        took[buckets] = sum(x.nbytes for x in rows)
        got = pa.Table.from_batches(jaccard_join._unpack_signatures(rows)).to_pandas()
        seen[buckets] = sorted(zip(got["doc_id"], got["meta"], got["sign"]))
    sets, bounds = jaccard_join._gram_sets(texts, 1)
    row, sign, least, _ = jaccard_join.signatures(sets, bounds, 0.8, weights)
    meta = np.diff(bounds) << 32 | least
    want = sorted(zip(ids[row].tolist(), meta[row].tolist(), sign.astype(np.uint32).view(np.int32).tolist()))
    assert seen[12] == seen[600] == want
    assert took[600] < 10 * len(row)


def test_jaccard_join_sends_no_list_to_find_long_ones(spark, monkeypatch):
    r = random.Random(15)
    base = words(r, 40)
    plans = []
    own = jaccard_join._labelled

    def labelled(lists, *rest):
        plans.append(lists._jdf.queryExecution().optimizedPlan().toString())
        return own(lists, *rest)

    monkeypatch.setattr(jaccard_join, "_labelled", labelled)
    assert jaccard_join.near_duplicate_groups(docs(spark, [base, base + " x", words(r, 40)])).count() == 2
    semi = [line for line in plans[-1].split("\n") if "LeftSemi" in line]
    assert len(semi) == 2 and all("strategy=broadcast" in line for line in semi)


def test_jaccard_join_edges_of_input(spark, odd):
    kept = {r["doc_id"] for r in jaccard_join.keep_one(odd).collect()}
    assert kept == {None, 0, 1, 2, 3, 5, 7, 8}
    assert jaccard_join.near_duplicate_groups(odd.limit(0)).count() == 0


# --- 4: line dedup ---


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_banded_distance():
    r = random.Random(5)
    pairs = []
    for _ in range(400):
        a = [r.choice("abé語") for _ in range(r.randint(0, 14))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = r.choice(("", "a", "b"))
        pairs.append(("".join(a), "".join(b)))
    for tau in (1, 2, 3):
        got = line_dedup.banded_distance([a for a, _ in pairs], [b for _, b in pairs], tau)
        assert got.tolist() == [min(levenshtein(a, b), tau + 1) for a, b in pairs]


def test_similar_lines_are_all_found(spark):
    r = random.Random(7)
    lines = []
    for _ in range(40):
        a = words(r, 5)
        lines.append(a)
        b = list(a)
        for _ in range(r.randint(0, 3)):
            b[r.randrange(len(b))] = r.choice("xyz")
        lines.append("".join(b))
    gone = {(x["doc_id"], n) for x in line_dedup.dropped_lines(docs(spark, ["\n".join(lines)])).collect() for n in x["numbers"]}
    want = {
        (0, j) for j in range(len(lines)) if any(lines[i] == lines[j] or (min(len(lines[i]), len(lines[j])) >= 20 and levenshtein(lines[i], lines[j]) <= 2) for i in range(j))
    }
    assert gone == want


def test_line_dedup_edges_of_input(spark, odd):
    out = line_dedup.drop_repeated_lines(odd)
    assert out.columns == odd.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] is None and got[1] == "" and got[None] == "null id" and got[8] == "\n\n" and 4 not in got and 6 not in got
    assert out.limit(0).count() == 0 and line_dedup.drop_repeated_lines(odd.limit(0)).count() == 0


def test_line_dedup_carries_any_columns(spark):
    d = docs(spark, ["one line of some length here\nb", "one line of some length here\nc"]).withColumnsRenamed({"host": "__dropped", "lang": "__doc", "grams": "kept", "source": "doc", "bucket": "numbers"})
    out = line_dedup.drop_repeated_lines(d)
    assert out.columns == d.columns
    assert [(x["doc_id"], x["text"], x["n_chars"], x["__dropped"], x["doc"]) for x in out.orderBy("doc_id").collect()] == [
        (0, "one line of some length here\nb", 30, "x", "site/a"), (1, "c", 1, "x", "site/a")
    ]


# --- 1: decontamination ---


def test_smith_waterman_and_contaminated(spark, odd):
    r = random.Random(9)
    items = [words(r, 30) for _ in range(5)]
    edited = items[1].split()
    edited[3:5] = ["new", "words", "here"]
    del edited[20]
    texts = [words(r, 200), f"{words(r, 50)} {items[0].upper()} {words(r, 50)}", f"{words(r, 10)} {' '.join(edited)}", words(r, 60)]
    bench = spark.createDataFrame(list(enumerate(items)) + [(90, None), (91, ""), (None, "x y z")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert set(got) == {(1, 0), (2, 1)} and got[1, 0] == 1.0 and 0.7 < got[2, 1] < 1
    assert {x["doc_id"] for x in decontaminate.drop_contaminated(docs(spark, texts), bench).collect()} == {0, 3}
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.drop_contaminated(odd, bench).count() == odd.count()
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def test_decontaminate_is_what_aligning_all_with_all_finds(spark):
    r = random.Random(12)
    items = [words(r, n) for n in (5, 6, 12, 30, 30, 70)] + ["the", "a b", words(r, 4)]
    items[4] = items[3]  # a tie: both are found
    texts = [words(r, 50) + " the a b" for _ in range(10)]
    for item in items[:6] + items[8:]:
        w = item.split()
        for share in (1.0, 0.8, 0.55, 0.3):
            part = w[: max(1, round(len(w) * share))]
            if len(part) > 8:
                part[r.randrange(2, len(part) - 2)] = "edited"
            texts.append(f"{words(r, 20)} {' '.join(part)} {words(r, 20)}")

    def best(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        return h.max() / (2 * len(a))

    want = {}
    for k, item in enumerate(items):
        for d, text in enumerate(texts):
            if len(item.split()) >= decontaminate.MIN_WORDS and (score := best(item.split(), text.split())) >= 0.5:
                want[d, k] = score
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == pytest.approx(want) and any(d < 10 for d, _ in want) is False


def test_decontaminate_finds_a_part_that_is_often_quoted(spark):
    r = random.Random(10)
    item = words(r, 60).split()
    for part in (item[:36], item[12:48], item[24:]):
        texts = [f"{words(r, 20)} {' '.join(part)} {words(r, 20)}" for _ in range(40)] + [words(r, 60) for _ in range(10)]
        bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
        assert {x["doc_id"] for x in decontaminate.contaminated(docs(spark, texts), bench).collect()} == set(range(40))


def test_smith_waterman_scores():
    r = np.random.default_rng(1)
    item = r.integers(1, 6, 12).astype(np.uint64)
    passages = r.integers(1, 6, (30, 25)).astype(np.uint64)

    def plain(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        return h.max()

    assert decontaminate.smith_waterman(item, passages)[0].tolist() == [plain(item, p) for p in passages]


# --- 10: packing ---


def test_packing_loses_nothing(spark, odd):
    r = random.Random(11)
    sizes = [r.randint(1, 50) for _ in range(300)]
    bins = packing.best_two_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= 50 for b in bins)
    assert sum(sizes) / 50 / len(bins) > 0.97
    here = sorted(set(sizes[:20]))
    left = {s: [i for i, x in enumerate(sizes[:20]) if x == s] for s in here}

    def plain(sizes, capacity):
        rest, bins = set(range(len(sizes))), []

        def take(size):
            i = min(i for i in rest if sizes[i] == size)
            rest.remove(i)
            return i

        while rest:
            content, gap = [], capacity
            while fits := [sizes[i] for i in rest if sizes[i] <= gap]:
                content.append(take(max(fits)))
                gap -= max(fits)
            if len(content) > 1 and gap:
                small = sizes[content[-1]]
                two = [(sizes[i] + sizes[j], max(sizes[i], sizes[j]), min(sizes[i], sizes[j])) for i, j in itertools.combinations(rest, 2)]
                total, a, b = max((x for x in two if x[0] <= gap + small), default=(0, 0, 0))
                if total > small:
                    rest.add(content.pop())
                    content += [take(a), take(b)]
            bins.append(content)
        return bins

    for _ in range(60):  # ties are common among so few sizes
        some = [r.randint(1, 25) for _ in range(r.randint(0, 40))]
        assert packing.best_two_fit(some, 30) == plain(some, 30)
    for room in range(1, 100):
        sums = [sizes[i] + sizes[j] for i, j in itertools.combinations(range(20), 2) if sizes[i] + sizes[j] <= room]
        assert sum(packing.best_pair(here, left, room)) == max(sums, default=0)
    out = packing.pack(odd, capacity=1000).collect()
    tokens = Counter()
    for b in out:
        assert b["tokens"] == sum(b["lengths"]) <= 1000
        for d, n in zip(b["doc_ids"], b["lengths"]):
            tokens[d] += n
    assert tokens == {3: 30_000, 4: 30_000, 5: 6, 6: 3, 7: 4}
    assert packing.pack(odd.limit(0)).count() == 0


# --- 3: quality ---


def test_quality_learns_and_shrinks(spark, odd):
    r = random.Random(13)
    good = [words(r, 80).capitalize() + "." for _ in range(60)]
    bad = ["### ".join(["BUY NOW"] * 40) + "%%%" for _ in range(60)]
    d = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    kept = {x["doc_id"] for x in quality.drop_low_quality(d, labels).collect()}
    assert kept == set(range(60))
    out = quality.drop_low_quality(odd, labels)
    assert out.columns == odd.columns and {1, 2, 0}.isdisjoint({x["doc_id"] for x in out.collect()})
    assert quality.drop_low_quality(odd.limit(0), labels).count() == 0 and quality.drop_low_quality(d, labels.limit(0)).count() == 120
    clash = d.withColumnsRenamed({"host": "llr", "grams": "__llr", "bucket": "doc"})
    assert quality.drop_low_quality(clash, labels).columns == clash.columns


def test_quality_rejects_toxic_words_and_counts_long_texts(spark):
    r = random.Random(14)
    texts = [words(r, 60) for _ in range(200)]
    texts = [t if i % 4 else f"{t[:40]} moron {t[40:]}" for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 200) if i < 150], "doc_id long, quality int, toxic int")
    assert {x["doc_id"] for x in quality.drop_low_quality(docs(spark, texts), labels).collect()} == {i for i in range(200) if i % 4}
    long = quality.features(pa.array(["word " * 700_000, "word " * 7], pa.large_string()))
    assert long[0, 8] == long[1, 8] == 4.0


def test_quality_is_what_plain_python_makes_of_it(spark):
    r = random.Random(15)
    places = [("a/x", 30), ("a/y", 1), ("b/x", 40), ("b/z", 2), ("c", 3), (None, 2)]
    rows, labels = [], []
    for source, n in places:
        for _ in range(n):
            i = len(rows)
            good = r.random() < (0.9 if source == "a/x" else 0.4)
            rows.append((i, words(r, 20).capitalize() + "." if good else "BUY ### " + words(r, 12) + " %% !!", source, "en"))
            if i % 2:
                labels.append((i, int(good if r.random() < 0.9 else not good), 0))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(d, t)
    llr = quality.evidence(quality.features(pa.array([x[1] for x in rows], pa.large_string()), model["toxic"]), model)
    p = 1 / (1 + np.exp(-(llr + model["prior"])))
    place = [((s or "").split("/")[0], (s or "").split("/")[1] if "/" in (s or "") else "~en") for _, _, s, _ in rows]
    overall = (p.sum() + 0.5) / (len(p) + 1)

    def strength(n, mean, of):
        n, mean, of = (np.array(x, float) for x in (n, mean, of))
        level = (n * of * (1 - of)).sum() / n.sum()
        beyond = max((n * (mean - of) ** 2).sum() / n.sum() - (of * (1 - of)).sum() / n.sum(), 1e-6)
        return max(1.0, min(1e6, level / beyond - 1))

    hosts = {h: [p[k] for k in range(len(p)) if place[k][0] == h] for h, _ in place}
    kh = strength([len(v) for v in hosts.values()], [np.mean(v) for v in hosts.values()], [overall] * len(hosts))
    rate = {h: (sum(v) + kh * overall) / (len(v) + kh) for h, v in hosts.items()}
    paths = {q: [p[k] for k in range(len(p)) if place[k] == q] for q in place}
    kp = strength([len(v) for v in paths.values()], [np.mean(v) for v in paths.values()], [rate[h] for h, _ in paths])
    got = {x["doc_id"]: x for x in quality.judged(d, t).select("doc.doc_id", "rate", "posterior").collect()}
    for k in range(len(p)):
        h, own = hosts[place[k][0]], paths[place[k]]
        above = (sum(h) - p[k] + kh * overall) / (len(h) - 1 + kh)
        want = (sum(own) - p[k] + kp * above) / (len(own) - 1 + kp)
        assert got[k]["rate"] == pytest.approx(want, rel=1e-6)
        assert got[k]["posterior"] == pytest.approx(1 / (1 + np.exp(-(np.log(want / (1 - want)) + llr[k]))), rel=1e-6)


# --- 8: language ---


def test_language(spark, odd):
    r = random.Random(17)
    texts = [words(r, 40) for _ in range(30)] + [words(r, 40).translate(str.maketrans("abcdefghij", "qrstuvwxyz")) for _ in range(30)]
    d = spark.createDataFrame([(i, t, "en" if i < 30 else "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trees = language.train(d)
    assert all(x["language"] == ("en" if x["doc_id"] < 30 else "xx") for x in language.identify(d, trees).collect())
    got = {x["doc_id"]: x["language"] for x in language.identify(odd, trees).collect()}
    assert got[0] is None and got[1] is None and got[3] == "en"
    assert {x["language"] for x in language.identify(d, language.train(d.limit(0))).collect()} == {None}

    def plain(sample, text):
        """Bits of a text by escapes from order 3 down, without exclusion."""
        counts = [Counter() for _ in range(4)]
        for s in sample:
            for o in range(4):
                counts[o].update((s[i : i + o], s[i + o]) for i in range(len(s) - o))
        total = 0.0
        for i, c in enumerate(text):
            for o in range(min(3, i), -2, -1):
                if o < 0:
                    total += 8
                    break
                after = {x: n for (k, x), n in counts[o].items() if k == text[i - o : i]}
                n, kinds = sum(after.values()), len(after)
                if c in after:
                    total -= np.log2(after[c] / (n + kinds))
                    break
                total -= np.log2(kinds / (n + kinds)) if n else 0
        return total

    sample = [b"the cat sat on the mat", b"the dog ate"]
    twins = language.train(spark.createDataFrame([(1, "same words here", "xx"), (2, "same words here", "aa")], "doc_id long, text string, lang string"))
    assert [(x["language"], x["margin"]) for x in language.identify(d.limit(1), twins).collect()] == [("aa", 0.0)]  # a tie
    assert language.identify(odd.limit(0), trees).count() == 0
    data = b"the hat met a zebra"
    t = language.Trees({"a": sample, "b": [b"other things"]})
    assert t.bits(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0, 0] == pytest.approx(plain(sample, data), rel=1e-4)


# --- 5: WARC ---


def test_capture_index_and_round_trip(spark, tmp_path):
    r = random.Random(19)
    rows = [(i, r.choice(("http://www.A.com/x/?b=2&a=1&utm_s=3", "https://a.com/x?a=1&b=2", "http://b.org/", None, "")), r.choice((None, "", "<p>é</p>"))) for i in range(200)]
    pages = spark.createDataFrame(rows + [(None, "http://c.com", "x")], "page_id long, url string, html string").repartition(5)
    got = capture_index.merged_index(pages).orderBy("position").collect()
    keys = [(x["url_key"], x["ts"], x["page_id"]) for x in got]
    assert keys == sorted(keys) and [x["position"] for x in got] == list(range(1, 201))
    assert {x["url_key"] for x in got} == {"com,a)/x?a=1&b=2", "org,b)", ")"}
    assert capture_index.merged_index(pages.limit(0)).count() == 0
    runs = [sorted(r.choices(range(9), k=r.randint(0, 6))) for _ in range(7)]
    order = list(capture_index.LoserTree([[(x, k) for x in run] for k, run in enumerate(runs)]))
    assert [x for _, x in order] == sorted((x, k) for k, run in enumerate(runs) for x in run) and list(capture_index.LoserTree([])) == []
    # ranges that cut through the captures of a URL, repeated rows, other columns
    key = {i: {"http://www.A.com/x/?b=2&a=1&utm_s=3": "com,a)/x?a=1&b=2", "https://a.com/x?a=1&b=2": "com,a)/x?a=1&b=2", "http://b.org/": "org,b)"}.get(u, ")") for i, u, _ in rows}
    want, last = [], {}
    for i, u, h in sorted(rows + rows[:7], key=lambda x: (key[x[0]], x[0])):
        n, before, digest = last.get(key[i], (0, None, None))
        want.append((len(want) + 1, key[i], i, n + 1, before, digest is None or digest != (h or "")))
        last[key[i]] = (n + 1, i, h or "")
    twice = spark.createDataFrame(rows + rows[:7], "page_id long, url string, html string").selectExpr("*", "1 AS ts", "2 AS range", "3 AS at").repartition(6)
    for ranges in (1, 4, 50):
        got = [(x["position"], x["url_key"], x["page_id"], x["capture"], x["previous_ts"], x["changed"]) for x in capture_index.merged_index(twice, ranges).orderBy("position").collect()]
        stamps = {x["page_id"]: x["ts"] for x in capture_index.captures(twice).collect()}
        assert got == [(*w[:4], stamps.get(w[4]), w[5]) for w in want]
    capture_index.write_warc(pages, str(tmp_path / "w"))
    # files as others write them: ids that are no numbers, an info record, HTTP heads, several records in a member, other charsets
    def record(kind, body, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:12-ab>", "Content-Length": str(len(body)), **more}
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n<p>\xe9</p>"
    uri = {"WARC-Target-URI": "http://x.org/", "WARC-Date": "2024-01-02T03:04:05.123Z"}
    foreign = record("warcinfo", b"software: x") + record("response", http, **uri) + record("request", b"GET /", **uri)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.warc.gz").write_bytes(gzip.compress(foreign) + gzip.compress(record("resource", b"\xff\xfe", **uri)) + b"\0" * 9)
    (tmp_path / "f" / "b.warc").write_bytes(foreign)
    (tmp_path / "f" / "c.warc.gz").write_bytes(b"".join(gzip.compress(record("resource", b"x" * 100)) for _ in range(20_000)))
    got = capture_index.read_warc(spark, str(tmp_path / "f")).collect()
    assert len(got) == 20_003 and all(x["page_id"] is None for x in got)
    assert {(x["url"], x["ts"], x["html"]) for x in got} == {("http://x.org/", "20240102030405", "<p>é</p>"), ("http://x.org/", "20240102030405", "\ufffd\ufffd"), (None, None, "x" * 100)}
    back = {x["page_id"]: (x["url"], x["html"]) for x in capture_index.read_warc(spark, str(tmp_path / "w")).collect()}
    assert back == {i: (u or "", h or "") for i, u, h in rows}


# --- 2: site style tree ---


def test_site_style_tree(spark):
    page = '<html><body><nav class="n"><a href="/">Home</a> <a href="/b">About us</a></nav><div id=c><p>{}<p>More &amp; {}</div><footer>All rights</footer><script>x("</p>")</script></body></html>'
    r = random.Random(23)
    rows = [(i, "http://www.site.com/" + str(i), page.format(words(r, 9), words(r, 5))) for i in range(30)]
    more = [(100, "http://alone.com/", "<p>Only <b>one</b> page"), (101, None, None), (102, "x", ""), (103, "http://deep.com", "<div>" * 3000 + "deep"), (None, "u", "v"), (104, "http://alone2.com", "a < b <p 'x")]
    pages = spark.createDataFrame(rows + more, "page_id long, url string, html string").withColumns({"host": pages_lit("q"), "node": pages_lit("z")})
    out = {x["page_id"]: x for x in site_style_tree.extract(pages).collect()}
    for i, _, source in rows:
        assert "Home" not in out[i]["text"] and "All rights" not in out[i]["text"] and "More & " in out[i]["text"] and out[i]["n_removed"] >= 1
    assert out[100]["text"] == "Only one page" and out[101]["text"] == out[102]["text"] == "" and out[103]["text"] == "deep" and None not in out
    joined = {x["page_id"]: x for x in site_style_tree.extract(pages, broadcast_nodes=-1).collect()}
    assert joined == out
    assert site_style_tree.extract(pages.limit(0)).count() == 0
    nodes = {(x["depth"], x["pages"], round(x["importance"], 6)) for x in site_style_tree.style_tree(pages).collect()}
    assert (0, 30, 0.0) in nodes  # one style on all pages


def test_style_tree_is_what_its_definition_says(spark):
    r = random.Random(24)
    blocks = ["<div class=a><p>{}</p><a href='/x'>link</a></div>", "<ul><li>{}<li>fixed</ul>", "<div class=b>same words</div>", "<p>{}", "<table><tr><td>{}<td>cell</table>"]
    rows = []
    for i in range(40):
        some = [b.format(r.choice(("red", "green", words(r, 2)))) for b in r.choices(blocks, k=r.randint(1, 3))]
        rows.append((i, f"http://h{i % 2}.org/", "<nav>menu</nav>" + "".join(some)))
    rows += [(50, "http://h0.org/", ""), (51, "http://h0.org/", rows[0][2]), (51, "http://h0.org/", rows[0][2])]  # empty and repeated rows
    seen = {}  # node: (parent style, depth, occurrences)
    for _, url, source in rows:
        page = site_style_tree.Page(url[7:13].removesuffix("/"), source)
        for k in range(len(page.sign)):
            kids = tuple(page.node[j] for j in page.kids[k])
            seen.setdefault(page.node[k], (page.depth[k], []))[1].append((page.style[k] if kids else None, kids, frozenset(page.features[k])))

    def entropy(counts, base):
        return -sum(n / base * np.log(n / base) for n in counts) / np.log(base)

    made = {}

    def judge(node):
        if node in made:
            return made[node]
        depth, found = seen[node]
        m = len(found)
        styles = Counter(s for s, _, _ in found if s is not None)
        if m == 1:
            made[node] = (1.0, 1.0, False)
        elif styles:
            own = max(0.0, entropy([*styles.values(), *[1] * (m - sum(styles.values()))], m))
            below = [np.mean([judge(k)[1] for k in kids]) if styles[s] > 1 else 1.0 for s, kids, _ in found if s is not None] + [1.0] * (m - sum(styles.values()))
            passed = 0.9 ** len(styles)
            whole = (1 - passed) * own + passed * np.mean(below)
            quiet = all(s is not None and styles[s] > 1 and all(judge(k)[2] for k in kids) for s, kids, _ in found)
            made[node] = (own, whole, quiet and whole < site_style_tree.THRESHOLD)
        else:
            features = Counter(f for _, _, fs in found for f in fs)
            own = max(0.0, 1 - np.mean([np.log(n) / np.log(m) for n in features.values()])) if features else 0.0
            made[node] = (own, own, own < site_style_tree.THRESHOLD)
        return made[node]

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {x["node"] & (2**64 - 1): (x["importance"], x["composite"], x["noisy"]) for x in site_style_tree.style_tree(pages).collect()}
    want = {n: judge(n) for n, (_, found) in seen.items() if len(found) > 1}
    assert set(got) == set(want) and {x[2] for x in want.values()} == {True, False}
    for n in want:
        assert got[n][:2] == pytest.approx(want[n][:2], abs=1e-9) and got[n][2] == want[n][2]


def test_broken_pages_take_time_in_proportion():
    for bit in ("<!--", "<script>", "<b>x", "<a '", '<p "', "<i>x</b>", "<a href='x'>y", "</div"):
        took = []
        for n in (10_000, 80_000):
            began = time.perf_counter()
            site_style_tree.Page("h", bit * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 40 * max(took[0], 0.02)


def pages_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


# --- 9: audio ---


def test_audio(spark, tmp_path):
    x = np.sin(np.arange(3000) / 5).astype(np.float32)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / audio.FRAME)
    k = np.arange(audio.FRAME // 2 + 1)[:, None]
    frame = x[audio.HOP : audio.HOP + audio.FRAME] * window
    plain = np.abs((frame * np.exp(-2j * np.pi * k * np.arange(audio.FRAME) / audio.FRAME)).sum(axis=1))
    np.testing.assert_allclose(audio.stft(x)[1], plain, atol=1e-2)
    s = np.random.default_rng(2).random((9, 20)).astype(np.float32) * 5
    f, b = audio.peaks(s)
    want = [(i, j) for i in range(9) for j in range(20) if s[i, j] == s[max(0, i - 2) : i + 3, max(0, j - 6) : j + 7].max() and s[i, j] > 2 * s[i].mean()]
    assert list(zip(f.tolist(), b.tolist())) == want
    tune = audio.tune(np.random.default_rng(3).normal(size=64))
    rate, back = audio.read_wav(audio.write_wav(tune, 8000))
    assert rate == 8000 and np.abs(back - tune).max() < 1e-3
    assert audio.read_wav(b"RIFF") is None and audio.read_wav(None) is None
    part = audio.write_wav(tune[audio.HOP * 20 :], 8000)
    # blocks of frames give what the whole recording at once gives
    noise = audio.write_wav(np.random.default_rng(5).normal(size=70_000).clip(-1, 1), 8000)
    plain = audio.pairs(*audio.peaks(audio.stft(audio.read_wav(noise)[1])))
    for block in (1, 7, 100, 4096):
        got = audio.fingerprint(noise, block)
        assert got[:2] == (8000, 70_000) and all(np.array_equal(a, b) for a, b in zip(got[2:], plain))
    ahead = [(f, b) for f, b in zip(*(x.tolist() for x in audio.peaks(audio.stft(audio.read_wav(noise)[1]))))]
    want = sorted((f, b << 32 | c << 16 | g - f) for f, b in ahead for g, c in [x for x in ahead if x[0] > f][: audio.FAN_OUT] if g - f <= audio.AHEAD)
    assert list(zip(*(x.tolist() for x in plain))) == want
    (tmp_path / "a.wav").write_bytes(audio.write_wav(tune, 8000))
    assert audio.read_wav_files(spark, str(tmp_path)).count() == 1
    rows = [("whole", audio.write_wav(tune, 8000)), ("null", None), ("bad", b"x"), ("none", audio.write_wav(np.zeros(0), 8000)), ("flat", audio.write_wav(np.zeros(5000), 8000)), (None, part)]
    media = spark.createDataFrame(rows, "name string, wav binary")
    got = {x["name"]: x for x in audio.fingerprints(media, "name", "wav").collect()}
    assert got["null"]["times"] is None and got["bad"]["rate"] is None and got["none"]["times"] == [] and got["flat"]["n_pairs"] == 0
    prints = audio.fingerprints(media, "name", "wav")
    hit = audio.matches(prints.where("name = 'whole'"), prints.where("name is null").fillna("part", ["name"]), "name").first()
    assert hit["offset"] == 20 and hit["votes"] > 50


# --- 7: personal data ---


def test_crf_and_lstm_gradients():
    r = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in pii.fresh(3, 1).items()}
    x, y = r.integers(0, pii.V, (6, 4)), r.integers(0, pii.K, (6, 4))
    _, g = pii.loss_and_gradient(p, x, y)
    for name in ("xf", "hb", "of", "trans", "bias"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        ends = []
        for step in (1e-2, -1e-2):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            ends.append(pii.loss_and_gradient(q, x, y)[0])
        assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(g[name][at], rel=0.05)


def test_pii_decoding_is_exact_and_windows_agree():
    r = np.random.default_rng(6)
    model = pii.Model(pii.fresh(4, 2))
    e = r.normal(size=(7, pii.K, 5)).astype(np.float32)
    got = model.decode(e, np.full(5, 7))
    for w in range(5):
        best = max(itertools.product(range(pii.K), repeat=4), key=lambda y: sum(e[t, y[t], w] for t in range(4)) + sum(model.trans[a, b] for a, b in zip(y, y[1:])))
        assert tuple(model.decode(e[:4, :, w : w + 1], np.array([4]))[0]) == best
    assert got.shape == (5, 7)


def test_pii_finds_held_out_spans(spark, odd):
    model = pii.trained()
    r = random.Random(77)
    rows = [pii.sentence(r, 400) for _ in range(150)]
    x = [pii._encoded(t) for t, _ in rows]
    got = model.labels(np.concatenate(x), np.concatenate([[0], np.cumsum([len(v) for v in x])]))
    want = np.concatenate([y for _, y in rows])
    assert (got == want)[want > 0].mean() > 0.97 and (got == want)[got > 0].mean() > 0.97
    text = words(r, 900) + " mail é ana.19@mail5.example.com now"
    found = pii.find_pii(docs(spark, [text, "call +1 (743) 555-3824 or 88.41.79.216"]), model).collect()
    assert [(f["doc_id"], f["kind"]) for f in found] == [(0, "email"), (1, "phone"), (1, "ip")]
    assert text[found[0]["start"] : found[0]["end"]] == "ana.19@mail5.example.com"
    assert pii.redacted(docs(spark, [text]), model).first()["text"].endswith("mail é [email] now")
    assert pii.find_pii(odd, model).count() == 0 and pii.redacted(odd, model).columns == odd.columns and pii.find_pii(odd.limit(0), model).count() == 0


# --- the pipeline and the shared text work ---


def test_words_and_grams():
    texts = ["Ab, cd_1 É×x", "", "one", "a b c d"]
    w = tb.words(tb.string_array(pa.array([*texts, None])))
    assert np.diff(w.first).tolist() == [4, 0, 1, 4, 0]
    g, bounds = tb.grams(w, 2)
    assert np.diff(bounds).tolist() == [3, 0, 1, 3, 0]


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    r = random.Random(29)
    good = [words(r, 80).capitalize() + "." for _ in range(40)]
    item = words(r, 30)
    texts = [*good, good[0], f"{words(r, 40)} {item} {words(r, 40)}", *["### ".join(["BUY NOW"] * 40)] * 30]
    folder = str(tmp_path)
    docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 42), 0) for i in range(72)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for rows in (odd, odd.limit(0), odd.withColumnsRenamed({"host": "llr", "grams": "kept"})):  # nulls, empty and long texts, repeated rows, other columns
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, folder)
            assert out.columns == rows.columns if name != "packing" else "doc_ids" in out.columns
            assert name == "packing" or out.count() <= rows.count()
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {d for b in packed for d in b["doc_ids"]} == set(range(40))
