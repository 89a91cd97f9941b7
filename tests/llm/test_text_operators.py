"""Operators over documents, against plain versions and on odd rows."""

import hashlib
import math
import random
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casesafety.llm import components, decontaminate, features, licenses, mixing, nbsvm, quality, queries, simhash, tokens, toxicity

ODD = [(1, None, None), (2, "", "a"), (3, " \n\t", "a"), (4, "one", "b"), (4, "one", "b"), (5, "é " * 30000, "b"), (6, "One", None), (None, "no id", "a")]


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = ["label", "score", "size", "rank", "target", "fp", "words", "item_id", "key", "path", "n", "lang"]
    return df.withColumns({c: F.lit("x") for c in names}) if extra else df


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, duck, sf_dir, name):
    got = duck.execute(queries.ORACLE_SQL[name])
    ours, theirs = same_rows(queries.QUERIES[name](spark, sf_dir), got.fetchall(), [c[0] for c in got.description])
    assert ours == theirs and ours


# Mixing.
def test_targets_are_filled_up_to_their_limits(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 100), ("d", 5), (None, 40)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    weight, size = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, {"a": 1000, "b": 10, "c": 100, "d": 5, None: 40}
    target, free, left = {}, set(size), 1155.0
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] if s in full else share * weight[s] for s in (full or free)}
        left -= sum(3 * size[s] for s in full)
        free = free - full if full else set()
    assert got == pytest.approx(target) and sum(got.values()) == pytest.approx(1155)


def test_mix_takes_each_target(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    taken, target, longest = Counter(), {}, max(r["size"] for r in rows)
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= longest for s, t in target.items())
    assert sum(taken.values()) == sum(r["size"] for r in rows)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))


def test_mix_of_odd_rows(spark):
    rows = mixing.mix(documents(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    assert {r["doc_id"]: r["size"] for r in rows} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 30000, 6: 1, None: 2}
    assert all(r["taken"] == 0 for r in rows if not r["size"]) and sum(r["taken"] for r in rows) == 30005
    assert mixing.mix(documents(spark, [])).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(documents(spark, ODD[:3])).collect())


def test_mix_of_like_rows(spark, monkeypatch):
    """Rows without an id, and one id on a third of the rows, against a plain queue; the copies of a row dealt to one task or to many."""
    rows = [(None, "w " * (1 + k % 3), "a") for k in range(400)] + [(7, "one two", s) for s in "ab" for _ in range(150)] + [(k, "w " * (k % 7), "b") for k in range(10, 300)]
    docs = documents(spark, rows, extra=False)
    got = Counter(map(tuple, mixing.mix(docs).select("doc_id", "source", "size", "taken").collect()))
    order = lambda k: int(hashlib.md5(f"{'' if k is None else k}|1".encode()).hexdigest()[:13], 16)
    targets = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(spark.createDataFrame([(s, len(t.split())) for _, t, s in rows], "source string, size long")).collect()}
    queue, want, left = [], Counter(), sum(len(t.split()) for _, t, _ in rows)
    for rank, source in enumerate(sorted(targets)):
        total, target = targets[source]
        upto = 0
        for n, (k, t) in enumerate(sorted(((k, t) for k, t, s in rows if s == source), key=lambda x: (order(x[0]), len(x[1].split())))):
            size = len(t.split())
            upto += size
            queue += [((p * total + upto) / target, rank, p, upto, (k, source, size, n)) for p in range(3) if size]
            want[k, source, size, n] += 0
    for *_, doc in sorted(queue, key=lambda x: x[:4]):
        want[doc] += min(doc[2], left)
        left -= min(doc[2], left)
    assert got == Counter((k, s, size, taken) for (k, s, size, _), taken in want.items()) and left == 0
    monkeypatch.setattr(mixing, "COPIES", 16)
    assert Counter(map(tuple, mixing.mix(docs).select("doc_id", "source", "size", "taken").collect())) == got


# SimHash.
def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(fps):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    known = list(fps)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprints_match_sparks_hash_and_the_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    got = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(docs).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] % 2**64 == plain_fingerprint(r["text"])
    one = spark.createDataFrame([(1, "Öl Three WORDS")], "doc_id long, text string")
    assert simhash.fingerprints(one).first()["fp"] == one.select(F.xxhash64(F.lit("Öl three words"))).first()[0]


@pytest.mark.parametrize("hot", [1, 3, 256])
def test_links_join_what_all_pairs_join(spark, hot):
    rng = random.Random(hot)
    fps = set()
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(14):
            fps.add(f)
            for _ in range(rng.choice([1, 2, 3, 3, 4])):
                f ^= 1 << rng.choice([*range(10), *range(60, 64)])
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r["node"]: r["root"] for r in components.connected_components(simhash.links(df, hot)).collect()}
    mine, plain = defaultdict(set), defaultdict(set)
    for f, p in plain_components({f % 2**64 for f in signed}).items():
        plain[p].add(f)
    for f in signed:
        mine[got.get(f, f)].add(f % 2**64)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, plain.values()))


def test_near_duplicates_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = simhash.near_duplicates(docs).collect()
    roots = plain_components({r["fp"] % 2**64 for r in rows})
    least = {}
    for r in rows:
        k = roots[r["fp"] % 2**64]
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least[roots[r["fp"] % 2**64]] for r in rows)
    kept = simhash.keep_first(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_near_duplicates_of_odd_rows(spark):
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(documents(spark, ODD[:-1])).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 4)]
    docs = documents(spark, ODD).withColumns({"times": F.lit("x"), "row": F.lit("x"), "hash": F.lit("x"), "root": F.lit("x")})
    kept = simhash.keep_first(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "no id"), (1, None), (4, "one"), (5, "é " * 30000)]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_one_row_of_each_component_is_kept(spark):
    near = "one two three four five six seven eight nine ten " * 30
    rows = [*ODD, (None, "no id", "c"), (None, "alone and without an id", "a"), (9, "first text of a shared id", "a"), (9, "quite another wording here", "b"), (8, near, "a"), (9, near, "b"), (9, near + " ", "c")]
    docs = documents(spark, rows)
    kept = simhash.keep_first(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"] or 0), r["text"]) for r in kept.collect())
    assert got == sorted([(0, "no id"), (0, "alone and without an id"), (1, None), (4, "one"), (5, "é " * 30000), (8, near), (9, "first text of a shared id"), (9, "quite another wording here")], key=lambda x: (x[0], x[1] or ""))


def test_mixed_rows_are_known_by_id_and_text(spark):
    import corpus_pipeline

    docs = documents(spark, [*ODD, (4, "two words", "b"), (None, "another without id", "a"), (None, "no id", None)], extra=False)
    got = corpus_pipeline.mixed_sources(spark, docs, "").collect()
    taken = [r["taken"] for r in mixing.mix(docs).collect() if r["taken"]]
    assert sorted(r["taken"] for r in got) == sorted(taken) and {(r["doc_id"], r["text"]) for r in got if r["doc_id"] is None} == {(None, "no id"), (None, "another without id")}
    assert all(r["size"] == len(r["text"].split()) for r in got)


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(0, 100)] + [(7, 7), (500, 400), (400, 500)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(df).collect()}
    assert got == {i: 0 for i in range(101)} | {400: 400, 500: 400}
    assert components.connected_components(df.limit(0)).count() == 0


# Decontamination.
def plain_contained(docs, items, threshold=0.8):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    return sorted((d, i) for d, t in docs for i, x in items if shingles(x) and len(shingles(x) & shingles(t)) >= threshold * len(shingles(x)) - 1e-9)


def test_contained_items_match_the_plain_version(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 5, 6, 20, 60])))) for k in range(30)] + [(98, ""), (99, None)]
    docs = []
    for k in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randrange(200)))]
        for _, t in rng.sample(items[:30], 2):
            w = t.upper().split()
            cut = rng.choice([0, 0, 1, 2, len(w) // 6, len(w) // 3])
            parts += [" ".join(w[cut:]), " ".join(rng.choices(words, k=rng.randrange(50)))]
        docs.append((k, "\n".join(parts)))
    docs += [(500, None), (501, ""), (502, items[0][1]), (502, items[0][1])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    want = plain_contained(docs, items)
    assert want and sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(d, i).collect()) == want
    left = sorted(k for k, _ in docs if k not in {x for x, _ in want})
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(d, i).collect()) == left
    shares = sorted((r["doc_id"], r["item_id"], r["containment"]) for r in decontaminate.contained_items(d, i).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)  # too large to be broadcast
    for bits in (1 << 26, 1 << 6):  # the map of bits may be as full as it likes
        monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
        assert sorted((r["doc_id"], r["item_id"], r["containment"]) for r in decontaminate.contained_items(d, i).collect()) == shares
    clean = decontaminate.decontaminated(d, i)
    assert sorted(r["doc_id"] for r in clean.collect()) == left and clean.columns == d.columns


@pytest.mark.parametrize("words", [decontaminate.BLOCK_WORDS, 0])
def test_decontamination_of_odd_rows(spark, monkeypatch, words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
    items = spark.createDataFrame([(1, "one"), (1, "one")], "item_id long, text string")
    docs = documents(spark, ODD)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs, items).collect()) == [(4, 1)] * 4 + [(6, 1)] * 2
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0 and decontaminate.decontaminated(docs, items.limit(0)).count() == len(ODD)
    assert decontaminate.contained_items(documents(spark, []), items).count() == 0


def test_one_very_long_item(spark):
    """An item of 600,000 words is more than is broadcast; it is found in a longer document, and in no other."""
    item = " ".join(f"w{k}" for k in range(600_000))
    items = spark.createDataFrame([(1, item), (2, "a short item of six words"), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, item[: len(item) // 2]), (3, "here is A Short item of six words in text"), (None, "clean text of a document")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs, items).collect()) == [(1, 1), (3, 2)]
    assert [r["doc_id"] for r in decontaminate.decontaminated(docs, items).collect()] in ([2, None], [None, 2])


@pytest.mark.parametrize("words", [decontaminate.BLOCK_WORDS, 0])
def test_items_without_an_id_count(spark, monkeypatch, words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
    items = spark.createDataFrame([(None, "one"), (None, "no id"), (1, "absent")], "item_id long, text string")
    docs = documents(spark, ODD)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs, items).collect()}
    assert got == {(4, None), (6, None), (None, None)}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, items).collect()) == [1, 2, 3, 5]


# Classifiers.
def test_held_out_accuracy(spark):
    """On rows that were not learned from, both find most of their class and are far better than always answering the same."""
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, label, least_recall, least_precision in ((queries.op8_quality, "quality", 0.95, 0.95), (queries.op10_toxicity, "toxic", 0.65, 0.7)):
        rows = [(r["predicted"], labels[r["doc_id"]][label], r["score"]) for r in query(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
        hit = sum(p and y for p, y, _ in rows)
        recall, precision = hit / sum(y for _, y, _ in rows), hit / max(1, sum(p for p, _, _ in rows))
        constant = max(np.mean([y for _, y, _ in rows]), 1 - np.mean([y for _, y, _ in rows]))
        accuracy = np.mean([p == y for p, y, _ in rows])
        assert recall >= least_recall and precision >= least_precision, (label, recall, precision)
        assert 1 - accuracy <= 0.6 * (1 - constant) and all(0 <= s <= 1 for _, _, s in rows), (label, accuracy, constant)


def test_classifiers_on_odd_rows(spark):
    docs = documents(spark, ODD)
    none = spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    for fit, score in ((quality.fit_quality, quality.quality_scores), (toxicity.fit_toxicity, toxicity.toxicity_scores)):
        for labels in (none, none.limit(0)):
            rows = score(docs, fit(docs, labels)).collect()
            assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert score(documents(spark, []), fit(documents(spark, []), none)).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(60)]
    y = np.where([0 in r or 1 in r for r in rows], 1.0, -1.0)
    ratio = nbsvm.log_count_ratio(rows, y, 12, 1.0, 1)
    cost = np.full(60, 0.7)
    w, b = nbsvm.dual_coordinate_descent(rows, y, ratio, cost, 3000, 1)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, 12] = 1.0
    value = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best = np.r_[w, b]
    assert all(value(best) <= value(best + rng.normal(size=13) * s) + 1e-3 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_distinct_keeps_each_bucket_once():
    d = nbsvm.Distinct(6)
    for _ in range(20):
        h = np.random.default_rng(_).integers(0, 1 << 32, 100, dtype=np.uint32)
        assert sorted(d([h])) == sorted(set((h & np.uint32(63)).tolist()))
    assert len(d([])) == 0


def plain_char_grams(text):
    t = f" {text.lower()} "
    return {t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)} if text else set()


def plain_shape_grams(text):
    def shape(words, i):
        w = words[i]
        upper, letter = (lambda c: c.isupper()), (lambda c: c.isalpha())
        last = w[-1]
        kind = "letter" if letter(last) else "digit" if last.isdigit() else last
        return (kind, upper(w[0]), len(w) > 1 and upper(w[1]), len(w) == 1, i > 0 and w == words[i - 1])

    words = text.split()
    shapes = [shape(words, i) for i in range(len(words))]
    return {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)} | {tuple(shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)}


@pytest.mark.parametrize(("plain", "featurizer"), [(plain_char_grams, features.lower_char_ngrams), (plain_shape_grams, features.shape_and_char_ngrams)])
def test_features_are_those_of_the_plain_version(plain, featurizer):
    texts = ["Hello hello world, 42!", "", "a", "Ab  AB ab. Ab ab.", "one two one two one two", "Straße ÉTÉ été 3rd (x)"]
    seen = {}
    for t in texts:
        mine = {int(h) for a in featurizer(t) for h in a}
        assert len(mine) == len(plain(t))
        seen[t] = mine
    for a in texts:  # two texts share as many hashes as they share n-grams
        for b in texts:
            assert len(seen[a] & seen[b]) == len(plain(a) & plain(b))


def plain_scores(docs, labels, plain, alpha, min_df, c):
    """Naive Bayes ratios, the same hinge-loss problem solved by another method (projected coordinate steps on a dense kernel until still), and the curve through left-out margins."""
    rows = sorted((d, y, plain(t or "")) for d, t in docs for i, y in labels if i == d)
    rows = [(y, g) for _, y, g in rows]
    n1 = sum(y for y, _ in rows)
    cost = [c * len(rows) / (2 * (n1 if y else len(rows) - n1)) for y, _ in rows]

    def solved(part):
        p, q = Counter(), Counter()
        for k in part:
            (p if rows[k][0] else q).update(rows[k][1])
        every = {g for k in part for g in rows[k][1] if p[g] + q[g] >= min_df}
        size = 1 << BITS
        sp, sq = sum(p.values()) + alpha * size, sum(q.values()) + alpha * size
        r = {g: math.log((p[g] + alpha) / sp) - math.log((q[g] + alpha) / sq) for g in every}
        unit = lambda gs: {g: r[g] / z for g in gs if g in r} if (z := max(1e-9, math.sqrt(sum(r.get(g, 0) ** 2 for g in gs)))) else {}
        x = [unit(rows[k][1]) for k in part]
        y = np.array([1.0 if rows[k][0] else -1.0 for k in part])
        kernel = np.array([[sum(v * b.get(g, 0) for g, v in a.items()) + 1 for b in x] for a in x]) * np.outer(y, y)
        a, top = np.zeros(len(part)), np.array([cost[k] for k in part])
        for _ in range(20000):
            for i in range(len(part)):
                a[i] = min(max(a[i] - (kernel[i] @ a - 1) / kernel[i, i], 0), top[i])
            grad = kernel @ a - 1
            if np.abs(a - np.clip(a - grad, 0, top)).max() < 1e-7:
                break
        return lambda gs: sum(a[i] * y[i] * (sum(v * x[i].get(g, 0) for g, v in unit(gs).items()) + 1) for i in range(len(part)))

    held, fold = [0.0] * len(rows), [sum(z == y for z, _ in rows[:i]) % 3 for i, (y, _) in enumerate(rows)]
    for k in range(3):
        f = solved([i for i in range(len(rows)) if fold[i] != k])
        for i in range(len(rows)):
            if fold[i] == k:
                held[i] = f(rows[i][1])
    f = solved(list(range(len(rows))))
    slope, shift = nbsvm.logistic_fit(np.array(held), np.array([1.0 if y else -1.0 for y, _ in rows]))
    return {d: 1 / (1 + math.exp(-(slope * f(plain(t or "")) + shift))) for d, t in docs}


BITS = 18


@pytest.mark.parametrize(("label", "plain", "featurizer"), [("quality", plain_shape_grams, features.shape_and_char_ngrams), ("toxic", plain_char_grams, features.lower_char_ngrams)])
def test_classifiers_match_the_plain_version(spark, label, plain, featurizer):
    rng = random.Random(8)
    good, bad = "calm kind warm mild fair nice".split(), "vile foul rude mean Nasty! CRUEL!".split()
    docs = [(k, " ".join(rng.choices(bad if k % 3 == 0 else good, k=rng.randrange(3, 9)) + rng.choices(good + bad, k=2))) for k in range(36)] + [(40, ""), (41, None), (42, "mild foul words")]
    labels = [(k, int(k % 3 == 0)) for k in range(36)]
    d = spark.createDataFrame(docs + docs[:5] * 3, "doc_id long, text string")  # rows that repeat are one row of the fit
    model = nbsvm.fit(d, spark.createDataFrame(labels, f"doc_id long, {label} int"), label, featurizer, bits=BITS, min_df=2)
    got = {r["doc_id"]: r["score"] for r in nbsvm.scores(d, model, featurizer).collect()}
    assert got == pytest.approx(plain_scores(docs, labels, plain, 1.0, 2, 1.0), abs=0.02)


@pytest.mark.parametrize(("bounds", "rows"), [({}, 41), ({"max_fit_rows": 10}, 10), ({"max_fit_chars": 640}, 20)])
def test_fit_sample_is_bounded(spark, monkeypatch, bounds, rows):
    docs = [(1, "same words " * 5)] * 50 + [(1, "other text")] + [(k, f"text {k:02} " * 4) for k in range(2, 40)] + [(99, "long " * 5000)]
    labels = [(k, k % 2) for k in range(1, 40)] + [(99, 1), (1, 0)]

    def spy(found, *_):
        raise RuntimeError(f"fitted on {len(found)} rows")

    monkeypatch.setattr(nbsvm, "fit_rows", spy)
    with pytest.raises(Exception, match="fitted on") as e:
        nbsvm.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", features.lower_char_ngrams, **bounds)
    n = int(re.search(r"fitted on (\d+) rows", str(e.value))[1])
    assert n <= rows and (bounds or n == rows)


def test_long_texts_are_read_in_parts(monkeypatch):
    """Fingerprints and features don't depend on where a text is cut."""
    rng = random.Random(0)
    texts = ["", "a", "A b", "a b c", "  x\n\ty z \x0b\x0c w", "É ü A\u3000B c d e", "\x1c a\x1fb"] + [" ".join(rng.choice(["ab", "C", "de\n", "  ", "Ab,"]) * rng.randint(1, 3) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    grams = lambda t: ({int(h) for a in features.lower_char_ngrams(t) for h in a}, {int(h) for a in features.shape_and_char_ngrams(t) for h in a})
    want = [(simhash.fingerprint(t), grams(t)) for t in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(simhash, "_SPAN", size)
        monkeypatch.setattr(features, "BLOCK", size)
        monkeypatch.setattr(nbsvm, "AT_ONCE", size)
        assert [(simhash.fingerprint(t), grams(t)) for t in texts] == want
        d = nbsvm.Distinct(10)
        for t, (_, (chars, _)) in zip(texts, want, strict=True):
            assert sorted(d(features.lower_char_ngrams(t)).tolist()) == sorted({h & 1023 for h in chars})


# Token counts.
def greedy(word, pieces):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=4), min_size=1, max_size=12), st.text("abcd", max_size=14))
def test_automaton_counts_greedy_pieces(pieces, word):
    assert tokens.LongestMatch(sorted(pieces)).count(word) == greedy(word, pieces)


def test_token_counts_of_documents(spark, sf_dir):
    pieces = tokens.read_pieces(queries.TOKENIZER)
    known = set(pieces)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(25)
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokens.token_counts(docs, pieces).collect()}
    for r in docs.collect():
        w = r["text"].encode().split()
        assert got[r["doc_id"]] == (len(w), sum(greedy("▁" + x.decode(), known) for x in w))
    odd = {(r["doc_id"], r["n_words"]) for r in tokens.token_counts(documents(spark, ODD), pieces).collect()}
    assert odd == {(1, 0), (2, 0), (3, 0), (4, 1), (5, 30000), (6, 1), (None, 2)}
    assert tokens.token_counts(documents(spark, []), pieces).count() == 0


# Licences.
def plain_licenses(files, threshold=0.6):
    import regex

    def terms(t):
        return [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w]

    marked = {k: (p or "").rpartition("/")[2].partition(".")[0].lower() in licenses.FILES for k, p, _ in files}
    cut = {(k, p, t): [terms(line) for line in t.split("\n")] for k, p, t in files if t is not None}
    whole = [w for lines in cut.values() for w in lines if w]
    df, n = Counter(t for w in whole for t in set(w)), len(whole)
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1
    units = [(k, sum(lines[i : i + m], [])) for (k, _, _), lines in cut.items() for i in range(len(lines)) for m in range(1, licenses.MOST_LINES + 1) if i + m <= len(lines) and any(lines[i : i + m]) and (m == 1 or len(sum(lines[i : i + m], [])) <= licenses.MOST_WORDS)]
    units += [(k, terms(t)) for k, _, t in files if marked[k] and t and terms(t)]
    vector = lambda w: {t: c * idf(t) for t, c in Counter(w).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own, three = {}, {}
    for k, w in units:
        v, mine, near = vector(w), (0, 0, ""), set()
        for (name, text), telling in zip(licenses.TEMPLATES, licenses.telling_terms(), strict=True):
            if not telling <= set(w):
                continue
            t = vector(terms(text))
            c = round(sum(x * t.get(y, 0) for y, x in v.items()) / norm(v) / norm(t), 6)
            if c >= threshold:
                mine = min(mine, (-c, -len(terms(text)), name))
                near.add(name)
        if mine[2]:
            own[k] = min(own.get(k, mine), mine)
        if mine[2] == "BSD-3-Clause" and "BSD-2-Clause" not in near:
            three[k] = min(three.get(k, mine), mine)
    own = {k: three.get(k, m) if m[2] == "BSD-2-Clause" else m for k, m in own.items()}
    given_ = {}
    for k, p, _ in files:
        if marked[k] and k in own and "/" in p:
            d = p.rpartition("/")[0]
            given_[d] = min(given_.get(d, own[k][2]), own[k][2])
    out = {}
    for k, p, _ in files:
        d = (p or "").rpartition("/")[0]
        while d and d not in given_:
            d = d.rpartition("/")[0]
        out[k] = (own[k][2], "file") if k in own else (given_[d], "directory") if d else (None, None)
    return out


def test_license_scan_matches_the_plain_version(spark):
    files = [
        (1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (2, "a/b/c/x.py", "import os"), (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0"), (4, "a/d/y.py", "# Licensed under CC BY 4.0\nx = 1"),
        (5, "z/y.py", "the license of the software\nto any person"), (6, None, "Released under the MIT License."), (7, "a/e", None), (8, "a/f", ""), (None, "q/x.c", "# Released under the MIT License"), (20, "b2/LICENSE", licenses.TEMPLATES[2][1]), (21, "b3/LICENSE", f"{licenses.TEMPLATES[2][1]}\n{licenses.TEMPLATES[4][1]}"),
        *[(30 + i, f"g{i}/LICENSE", text) for i, (_, text) in enumerate(licenses.TEMPLATES)], (9, "COPYING", "Released under the MIT License"),
        (10, "z/w/NOTICE", "words of no license at all"), (11, "ab/LICENSE", "x"), (12, "a/b/c/d/LICENSE", "This is free and unencumbered software\nreleased into the public domain"),
        *[(100 + i, f"z/{i}.txt", "plain words without any meaning\nand a second line of the text") for i in range(30)],
    ]
    df = spark.createDataFrame(files, "key long, path string, text string").withColumns({"license": F.lit("x"), "cosine": F.lit(1), "dir": F.lit("x")})
    got = {r["key"]: (r["license"], r["origin"]) for r in licenses.scan(df).collect()}
    assert got == plain_licenses(files) and got[2] == ("Apache-2.0", "directory") and got[6][0] == "MIT" and got[5] == (None, None)
    assert got[None] == ("MIT", "file") and got[20][0] == "BSD-2-Clause" and got[21][0] == "BSD-3-Clause"
    assert [got[30 + i][0] for i in range(len(licenses.TEMPLATES))] == [name for name, _ in licenses.TEMPLATES]
    again = licenses.scan(df.unionByName(df.where("key = 6 or key is null"))).collect()
    assert len(again) == len(files) + 2 and Counter(r["license"] for r in again if r["key"] in (6, None)) == {"MIT": 4}
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df.where("key = 5")).first()["license"] is None


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices(spark, mark):
    """Every notice at three widths, alone in a file of code, and the texts that once were taken for others'."""
    filler = ["import os", "", "def run(x):", "    return x + 1", ""]

    def wrapped(text, width):
        return "\n".join(mark + line for line in textwrap.wrap(text, width - len(mark)))

    files, want = [(10_000 + i, f"n/{i}.py", "plain words without any meaning\nand a second line of the text") for i in range(60)], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        for width in (40, 60, 80):
            key = 100 * i + width
            files.append((key, f"w/{key}.py", "\n".join([*filler, f"{mark}Copyright 2024 The Authors", wrapped(text, width), *filler])))
            want[key] = name
    lesser = dict(licenses.TEMPLATES[::-1]) | dict(licenses.TEMPLATES)
    more = ", or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; see the GNU Lesser General Public License for more details."
    for key, name in ((9001, "LGPL-2.1"), (9002, "LGPL-3.0")):
        files.append((key, f"l/{key}.c", wrapped(lesser[name], 60) + more))
        want[key] = name
    two, three = (next(t for n, t in licenses.TEMPLATES if n == x) for x in ("BSD-2-Clause", "BSD-3-Clause"))
    files.append((9003, "b/LICENSE", f"Copyright (c) 2024, The Authors\nAll rights reserved.\n\n{wrapped(two, 76)}:\n\n1. Redistributions of source code must retain the above notice.\n\n3. {wrapped(three, 76)}.\n"))
    files.append((9004, "b2/LICENSE", f"Copyright (c) 2024, The Authors\nAll rights reserved.\n\n{wrapped(two, 76)}:\n\n1. Redistributions of source code must retain the above notice.\n"))
    want |= {9003: "BSD-3-Clause", 9004: "BSD-2-Clause"}
    got = {r["key"]: r["license"] for r in licenses.scan(spark.createDataFrame(files, "key long, path string, text string")).collect() if r["key"] < 10_000}
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {}


def test_rare_terms_by_shuffle(spark, monkeypatch):
    files = spark.createDataFrame([(i, f"a/{i}.txt", f"# {text}\nmore words {i}") for i, (_, text) in enumerate(licenses.TEMPLATES)], "key long, path string, text string")
    want = sorted(map(tuple, licenses.scan(files).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, licenses.scan(files).collect())) == want and [r[2] for r in want] == [name for name, _ in licenses.TEMPLATES]


def test_license_query_finds_the_lines(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op5_license_scan(spark, sf_dir).collect():
        named = any(x in docs[r["doc_id"]] for x in ("Licensed under the Apache", "Released under the MIT", "Licensed under CC BY", "GNU General Public"))
        assert named == (r["origin"] == "file")


def test_shuffle_key_is_the_same_in_python():
    assert int(hashlib.md5(b"5|1").hexdigest()[:13], 16) >> (52 - 3) == int(hashlib.md5(b"5|1").hexdigest()[:1], 16) >> 1
