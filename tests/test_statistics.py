import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from casesafety.functions import text
from casesafety.operators import agreement, bootstrap, classifier, pairing, reports, running
from casesafety.plans import registry


def pairs(spark, rows):
    return spark.createDataFrame(rows, "case_id string, anchor_id string, score_a double, score_b double")


def some(spark, shift=0.0, n=60):
    rng = np.random.default_rng(1)
    return pairs(spark, [(f"c{i}", f"A{i % 13}", float(a), float(a - shift)) for i, a in enumerate(rng.normal(size=n))])


def test_equal_and_shifted_scores(spark):
    assert tuple(bootstrap.paired_cluster_bootstrap(some(spark), n_boot=50).first()) == (0.0, 0.0, 0.0)
    assert bootstrap.paired_cluster_bootstrap(some(spark, 2.5), n_boot=50).first() == pytest.approx((2.5, 2.5, 2.5))


def test_incomplete_rows_and_too_few_clusters(spark):
    rows = [("a", "A1", 1.0, 0.0), ("b", None, 9.0, 0.0), ("c", "A2", math.nan, 0.0), ("d", "A3", None, 1.0)]
    with pytest.raises(ValueError, match="clusters"):
        bootstrap.paired_cluster_bootstrap(pairs(spark, rows))


def test_rows_weigh_and_partitions_do_not_matter(spark):
    rng = np.random.default_rng(2)
    rows = [(f"c{i}", f"A{int(rng.integers(9))}", float(rng.normal()), float(rng.normal())) for i in range(200)]
    df = pairs(spark, rows)
    one = bootstrap.paired_cluster_bootstrap(df.repartition(1), n_boot=300).first()
    many = bootstrap.paired_cluster_bootstrap(df.orderBy(F.desc("case_id")).repartition(7), n_boot=300).first()
    assert one == pytest.approx(many)
    assert one["mean_difference"] == pytest.approx(np.mean([a - b for _, _, a, b in rows]))
    near = bootstrap.poisson_bootstrap(df, n_boot=2000).first()
    exact = bootstrap.paired_cluster_bootstrap(df, n_boot=2000).first()
    assert near["ci_2_5"] == pytest.approx(exact["ci_2_5"], abs=0.08) and near["ci_97_5"] == pytest.approx(exact["ci_97_5"], abs=0.08)


def test_pairing(spark):
    s = spark.createDataFrame([("c1", "m0", "r", "A", 1.0), ("c1", "m1", "r", "A", 2.0), ("c2", "m0", "r", "B", 3.0)], "case_id string, model_id string, run_id string, anchor_id string, cscs double")
    assert sorted(map(tuple, pairing.pair_models(s, "m0", "m1").collect())) == [("c1", "r", "A", 1.0, 2.0), ("c2", "r", "B", 3.0, None)]
    cases = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "case_id string")
    assert sorted(map(tuple, pairing.unscored_cases(cases, s).collect())) == [("m0", "c3"), ("m1", "c2"), ("m1", "c3")]


def test_classifier_separates_a_toy_set(spark):
    rows = [(i, f"call the doctor now {i}" if i % 3 else f"ignore the pain {i}", int(i % 3 == 0)) for i in range(60)] + [(99, "call", None)]
    df = spark.createDataFrame(rows, "response_id long, text string, label int")
    fitted = classifier.fit_safety_classifier(df)
    got = {r["response_id"]: r["predicted"] for r in classifier.predict_safety(fitted, df).collect()}
    assert all(got[i] == int(i % 3 == 0) for i in range(60))
    with pytest.raises(ValueError, match="labels"):
        classifier.fit_safety_classifier(df.where("label = 1"))


def test_every_document_is_predicted(spark, sf_dir):
    got = registry.QUERIES["safety_predictions"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(r[0] for r in got.select("response_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def test_reports(spark):
    runs = spark.createDataFrame([("m", None, None)], "model_id string, provider string, prompt string").withColumns({"evaluation_date": F.lit("2026-01-01").cast("date"), "decoding_params": F.create_map(F.lit("t"), F.lit("1")), "n_runs": F.lit(1)})
    assert sorted(r["field"] for r in reports.run_record_violations(runs).collect()) == ["prompt", "provider"]
    days = spark.createDataFrame([("m", "2026-01-01", 10.0), ("m", "2026-02-01", 30.0)], "model_id string, evaluation_date string, cscs double")
    assert [r["change"] for r in reports.longitudinal(days).orderBy("evaluation_date").collect()] == [None, 20.0]


@pytest.mark.parametrize("way", ["arrays", "blocks"])
def test_interval_is_that_of_a_plain_bootstrap(spark, monkeypatch, way):
    if way == "blocks":
        in_blocks(spark, monkeypatch)
    rng = np.random.default_rng(5)
    rows = [(f"c{i}", f"A{int(rng.integers(40))}", float(rng.normal(0.3)), float(rng.normal())) for i in range(300)]
    stats = {}
    for _, a, x, y in rows:
        s, n = stats.get(a, (0.0, 0))
        stats[a] = s + x - y, n + 1
    s, n = (np.array([v[k] for v in stats.values()]) for k in (0, 1))
    k = rng.integers(len(s), size=(20000, len(s)))
    want = np.quantile(s[k].sum(axis=1) / n[k].sum(axis=1), [0.025, 0.975])
    got = bootstrap.paired_cluster_bootstrap(pairs(spark, rows).withColumnsRenamed({"score_a": "one", "score_b": "two"}), n_boot=4000, score_a="one", score_b="two").first()
    assert (got["ci_2_5"], got["ci_97_5"]) == pytest.approx(want, abs=0.02)
    near = bootstrap.poisson_bootstrap(pairs(spark, rows), n_boot=4000).first()
    assert (near["ci_2_5"], near["ci_97_5"]) == pytest.approx(want, abs=0.03)


def in_blocks(spark, monkeypatch, block=8):
    monkeypatch.setattr(bootstrap, "BROADCAST_CLUSTERS", 3)
    monkeypatch.setattr(bootstrap, "BLOCK", block)


def test_counts_of_many_clusters(spark, monkeypatch):
    """Each replicate draws as many clusters as there are, each cluster once on average and with a variance of 1 - 1/K, as when indices are drawn."""
    in_blocks(spark, monkeypatch)
    k, n_boot = 61, 3000
    stats = spark.range(k).select(F.concat(F.lit("A"), "id").alias("cluster"), *[(F.col("id") == j).cast("double").alias(f"c{j}") for j in range(k)], F.lit(1.0).alias("one"))
    clusters = bootstrap.gathered(stats, (), (*[f"c{j}" for j in range(k)], "one"))
    assert clusters.local is None
    rows = bootstrap.replicates(clusters, n_boot).drop("b").collect()
    counts = np.array([r[:-1] for r in rows])
    assert len(rows) == n_boot and (counts.sum(axis=1) == k).all() and all(r[-1] == k for r in rows)
    assert abs(counts.mean(axis=0) - 1).max() < 5 / math.sqrt(n_boot)
    assert abs(counts.var(axis=0) - (1 - 1 / k)).max() < 0.2
    # How many clusters are drawn 0, 1, 2, ... times: chi-square with the binomial's shares, about 5 degrees of freedom.
    share = [math.comb(k, j) * (1 / k) ** j * (1 - 1 / k) ** (k - j) for j in range(5)]
    seen = [(counts == j).sum() for j in range(5)] + [(counts > 4).sum()]
    want = [n_boot * k * x for x in (*share, 1 - sum(share))]
    assert sum((a - b) ** 2 / b for a, b in zip(seen, want, strict=True)) < 25
    # Two clusters' counts are correlated by -1 / (K - 1), in one block or in two.
    c = np.corrcoef(counts.T)[np.triu_indices(k, 1)]
    assert abs(c.mean() + 1 / (k - 1)) < 0.003


def test_draws_go_down_the_tree():
    sizes = np.array([5, 0, 9, 1, 30, 7, 8])
    each = np.array([bootstrap.draws_of_block(sizes, b, 4000, 7) for b in range(len(sizes))])
    assert (each.sum(axis=0) == 60).all() and (each[1] == 0).all()
    p = sizes / 60
    assert abs(each.mean(axis=1) - sizes).max() < 0.3 and abs(each.var(axis=1) - 60 * p * (1 - p)).max() < 1.2
    assert (bootstrap.draws_of_block(sizes, 3, 4000, 7) == each[3]).all() and (bootstrap.draws_of_block(sizes, 3, 4000, 8) != each[3]).any()


def test_partitions_do_not_matter_for_many_clusters(spark, monkeypatch):
    in_blocks(spark, monkeypatch)
    df = some(spark, n=90).withColumn("score_b", F.col("score_a") / 2).withColumn("anchor_id", F.concat("anchor_id", F.substring("case_id", 2, 1))).withColumn("g", F.when(F.col("anchor_id") < "A5", "x").otherwise("y"))
    rows = lambda d: {tuple(r)[:-1]: pytest.approx(r["diff"]) for r in d.collect()}
    found = []
    for n in (3, 8):
        dealt = df.repartition(n)
        found.append((rows(bootstrap.resample(bootstrap.cluster_stats(dealt), 40)), rows(bootstrap.resample(bootstrap.cluster_stats(dealt, by=("g",)), 40, by=("g",)))))
    assert found[0] == found[1] and len(found[0][0]) == 40 and len(found[0][1]) == 80
    one, other = (rows(bootstrap.resample(bootstrap.cluster_stats(df), 40, seed)) for seed in (1, 2))
    assert one != other


def test_no_row_is_made_for_a_draw(spark, monkeypatch):
    in_blocks(spark, monkeypatch, 16)
    df = bootstrap.resampled_sums(bootstrap.cluster_stats(some(spark, n=60)), 500)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "sequence(" not in plan


@pytest.mark.parametrize("way", ["arrays", "blocks"])
def test_all_models_at_once(spark, monkeypatch, way):
    if way == "blocks":
        in_blocks(spark, monkeypatch)
    rng = np.random.default_rng(9)
    rows = [(f"c{i}", m, "r", f"A{i % 17}", None if (i, m) == (5, "b") else float(rng.normal(k * 0.3))) for i in range(120) for k, m in enumerate("abcd")] + [("c7x", "a", "r", "A1", 1.0)]
    scores = spark.createDataFrame(rows, "case_id string, model_id string, run_id string, anchor_id string, cscs double")
    got = {(r["model_a"], r["model_b"]): r for r in bootstrap.compare_models(scores, n_boot=800).collect()}
    assert sorted(got) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d")]
    common = scores.where("case_id not in ('c5', 'c7x')")
    for (a, b), r in got.items():
        want = bootstrap.paired_cluster_bootstrap(pairing.pair_models(common, a, b), n_boot=800).first()
        assert (r["mean_difference"], r["ci_2_5"], r["ci_97_5"]) == pytest.approx(tuple(want))
        # What holds for all pairs at once is wider, about 2.6 standard errors to either side for six pairs of four models.
        half, own = (r["high"] - r["low"]) / 2, (r["ci_97_5"] - r["ci_2_5"]) / 2
        assert own * 1.1 < half < own * 1.6 and (r["low"] + r["high"]) / 2 == pytest.approx(r["mean_difference"])
    same = scores.where("model_id = 'a'").unionByName(scores.where("model_id = 'a'").withColumn("model_id", F.lit("z")))
    assert tuple(bootstrap.compare_models(same, n_boot=20).first())[2:] == (0.0,) * 5
    with pytest.raises(ValueError, match="two models"):
        bootstrap.compare_models(scores.where("model_id = 'a'"))


def test_seeds_next_to_each_other_share_nothing(spark):
    rng = np.random.default_rng(3)
    stats = bootstrap.cluster_stats(pairs(spark, [(f"c{i}", f"A{i % 50}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]))
    one, two = ({r["diff"] for r in bootstrap.resample(stats, 300, seed).collect()} for seed in (2026, 2027))
    assert len(one) > 290 and not one & two
    # Draws repeat as chance has it: of 2^19 draws among 2^32 numbers about 32 are met before.
    slots = np.arange(1 << 19, dtype=np.uint64)
    drawn = bootstrap._number_array((np.uint64(12345), np.uint64(99)), slots)
    pairs_ = len(slots) - len(np.unique(drawn))
    assert 10 <= pairs_ <= 60 and abs(np.mean(drawn) / 2**31 - 1) < 0.01


def test_saved_classifier_loads(spark, tmp_path):
    rows = [(i, f"call the doctor now {i}" if i % 3 else f"ignore the pain {i}", int(i % 3 == 0)) for i in range(30)]
    df = spark.createDataFrame(rows, "response_id long, text string, label int")
    fitted = classifier.fit_safety_classifier(df)
    fitted.save(str(tmp_path / "m"))
    again = classifier.SafetyClassifier.load(str(tmp_path / "m"))
    assert sorted(classifier.predict_safety(again, df).collect()) == sorted(classifier.predict_safety(fitted, df).collect())


@pytest.mark.parametrize("name", ["bootstrap_diffs", "bootstrap_ci", "bootstrap_by_group", "poisson_bootstrap"])
def test_registered_bootstraps_draw_five_thousand_replicates(spark, sf_dir, monkeypatch, name):
    drawn, real = [], bootstrap.percentile_ci
    monkeypatch.setattr(bootstrap, "percentile_ci", lambda diffs, by=(): drawn.append(diffs) or real(diffs, by))
    monkeypatch.setattr(bootstrap, "resampled_sums", lambda *a, f=bootstrap.resampled_sums, **kw: drawn.append(f(*a, **kw)) or drawn[-1])
    registry.QUERIES[name](spark, sf_dir)
    assert drawn[0].select("b").distinct().count() == 5000


def plain_alpha(units, delta):
    """From all ordered pairs."""
    pairs_ = [(a, b) for u in units for a in u for b in u]  # a value with itself adds nothing
    every = [x for u in units for x in u]
    within = sum(sum(delta(a, b) for a in u for b in u) / (len(u) - 1) for u in units) / len(every)
    between = sum(delta(a, b) for a in every for b in every) / (len(every) * (len(every) - 1))
    return 1 - within / between if pairs_ and between else None


def test_agreement_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(m, f"c{c}", f"A{c % 5}", float(min(2, max(0, c % 3 + rng.integers(-1, 2)))) if rng.random() > 0.1 else None, 1.0) for m in "ab" for c in range(20) for _ in range(int(rng.integers(1, 5)))]
    df = spark.createDataFrame(rows, "model_id string, case_id string, anchor_id string, red_flags double, disposition double")
    values = agreement.case_values(df, ("red_flags", "disposition"))
    got = {(r["model_id"], r["dimension"]): r for r in agreement.agreement(values).collect()}
    for m in "ab":
        units = {}
        for a, c, _, x, _ in rows:
            if a == m and x is not None:
                units.setdefault(c, []).append(x)
        units = [u for u in units.values() if len(u) > 1]
        every = sorted(x for u in units for x in u)
        rank = lambda v: sum(x < v for x in every) + sum(x == v for x in every) / 2  # noqa: E731, B023
        r = got[m, "red_flags"]
        assert (r["n_cases"], r["n_values"]) == (len(units), len(every))
        assert r["interval"] == pytest.approx(plain_alpha(units, lambda a, b: (a - b) ** 2))
        assert r["ordinal"] == pytest.approx(plain_alpha(units, lambda a, b: (rank(a) - rank(b)) ** 2))
        assert r["nominal"] == pytest.approx(plain_alpha(units, lambda a, b: a != b))
        assert got[m, "disposition"]["interval"] is None and got[m, "disposition"]["nominal"] is None
    near = {(r["model_id"], r["dimension"]): r for r in agreement.agreement_interval(values.where("dimension = 'red_flags'"), 2000).collect()}
    for m in "ab":
        # The same bootstrap by hand, over clusters of cases.
        per = {}
        for r in values.where(f"model_id = '{m}' and dimension = 'red_flags'").collect():
            per.setdefault((r["cluster"], r["case_id"]), []).extend([r["value"]] * r["n"])
        groups = [[u for (a, _), u in per.items() if a == f"A{k}"] for k in range(5)]
        draws = [plain_alpha([u for k in rng.integers(5, size=5) for u in groups[k]], lambda a, b: (a - b) ** 2) for _ in range(150)]
        lo, hi = np.quantile([x for x in draws if x is not None], [0.025, 0.975])
        r = near[m, "red_flags"]
        assert r["alpha"] == pytest.approx(got[m, "red_flags"]["interval"]) and abs(r["ci_2_5"] - lo) < 0.15 and abs(r["ci_97_5"] - hi) < 0.15


def test_states_merge_in_any_order(spark):
    rng = np.random.default_rng(7)
    rows = [(m, f"2026-0{1 + i % 2}-01", f"c{i % 300}", float(1e6 + rng.normal())) for m in "ab" for i in range(900)] + [("a", "2026-01-01", "c1", None), ("a", "2026-01-01", "c1", math.nan), (None, None, None, 5.0)]
    df = spark.createDataFrame(rows, "model_id string, evaluation_date string, case_id string, cscs double")
    part = lambda k: df.where(F.pmod(F.xxhash64("case_id", "cscs"), F.lit(3)) == k)
    states = [running.state_of(part(k)) for k in range(3)]
    exact = {r[:2]: r for r in map(tuple, df.where("cscs is not null and not isnan(cscs)").groupBy("model_id", "evaluation_date").agg(F.count("*"), F.avg("cscs"), F.stddev_samp("cscs"), F.min("cscs"), F.max("cscs"), F.count_distinct("case_id"), F.percentile("cscs", F.lit(0.5))).collect())}
    for state in (running.state_of(df), running.merged(*states), running.merged(states[2], running.merged(states[1], states[0]))):
        for r in map(tuple, running.report(state).collect()):
            want = exact[r[:2]]
            assert r[2] == want[2] and r[3] == pytest.approx(want[3], rel=1e-14) and (r[4] == want[4] if want[4] is None else r[4] == pytest.approx(want[4], rel=1e-9)) and r[5:7] == want[5:7]
            assert abs(r[7] - want[7]) <= 0.03 * want[7] + 1 and abs(r[8] - want[8]) < 0.1


@pytest.mark.parametrize("buckets", [1 << 16, 64])
def test_candidates_give_the_whole_vocabulary(spark, buckets):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) if x < 3000)) for i in range(300)]
    counts = text.term_counts(spark.createDataFrame(rows, "response_id long, text string"), "response_id", "text")
    for most in (5, 40, 100_000):
        assert sorted(text.vocabulary_of_candidates(counts, "response_id", 2, most, buckets, 4).collect()) == sorted(text.vocabulary(counts, 2, most).collect())


def test_classifier_is_the_optimum_of_its_objective(spark):
    """Newton's method on the same features: weighted mean log loss plus |w|² / 2n, the intercept free."""
    rng = np.random.default_rng(10)
    words = [f"w{k}" for k in range(25)]
    rows = [(i, " ".join(rng.choice(words[: 25 - 10 * (i % 4 == 0)], 8)), int(i % 4 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "response_id long, text string, label int")
    fitted = classifier.fit_safety_classifier(df, tol=1e-10)
    got = {r["response_id"]: r["probability"] for r in classifier.predict_safety(fitted, df).collect()}
    x = np.array([r["features"].toArray() for r in fitted.features(df).orderBy("response_id").collect()])
    x, y = np.c_[x, np.ones(120)], np.array([r[2] for r in rows])
    weight = np.where(y == 1, 120 / (2 * y.sum()), 120 / (2 * (1 - y).sum())) / 120
    ridge, w = np.r_[np.full(x.shape[1] - 1, 1 / 120), 0.0], np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + np.diag(ridge + 1e-12), x.T @ (weight * (p - y)) + ridge * w)
    assert max(abs(got[i] - q) for i, q in enumerate(1 / (1 + np.exp(-x @ w)))) < 1e-4


def test_out_of_fold_scores_see_no_row_of_their_cluster(spark, monkeypatch):
    rows = [(i, f"A{i % 12}" if i % 9 else None, f"{'call the clinic' if i % 3 else 'wait it out'} now {i % 5}", int(i % 3 == 0) if i != 7 else None) for i in range(90)]
    df = spark.createDataFrame(rows, "response_id long, anchor_id string, text string, label int")
    seen, real = [], classifier.fit_safety_classifier
    monkeypatch.setattr(classifier, "fit_safety_classifier", lambda d, *a, **kw: seen.append({r["anchor_id"] for r in d.collect()} - {None}) or real(d, *a, **kw))
    got = {r["response_id"]: r for r in classifier.out_of_fold(df, "anchor_id", 3).collect()}
    assert set(got) == set(range(90)) - {7} and len(seen) == 3
    fold = {}
    for i, a, _, _ in rows:
        if a and i != 7:
            fold.setdefault(a, set()).add(got[i]["fold"])
    assert all(len(f) == 1 for f in fold.values())
    for k, anchors in zip(sorted({r["fold"] for r in got.values()}), seen, strict=True):
        assert not anchors & {a for a, f in fold.items() if k in f}
    assert all((r["probability"] > 0.5) == (r["label"] == 1) and 0 <= r["calibrated"] <= 1 for r in got.values())


def test_terms_are_counted_without_a_table_of_them(spark, monkeypatch):
    """Texts with ids of their own need no aggregation by (id, term); repeated and null ids are added up, and a piece may be smaller than a text."""
    from collections import Counter

    monkeypatch.setattr(text, "PIECE_WORDS", 7)
    rows = [(1, "a1 b2 a1 b2 a1"), (2, None), (3, ""), (4, "Äß x_ x_ äß"), (5, " ".join(f"w{k % 9}" for k in range(60))), (6, "one"), (7, "one two")]
    more = [(5, "w1 w2 w3"), (None, "one two two"), (None, "one")]
    for some_rows in (rows, rows + more):
        df = spark.createDataFrame(some_rows, "response_id long, text string")
        for low, high in ((1, 2), (2, 3), (1, 1)):
            want = Counter()
            for i, t in some_rows:
                w = [x for x in (t or "").lower().split() if len(x) > 1]
                want.update((i, " ".join(w[k : k + n])) for n in range(low, high + 1) for k in range(len(w) - n + 1))
            found = text.term_counts(df, "response_id", "text", low, high)
            got = [((r[0], r[1]), r[2]) for r in found.collect()]
            assert len(got) == len(want) and dict(got) == dict(want)
            totals = {r["term"]: (r["df"], r["tf"]) for r in text.term_totals(df, "response_id", "text", low, high).collect()}
            assert totals == {t: (sum(1 for _, x in want if x == t), sum(v for (_, x), v in want.items() if x == t)) for t in {x for _, x in want}}
            if some_rows is rows:
                assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_running_report_scores_once(spark, sf_dir, monkeypatch):
    """The plan of the report reads what was scored and merged, not the tables again for each state."""
    plan = registry.QUERIES["running_report"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and plan.count("Relation") <= 3


def test_vocabulary_of_texts_counts_candidates_only(spark, monkeypatch):
    """The list is whole, repeated and null ids included, and terms that can't be on it are never put together."""
    monkeypatch.setattr(text, "SLICE", 64)
    monkeypatch.setattr(text, "PIECE_WORDS", 500)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) if x < 3000)) for i in range(300)]
    more = [(7, rows[3][1]), (7, "w1 w2"), (None, "w1 w1 w2"), (None, rows[5][1]), (400, None), (401, "")]
    for some_rows, low, high, most, bits in ((rows + more, 2, 3, 3, 8), (rows, 1, 1, 100_000, 16), (rows + more, 1, 2, 5, 16)):
        df = spark.createDataFrame(some_rows, "response_id long, text string").coalesce(2)
        want = text.vocabulary(text.term_counts(df, "response_id", "text", low, high), 2, most).collect()
        assert sorted(text.vocabulary_of_texts(df, "response_id", "text", low, high, 2, most, bits, 4).collect()) == sorted(want)
    made, real = [], text._added
    monkeypatch.setattr(text, "_added", lambda *a: made.append(real(*a)) or made[-1])
    text.vocabulary_of_texts(df, "response_id", "text", 1, 2, 2, 5, 16, 4)
    assert made[-1].count() * 4 < text.term_totals(df, "response_id", "text").count()


def test_sums_of_terms_are_dealt_by_size_of_the_texts(spark, monkeypatch):
    """A task's table of terms stays small however few shuffle partitions the session has (four here), with repeated ids, too."""
    monkeypatch.setattr(text, "TASK_CHARS", 2000)
    monkeypatch.setattr(text, "MERGE_ROWS", 50, raising=False)
    once = [(i, " ".join(f"t{i}x{k}" for k in range(60))) for i in range(100)]
    for rows in (once, [(i // 2, t) for i, t in once]):
        df = spark.createDataFrame(rows, "response_id long, text string")
        totals = text.term_totals(df, "response_id", "text", 1, 1)
        assert totals.count() == 6000
        assert max(r["count"] for r in totals.groupBy(F.spark_partition_id()).count().collect()) < 600
        counts = text.term_counts(df, "response_id", "text", 1, 1)
        assert counts.count() == 6000
        assert max(r["count"] for r in counts.groupBy(F.spark_partition_id()).count().collect()) < 1200


def test_the_classifier_counts_candidates_only(spark, monkeypatch):
    """Its words are those of the whole list; the last list is made of no more terms than can be on it."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) if x < 3000), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "response_id long, text string, label int")
    want = [r["term"] for r in text.vocabulary(text.term_counts(df, "response_id", "text"), 2, 5).orderBy("idx").collect()]
    listed, real = [], text.vocabulary_of_totals
    monkeypatch.setattr(text, "vocabulary_of_totals", lambda totals, *a: listed.append(totals) or real(totals, *a))
    assert classifier.fit_safety_classifier(df, max_features=5, max_iter=2).words.vocabulary == want
    assert listed and listed[-1].count() * 4 < text.term_totals(df, "response_id", "text").count()


def test_registered_candidates_make_no_row_for_an_id_and_term(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(text, "term_counts", None)
    assert registry.QUERIES["vocabulary_of_candidates"](spark, sf_dir).count() > 0


def test_agreement_shuffles_rows_and_not_values(spark, sf_dir, monkeypatch):
    """The same from scores as from values, with repeated rows, nulls and NaN; what is written is a row for each shape, not for each case."""
    rng = np.random.default_rng(12)
    rows = [(m, f"c{c}" if c else None, f"A{c % 5}", *(float(x) if x < 3 else (None if x < 3.5 else math.nan) for x in rng.choice([-0.0, 0.0, 1, 2, 3, 3.7], 2))) for m in ("a", "b", None) for c in range(40) for _ in range(int(rng.integers(1, 6)))]
    df = spark.createDataFrame(rows, "model_id string, case_id string, anchor_id string, red_flags double, disposition double")
    columns = ("red_flags", "disposition")
    near = lambda found: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in sorted(found.collect())]
    assert near(agreement.agreement_of_scores(df, columns)) == near(agreement.agreement(agreement.case_values(df, columns)))
    made, real = [], agreement.agreement_of_shapes
    monkeypatch.setattr(agreement, "agreement_of_shapes", lambda shapes: made.append(shapes) or real(shapes))
    plan = registry.QUERIES["run_agreement"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and made[0].count() <= 2 * 6 * 6


def test_draws_among_a_block_are_as_likely(monkeypatch):
    """Numbers that can't be dealt out evenly are drawn again."""
    for size in (1, 7, 3 << 29):
        found = bootstrap._drawn_among(bootstrap._stream(1, 1, size), size, 30001)
        assert len(found) == 30001 and found.min() >= 0 and found.max() < size
        thirds = np.bincount(found * 7 // max(7, size), minlength=7)
        assert size == 1 or ((thirds - 30001 / 7) ** 2 / (30001 / 7)).sum() < 30
    assert len(bootstrap._drawn_among(bootstrap._stream(1, 1, 0), 5, 0)) == 0


def test_replicates_are_drawn_once_and_clusters_summed_once(spark, sf_dir, monkeypatch):
    """What is read several times was written: no plan goes back to the tables, and none draws again."""
    for name in ("compare_models", "bootstrap_counts", "bootstrap_by_group"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "o_orderkey" not in plan and (name != "compare_models" or "MapInPandas" not in plan)
    facts = spark.createDataFrame([("c1", m, "r", "A", v, "x") for m, v in (("m0", 1.0), ("m1", 2.0))], "case_id string, model_id string, run_id string, anchor_id string, cscs double, domain string")
    assert [tuple(r) for r in pairing.pair_models(facts, "m0", "m1", carried=("domain",)).collect()] == [("c1", "r", "A", 1.0, 2.0, "x")]
