"""Language identification, toxicity and mixing: accuracy on held-out rows, defined results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import language_id, mixing, toxicity
from strandweave.llm.common import bounded_sample, fold_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


@pytest.fixture(scope="module")
def language_model(docs):
    return language_id.fit(docs.where(fold_of("doc_id", 4) != 2), sample_rows=100)


def test_held_out_languages(docs, language_model):
    held = docs.where(fold_of("doc_id", 4) == 2)
    joined = language_id.predict(held, language_model).join(held.select("doc_id", "lang"), "doc_id")
    row = joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.95 and 0 <= row[1] and row[2] <= 1


def test_texts_without_letters_are_unknown(odd, clashing, nothing, language_model):
    got = {(r["doc_id"], r["lang_pred"] == "und", r["score"] == 0) for r in language_id.predict(odd, language_model).collect()}
    assert {(1, True, True), (2, True, True), (4, True, True)} <= got
    assert (5, True, True) not in got and (3, True, True) not in got
    kept = language_id.keep_identified(clashing, language_model)
    assert kept.columns == clashing.columns
    assert {1, 2, 4}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert language_id.predict(nothing, language_model).count() == 0


def test_no_training_rows(odd, nothing):
    model = language_id.fit(nothing)
    assert {r["lang_pred"] for r in language_id.predict(odd, model).collect()} == {"und"}
    assert language_id.keep_identified(odd, model).count() == 0


def test_document_frequencies_count_every_text(spark):
    seen = language_id.document_frequencies(spark.createDataFrame([("aaaa",), ("ab",), (None,), ("",)], "text string"))
    texts = next(language_id.arrays.chunks(language_id.pa.array(["a"])))
    first = next(language_id.gram_features(texts))[0][0]
    assert seen[first] == 2


def test_l1_keeps_weights_at_zero():
    rows = [(np.array([i % 2, 5]), np.array([1.0, 1.0])) for i in range(200)]
    w, _ = language_id.train_ftrl(rows, np.arange(200) % 2, 2)
    assert w[0, 0] > 0 > w[1, 0] and not w[10].any()


def test_held_out_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.where(fold_of("doc_id", 5) != 0), sample_rows=1500)
    held = labels.where(fold_of("doc_id", 5) == 0)
    scored = toxicity.score(docs.join(held.select("doc_id"), "doc_id"), model).join(held, "doc_id")
    row = scored.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert row[0] > 0.8 and row[1] < 0.05


def test_pairs_of_terms_are_learned():
    """An insult counts only together with a mention: a weight per term cannot tell these apart."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        noise = 100 + rng.integers(0, 500, 5)
        rows.append(np.unique(np.concatenate([[1] * a, [2] * b, noise]).astype(np.int64)))
        labels.append(int(a and b))
    model = toxicity.train(rows, np.array(labels, dtype=float))
    ask = [np.array([1]), np.array([2]), np.array([1, 2])]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ask])])
    one, two, both = toxicity.decision(model, np.concatenate(ask), bounds)
    assert both > 0 > max(one, two)


@pytest.mark.parametrize("fillers", [5, 40])
def test_pairs_of_terms_that_tell_nothing_alone(fillers):
    """Either term is in half of the toxic and half of the clean rows: only their product tells."""
    rng = np.random.default_rng(6)
    both, labels = [[1, 2], [], [1], [2]], []
    rows = []
    for k in range(4000):
        rows.append(np.unique(np.array([*both[k % 4], *(100 + rng.integers(0, 500, fillers))], dtype=np.int64)))
        labels.append(float(k % 4 < 2))
    labels = np.array(labels)
    telling = toxicity.telling_terms(rows, labels)
    assert not telling[1] and not telling[2]
    model = toxicity.train(rows[:3200], labels[:3200])
    held = rows[3200:]
    found = toxicity.decision(model, np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])])) > 0
    assert (found == labels[3200:]).mean() > 0.95


def test_decision_is_the_sum_over_pairs():
    rng = np.random.default_rng(7)
    model = toxicity.ToxicityModel(0.3, rng.normal(0, 1, toxicity.DIMS) * (rng.random(toxicity.DIMS) < 0.5), rng.normal(0, 1, (toxicity.DIMS, toxicity.RANK)))
    rows = [np.unique(rng.integers(0, toxicity.DIMS, k)) for k in (0, 1, 2, 17, 60)]
    got = toxicity.decision(model, np.concatenate(rows).astype(np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    want = [model.bias + sum(model.linear[i] for i in r) + sum(float(model.factors[i] @ model.factors[j]) for x, i in enumerate(r) for j in r[:x]) for r in rows]
    assert got == pytest.approx(want)


def test_toxicity_of_odd_rows(odd, clashing, nothing, labels, docs):
    model = toxicity.fit(docs, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.score(clashing, model).count() == odd.count()
    assert toxicity.score(nothing, model).count() == 0
    blank = toxicity.fit(nothing, labels)
    assert {r["predicted"] for r in toxicity.score(odd, blank).collect()} == {0}


TARGETS = {"good": 0.9, "low": 0.06, "toxic": 0.04}


def test_expected_tokens_meet_the_targets(docs, labels):
    rated, model, _ = mixing.rates(docs, mixing.label_domains(labels), TARGETS)
    sums = rated.agg(F.sum("tokens").alias("n"), F.min("rate").alias("least"), *[
        F.sum(F.col("tokens") * F.col("posterior")[i] * F.col("rate")).alias(d) for i, d in enumerate(model.domains)]).first()
    assert sums["least"] >= 0
    for d, share in TARGETS.items():
        assert sums[d] / sums["n"] == pytest.approx(share, abs=2e-3)


def test_relative_targets_are_factors_on_the_natural_shares(docs, labels):
    domains = mixing.label_domains(labels)
    factors = {"good": 1.0, "low": 0.5, "toxic": 0.5}
    rated, model, _ = mixing.rates(docs, domains, factors, relative=True)
    share = lambda rate: np.array(rated.agg(*[F.sum(F.col("tokens") * F.col("posterior")[i] * rate) / F.sum("tokens")
                                              for i in range(len(model.domains))]).first())
    natural, after = share(F.lit(1.0)), share(F.col("rate"))
    want = natural * np.array([factors[d] for d in model.domains])
    assert after == pytest.approx(want / want.sum(), abs=2e-3)
    good = model.domains.index("good")
    assert rated.where(F.col("posterior")[good] > 0.95).agg(F.min("copies")).first()[0] >= 1


def test_posteriors_against_a_plain_sum(spark):
    rows = [(0, "good", "alpha beta beta"), (1, "good", "alpha gamma"), (2, "low", "delta delta beta"), (3, "toxic", "epsilon alpha")]
    asked = ["alpha", "delta Beta unseen", "", None, "epsilon " * 50]
    docs = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, text string")
    model = mixing.fit_domains(docs, spark.createDataFrame([(i, d) for i, d, _ in rows], "doc_id long, domain string"))
    size, prior = mixing.BUCKETS, {"good": 0.5, "low": 0.25, "toxic": 0.25}
    words = {d: " ".join(x for _, e, x in rows if e == d).split() for d in prior}
    ask = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in mixing.posteriors(ask, model, {"doc_id": F.col("doc_id")}).collect()}
    for i, text in enumerate(asked):
        tokens = (text or "").lower().split()
        logs = np.array([np.log(prior[d]) + sum(np.log((words[d].count(w) + 0.5) / (len(words[d]) + 0.5 * size)) for w in tokens) / max(len(tokens), 1) ** 0.5 for d in sorted(prior)])
        odds = np.exp(logs - logs.max())
        assert got[i]["_tokens"] == len(tokens) and got[i]["_posterior"] == pytest.approx((odds / odds.sum()).tolist(), rel=1e-9)


def test_thinly_spread_domain_reaches_its_target(spark):
    """A domain with at most 4 parts in 10,000 of every document: rounding to decimals would lose it all."""
    rng = np.random.default_rng(12)
    thin = rng.uniform(1e-5, 4e-4, 800)
    b = rng.uniform(0, 1, 800) * (1 - thin)
    p, t = np.stack([1 - thin - b, b, thin], axis=1), rng.integers(1, 300, 800).astype(float)
    natural = (p * t[:, None]).sum(axis=0) / t.sum()
    goal = natural * [1, 1, 1.5]
    goal /= goal.sum()
    steps, rate = fitted(spark, p, t, goal)
    assert (rate >= 0).all() and (p * (t * rate)[:, None]).sum(axis=0) / t.sum() == pytest.approx(goal, rel=0.05, abs=1e-6)


def test_reached_shares(docs, labels):
    rated, model, _ = mixing.rates(docs, mixing.label_domains(labels), TARGETS)
    got = {r["domain"]: r for r in mixing.reached(rated, model).collect()}
    assert {d: r["share"] for d, r in got.items()} == pytest.approx(TARGETS, abs=2e-3)
    assert sum(r["natural"] for r in got.values()) == pytest.approx(1)


def fitted(spark, p, t, goal):
    scored = spark.createDataFrame([(p[i].tolist(), float(t[i])) for i in range(len(t))], "_posterior array<double>, _tokens double")
    model = mixing.DomainModel(["a", "b", "c"], np.ones(3) / 3, None, [])
    steps = mixing.fit_rates(scored, model, dict(zip("abc", goal, strict=True)))
    rows = scored.select("_posterior", mixing.rate_of(F.col("_posterior"), steps).alias("r")).collect()
    rate = {tuple(r["_posterior"]): r["r"] for r in rows}
    return steps, np.array([rate[tuple(x)] for x in p.tolist()])


def drawn(seed):
    rng = np.random.default_rng(seed)
    return np.round(rng.dirichlet([0.3, 0.3, 0.3], 40), 3), rng.integers(1, 100, 40).astype(float)


def test_rates_meet_reachable_targets(spark):
    p, t = drawn(9)
    goal = np.array([0.7, 0.25, 0.05])
    steps, rate = fitted(spark, p, t, goal)
    assert (rate >= 0).all() and (rate == 0).any()
    assert p.T @ (t * rate) / t.sum() == pytest.approx(goal, abs=2e-5)
    again = np.ones(40)
    for h in steps:
        again = np.maximum(0, again - p @ np.array(h))
    assert rate == pytest.approx(again, abs=1e-9)


def test_rates_come_as_near_as_they_can(spark):
    """Domain c always carries a tenth of a or b with it, so 95 per cent of c cannot be reached."""
    p = np.array([[0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.2, 0.1, 0.7], [0.1, 0.3, 0.6]])
    t = np.array([10.0, 20.0, 30.0, 5.0])
    goal = np.array([0.02, 0.03, 0.95])
    _, rate = fitted(spark, p, t, goal)
    every = np.linalg.pinv(np.einsum("i,ij,ik->jk", t, p, p) / t.sum())

    def distance(r):
        e = p.T @ (t * r) / t.sum() - goal
        return e @ every @ e

    best = np.ones(4)
    for _ in range(20000):
        best = np.maximum(0, best - p @ (every @ (p.T @ (t * best) / t.sum() - goal)))
    assert distance(rate) <= distance(best) + 1e-3 and distance(rate) < distance(np.ones(4))


def test_mixing_odd_rows(odd, clashing, nothing, labels, docs, spark):
    domains = mixing.label_domains(labels)
    rated, _, _ = mixing.rates(odd, domains, TARGETS)
    assert rated.count() == odd.count() and rated.where("rate < 0 or rate is null").count() == 0
    out = mixing.mixed(clashing, domains, TARGETS)
    assert out.columns == clashing.columns
    assert mixing.rates(nothing, domains, TARGETS)[0].count() == 0
    even, _, _ = mixing.rates(odd, domains.limit(0), TARGETS)
    assert {r["rate"] for r in even.collect()} == {1.0}
    assert mixing.mixed(odd, domains.limit(0), TARGETS).count() == odd.count()


def test_copies_follow_the_rates(docs, labels):
    domains = mixing.label_domains(labels)
    rated, _, _ = mixing.rates(docs, domains, TARGETS)
    want = {r["doc_id"]: r["copies"] for r in rated.collect() if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in mixing.mixed(docs, domains, TARGETS).groupBy("doc_id").count().collect()}
    assert got == want


def test_bounded_sample_is_bounded_and_repeats(docs):
    sample = bounded_sample(docs, "lang", 50)
    counts = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert set(counts) == {"en", "de", "fr", "es"} and all(20 < n < 90 for n in counts.values())
    assert sorted(r[0] for r in sample.select("doc_id").collect()) == sorted(r[0] for r in sample.select("doc_id").collect())
