import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicegate.llm import soft_mixing as mixing
from sluicegate.llm.queries import op1_soft_mixing
from sluicegate.llm.settings import labelled_domains
from tests.llm.test_llm_queries import DATA

WEIGHTS = {"plain": 0.7, "code": 0.2, "rude": 0.1}
TOPICS = {"plain": "tree river house road", "code": "def return lambda index", "rude": "fool clown trash scum"}


def corpus(seed, n):
    """(doc_id, text, domain) with words of a topic among common ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        domain = rng.choice(["plain"] * 5 + ["code"] * 2 + ["rude"])
        own = TOPICS[domain].split() + ["the", "of", "a", "to"]
        rows.append((i, " ".join(rng.choice(own) for _ in range(rng.randrange(20, 120))), domain))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus(1, 600)
    docs = spark.createDataFrame([(i, t, "clash", 0.5) for i, t, _ in rows], "doc_id bigint, text string, domain string, rate double")
    labelled = spark.createDataFrame([(i, d) for i, _, d in rows if i % 3 == 0], "id bigint, domain string")
    return rows, docs, mixing.fit_mixture(docs, labelled, WEIGHTS, "plain", 1.5, max_epochs=3.0, keep_fitted=True)


def test_held_out_accuracy(fitted):
    rows, docs, mixture = fitted
    got = {r.doc_id: r.domain for r in mixing.mixing_rates(docs, mixture).collect()}
    held_out = [(i, d) for i, _, d in rows if i % 3]
    assert sum(got[i] == d for i, d in held_out) >= 0.95 * len(held_out)


def test_expected_totals_match_targets(fitted):
    rows, docs, mixture = fitted
    assert np.abs(np.array(mixture.reached) - mixture.targets).max() <= 1e-4 * sum(mixture.targets)
    assert np.allclose(np.array(mixture.targets) / sum(mixture.targets), [WEIGHTS[d] for d in mixture.domains])
    texts = docs.select(F.col("doc_id").alias("row"), "text")
    scored = {r.row: r for r in mixing.with_posteriors(texts, mixture.domains, mixture.model).collect()}
    rates = {r.doc_id: r.rate for r in mixing.mixing_rates(docs, mixture).collect()}
    totals = sum(np.array(s.posterior) * s.n_tokens * rates[i] for i, s in scored.items())
    assert np.allclose(totals, mixture.reached)
    assert min(rates.values()) >= 0


def test_rates_against_plain_descent(fitted):
    """The fold gives what a loop over stored rates gives."""
    rows, docs, mixture = fitted
    texts = docs.select(F.col("doc_id").alias("row"), "text")
    scored = mixing.with_posteriors(texts, mixture.domains, mixture.model).collect()
    posteriors = np.array([s.posterior for s in scored])
    rate = np.full(len(scored), mixture.start)
    for step in mixture.steps:
        rate = np.maximum(0, rate - posteriors @ np.array(step))
    got = {r.doc_id: r.rate for r in mixing.mixing_rates(docs, mixture).collect()}
    assert np.allclose([got[s.row] for s in scored], rate)


def test_a_domain_that_is_hardly_there_does_not_push_others_out(frame):
    rows = [(i, t, d) for i, t, d in corpus(2, 500) if d != "rude"] + [(900, "fool clown " * 20, "rude")]
    docs = frame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labelled = frame([(i, d) for i, _, d in rows], "id bigint, domain string")
    mixture = mixing.fit_mixture(docs, labelled, {"plain": 0.6, "code": 0.1, "rude": 0.3}, "plain", 1.25)
    rates = {r.doc_id: r.rate for r in mixing.mixing_rates(docs, mixture).collect()}
    assert min(rates[i] for i, _, d in rows if d == "plain") >= 1
    assert max(rates.values()) < 2.5


def test_copies_follow_rates(fitted):
    rows, docs, mixture = fitted
    rated = mixing.mixing_rates(docs, mixture).collect()
    assert all(int(r.rate) <= r.copies <= int(r.rate) + 1 for r in rated)
    assert abs(sum(r.copies for r in rated) - sum(r.rate for r in rated)) < 40
    assert sorted(mixing.fitted_rates(mixture).collect()) == sorted(rated)
    mixed = mixing.mix(docs, mixture)
    assert mixed.schema == docs.schema
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {r.doc_id: r.copies for r in rated if r.copies}


def test_odd_rows(fitted, frame):
    _, _, mixture = fitted
    rows = [(1, None), (2, ""), (None, "tree"), (3, "tree"), (3, "tree"), (4, "word " * 40_000)]
    got = mixing.mixing_rates(frame(rows, "doc_id bigint, text string"), mixture).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, 40_000)]
    assert len({(r.rate, r.copies) for r in got if r.doc_id == 3}) == 1
    assert mixing.mixing_rates(frame([], "doc_id bigint, text string"), mixture).collect() == []
    assert mixing.mix(frame([], "doc_id bigint, text string"), mixture).collect() == []


def test_few_labels(frame):
    docs = frame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    schema = "id bigint, domain string"
    for labels in ([], [(None, "plain"), (1, None), (99, "plain")], [(1, "plain"), (1, "plain")]):
        mixture = mixing.fit_mixture(docs, frame(labels, schema), WEIGHTS, "plain", 1.0)
        got = mixing.mixing_rates(docs, mixture).collect()
        assert [(r.n_tokens, round(r.rate, 9), r.copies) for r in sorted(got)] == [(2, 1.0, 1), (0, 1.0, 1)]
    empty = frame([], "doc_id bigint, text string")
    mixture = mixing.fit_mixture(empty, frame([(1, "plain")], schema), WEIGHTS, "plain", 1.0)
    assert mixing.mixing_rates(empty, mixture).collect() == []


def test_query(spark):
    truth = {r.id: r.domain for r in labelled_domains(spark, DATA).collect()}
    got = op1_soft_mixing(spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    rates = {r.doc_id: r.rate for r in got}
    mean = lambda d: np.mean([rates[i] for i, t in truth.items() if t == d and i in rates])
    assert mean("good") > 1 > 0.5 > mean("toxic")
