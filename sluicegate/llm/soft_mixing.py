"""Mixing to target weights with soft domain membership.

A table of labelled documents trains a classifier, which gives every document a posterior
over the domains. Each document then gets a rate, how often it is taken on average, such
that the expected tokens of every domain, sum over documents of rate x tokens x posterior,
match the targets. The rates minimise the squared misses, weighted per domain, under
rate >= 0, by projected gradient descent from equal rates. In the inner product that weighs
a document by its tokens the gradient of a document is a weighted sum of the domains' misses
with its posterior as weights. So a rate is a short fold over the misses of all steps so far:
a step is one aggregate over (tokens, posterior), no rates are stored between steps, and a
lost executor costs nothing but its tasks.

The classifier is a multinomial logistic regression on hashed words and runs of signs. It is
fitted on at most `max_labelled` labelled documents, chosen by the hash of their ids; all
counts and totals are over all documents. A fit that has not met its targets after
`MAX_STEPS` steps says so (`converged`).

Defined results: a NULL text is empty, has no tokens and the posterior of an empty text. A
label row without an id, a domain or a document is left out, and one of several labels of a
document is used. A target for a domain without labelled documents can't be met and is left
out, the others scaled up, and one for more than there is of a domain is lowered; with fewer than two labelled domains the posterior is 1 for the
only one, and without any every rate is 1. Of equal posteriors the domain that sorts first is
the likeliest. Very long texts count whole. Equal rows get equal rates and copies. An empty
frame gives an empty frame. Other columns are kept or left out whole, so that no name can
clash.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.llm.tables import Staging
from sluicegate.sources.workspace import broadcast_if_small

FEATURES = 1 << 14
MAX_LABELLED = 20_000
MAX_STEPS = 200
TOLERANCE = 1e-4
_TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"


@dataclass(frozen=True)
class Mixture:
    """A fitted mixture: domains in the order of the posterior, the classifier (None with
    fewer than two domains), the starting rate and the steps' multiples of the posterior.
    `reached` and `targets` are expected tokens per domain; `asked` are the targets before any
    was lowered, and `converged` says whether all were reached. `fitted` has the posteriors
    of the documents it was fitted to (row, n_tokens, posterior) if they were to be kept."""

    domains: tuple[str, ...]
    model: LogisticRegressionModel | None
    start: float
    steps: tuple[tuple[float, ...], ...]
    reached: tuple[float, ...]
    targets: tuple[float, ...]
    asked: tuple[float, ...] = ()
    converged: bool = True
    fitted: DataFrame | None = None


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))


def _hashed(rows: DataFrame) -> DataFrame:
    """`rows` with `features`, the presence of each hashed token of `tokens`."""
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="tokens", outputCol="features").transform(rows)


def fit_classifier(
    docs: DataFrame, labelled: DataFrame, key: str, text: str, max_labelled: int, staging: Staging
) -> tuple[tuple[str, ...], LogisticRegressionModel | None]:
    """The domains and the classifier from `labelled` (id, domain)."""
    chosen = (
        labelled.filter(F.col("id").isNotNull() & F.col("domain").isNotNull())
        .groupBy("id")
        .agg(F.min("domain").alias("domain"))
    )
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    known = chosen.join(texts.select("id").distinct(), "id", "left_semi")
    known = staging.keep(known, "known")
    # Each task drops its own share of what is beyond the bound, with room for chance.
    found = known.count()
    share = 1.0 if found <= max_labelled else 0.97 * max_labelled / found
    known = staging.keep(known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))), "labelled")
    domains = tuple(sorted(r["domain"] for r in known.select("domain").distinct().collect()))
    if len(domains) < 2:
        return domains, None
    at = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1
    rows = texts.join(broadcast_if_small(known), "id").select(
        at.cast("double").alias("label"), _tokens(F.col("text")).alias("tokens")
    )
    train = staging.keep(_hashed(rows).select("label", "features"), "train")
    return domains, LogisticRegression(regParam=1e-3, maxIter=40, family="multinomial").fit(train)


def with_posteriors(rows: DataFrame, domains: tuple[str, ...], model: LogisticRegressionModel | None) -> DataFrame:
    """row, text -> row, n_tokens, posterior."""
    tokens = rows.select("row", _tokens(F.col("text")).alias("tokens"))
    count = F.size("tokens").cast("bigint").alias("n_tokens")
    if model is None:
        return tokens.select("row", count, F.array(*[F.lit(1.0) for _ in domains]).cast("array<double>").alias("posterior"))
    return model.transform(_hashed(tokens)).select("row", count, vector_to_array("probability").alias("posterior"))


def rate_of(posterior: Column, start: float, steps: tuple[tuple[float, ...], ...]) -> Column:
    """The rate after all steps: each subtracts its sum with the posterior, not below 0."""
    if not steps:
        return F.lit(float(start))
    domains = range(len(steps[0]))
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])

    def move(rate: Column, step: Column) -> Column:
        return F.greatest(F.lit(0.0), rate - sum((posterior[d] * step[d] for d in domains), F.lit(0.0)))

    return F.aggregate(moves, F.lit(float(start)), move)


def _step_size(gram: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights that bring the domains to one scale, and one over the largest eigenvalue."""
    scale = 1 / np.maximum(np.diag(gram), 1e-9)
    root = np.sqrt(scale)
    return scale, 1 / np.linalg.eigvalsh(root[:, None] * gram * root[None, :]).max()


def fit_mixture(
    docs: DataFrame,
    labelled: DataFrame,
    weights: Mapping[str, float],
    anchor: str,
    epochs: float,
    key: str = "doc_id",
    text: str = "text",
    max_labelled: int = MAX_LABELLED,
    max_epochs: float | None = None,
    keep_fitted: bool = False,
) -> Mixture:
    """Fit rates so that domain d has `weights[d]` of all expected tokens, and the domain
    `anchor` is taken `epochs` times over. `labelled` has the columns id and domain.

    A domain of which there is too little is not made up for by taking other documents for
    it: a target above `max_epochs` (default: `epochs`) times the domain's tokens is lowered
    to that. Starts jobs; what comes to the driver is a few numbers per pair of domains.
    """
    staging = Staging(docs.sparkSession, "mixing")
    domains, model = fit_classifier(docs, labelled, key, text, max_labelled, staging)
    row = F.col(f"`{key}`") if keep_fitted else F.lit(None).cast("int")
    compact = staging.keep(
        with_posteriors(docs.select(row.alias("row"), F.col(f"`{text}`").alias("text")), domains, model), "posteriors"
    )

    def result(start: float, steps: list, reached: np.ndarray, targets: np.ndarray, asked: np.ndarray, converged: bool) -> Mixture:
        if not keep_fitted:
            staging.close()
        fitted = compact if keep_fitted else None
        return Mixture(domains, model, start, tuple(steps), tuple(reached), tuple(targets), tuple(asked), converged, fitted)

    many = range(len(domains))
    tokens, own = F.col("n_tokens"), F.col("posterior")
    moments = [F.sum(tokens * own[d]) for d in many] + [F.sum(tokens * own[d] * own[e]) for d in many for e in many]
    seen = [float(x or 0.0) for x in compact.agg(F.count(F.lit(1)), *moments).first()[1:]]
    base, gram = np.array(seen[: len(domains)]), np.array(seen[len(domains) :]).reshape(len(domains), len(domains))
    wanted = np.array([weights.get(d, 0.0) for d in domains])
    if not domains or base.sum() == 0 or wanted.sum() == 0:
        return result(1.0, [], base, base, base, True)
    wanted = wanted / wanted.sum()
    at = domains.index(anchor) if anchor in domains and wanted[domains.index(anchor)] else int(wanted.argmax())
    asked = wanted * (epochs * base[at] / wanted[at])
    targets = np.minimum(asked, (max_epochs or epochs) * base)
    start = float(targets.sum() / base.sum())
    steps: list[tuple[float, ...]] = []
    least = np.inf
    while True:
        rated = compact.select("n_tokens", "posterior", rate_of(own, start, tuple(steps)).alias("rate"))
        free = F.when(F.col("rate") > 0, tokens).otherwise(0)
        sums = [F.sum(tokens * own[d] * F.col("rate")) for d in many]
        sums += [F.sum(free * own[d] * own[e]) for d in many for e in many]
        seen = [float(x) for x in rated.agg(*sums).first()]
        reached, free_gram = np.array(seen[: len(domains)]), np.array(seen[len(domains) :]).reshape(gram.shape)
        miss = reached - targets
        converged = bool(np.abs(miss).max() <= TOLERANCE * targets.sum())
        if converged or len(steps) == MAX_STEPS:
            break
        # Rates at 0 don't move, so the step is fitted to the others; if that overshoots, the
        # next one is bounded by all rates, which can't.
        error = float((miss**2 / np.maximum(np.diag(gram), 1e-9)).sum())
        scale, size = _step_size(free_gram if error < least else gram)
        least = min(least, error)
        steps.append(tuple((size * scale * miss).tolist()))
    return result(start, steps, reached, targets, asked, converged)


def _mixed(scored: DataFrame, mixture: Mixture, seed: Column) -> DataFrame:
    """row, n_tokens, posterior -> row, n_tokens, domain, rate, copies: the rate rounded up
    or down by a draw from the row's hash, so that copies have the rate on average."""
    rated = scored.select(
        "row",
        seed.alias("seed"),
        "n_tokens",
        F.array(*[F.lit(d) for d in mixture.domains]).cast("array<string>").alias("domains"),
        "posterior",
        rate_of(F.col("posterior"), mixture.start, mixture.steps).alias("rate"),
    )
    draw = F.pmod(F.col("seed"), F.lit(1 << 30)) / float(1 << 30)
    best = F.get("domains", (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    return rated.select(
        "row", "n_tokens", best.alias("domain"), "rate", F.floor(F.col("rate") + draw).cast("bigint").alias("copies")
    )


def mixing_rates(docs: DataFrame, mixture: Mixture, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_tokens, domain (the likeliest), rate, copies. The
    documents need not be those that the mixture was fitted to."""
    rows = docs.select(F.col(f"`{key}`").alias("row"), F.col(f"`{text}`").alias("text"))
    scored = with_posteriors(rows, mixture.domains, mixture.model)
    return _mixed(scored, mixture, F.xxhash64("row", F.lit("mixing"))).withColumnRenamed("row", key)


def fitted_rates(mixture: Mixture, key: str = "doc_id") -> DataFrame:
    """`mixing_rates` of the documents that the mixture was fitted to, without reading their
    texts again. The stored posteriors stay until the session's shared folder is cleared."""
    return _mixed(mixture.fitted, mixture, F.xxhash64("row", F.lit("mixing"))).withColumnRenamed("row", key)


def mix(docs: DataFrame, mixture: Mixture, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, each as often as its copies say, with their own columns."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text")
    )
    scored = with_posteriors(rows, mixture.domains, mixture.model)
    taken = _mixed(scored, mixture, F.xxhash64(F.col("row")[key], F.lit("mixing")))
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return taken.select("row", repeated).select("row.*")
