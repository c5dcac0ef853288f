"""Mixing documents to target weights with soft domain membership.

A classifier fitted on a labelled table gives every document a posterior over
the domains: multinomial logistic regression on which telling words a text has.
Words are hashed to ``buckets``; the ``features`` buckets whose shares differ
most between the domains are kept. The expected tokens of a domain are the sum
of rate times tokens times posterior. Starting from rate 1, projected gradient
steps on the squared distance to the target totals move all rates, and stop at
0. Gradients are scaled by what the rates above 0 hold of each domain; scaled
so, the system is a stochastic matrix and the step 1 does not overshoot. A step
needs the domains' sums only, so a round is one aggregation over a narrow table
and the new gradient is a handful of numbers; rates are rewritten to the shared
folder now and then.

Everything here is DataFrame expressions. Bounds: the classifier is fitted on
about ``sample`` rows per domain, chosen by hash, in ``epochs`` passes over
their features; its weights are ``features`` numbers per domain. Priors count
all labelled rows, targets and rates all documents.

Defined results: null and empty texts have no tokens and the posterior of a
text without telling words; labels with a null id or domain are ignored, an id
with several domains gets the first in text order; without labels there are no
domains and every rate is 1; a target without any expected tokens cannot be
reached and is left out with a weight of 0; repeated rows are separate
documents; all columns are kept, ``tokens``, ``posterior``, ``rate`` and
``copies`` added or replaced.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelight.llm.common import Scratch


#: A rate this close to a whole number is one.
NUMERIC = 1e-6
#: Standard errors that a telling bucket's share differs from the mean share by, at least.
CLEAR = 6.0


@dataclass
class Classifier:
    domains: list[str]
    places: list[int]  # feature of each bucket, or -1
    weights: list[list[float]]  # by domain: of each feature, then the constant


def tokens(text: Column) -> Column:
    """Runs of letters, and runs of other visible characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit("\\p{L}+|[^\\p{L}\\s]+"), F.lit(0))


def numbers(values: list, kind: str) -> Column:
    """A constant array."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def features(found: Column, places: list[int]) -> Column:
    """The distinct features among tokens."""
    table = numbers(places, "int")
    numbered = F.transform(found, lambda token: F.get(table, bucket(token, len(places))))
    return F.array_distinct(F.filter(numbered, lambda place: place >= 0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once per row: a generator keeps the optimizer
    from copying the expression into every place, and every lambda, that uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_posterior(df: DataFrame, kept: str, weights: list[list[float]], name: str) -> DataFrame:
    """Softmax of the linear scores of the features."""
    def part(row: list[float]) -> Column:
        table = numbers([round(w, 6) for w in row[:-1]], "double")
        return F.exp(F.least(F.aggregate(kept, F.lit(float(row[-1])), lambda total, place: total + F.get(table, place)), F.lit(300.0)))

    parts = once(df, "__parts", F.array(*[part(row) for row in weights]))
    each = [F.col("__parts")[i] for i in range(len(weights))]
    return once(parts, name, F.array(*[x / sum(each[1:], each[0]) for x in each])).drop("__parts")


def draw(*columns: str) -> Column:
    """A number in [0, 1) from the hash of the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(2**31)) / 2**31


def _telling(seen: DataFrame, domains: list[str], sizes: list[int], most: int, buckets: int) -> list[int]:
    """Places of the buckets whose shares of rows differ most between domains."""
    counts = seen.select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)])
    share = sum((F.col(f"n{i}") / size for i, size in enumerate(sizes)), F.lit(0.0)) / len(sizes)
    grades = F.array(*[(F.col(f"n{i}") - size * share) ** 2 / (size * share + 1) for i, size in enumerate(sizes)])
    best = counts.select("bucket", F.array_max(grades).alias("grade")).where(F.col("grade") > CLEAR**2).orderBy(F.desc("grade"), "bucket").limit(most)
    places = [-1] * buckets
    for place, row in enumerate(best.collect()):
        places[row.bucket] = place
    return places


def fit_classifier(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, id_column: str = "doc_id", text_column: str = "text", sample: int = 3000, buckets: int = 2**18,
    most: int = 512, epochs: int = 30, pace: float = 0.6,
) -> Classifier:
    """``labels`` has the id column and ``domain``."""
    labels = labels.select(F.col(id_column).alias("id"), F.col("domain").cast("string").alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL")
    labels = scratch.write(labels.groupBy("id").agg(F.min("domain").alias("domain")), "mix-labels")
    counts = {r.domain: r.n for r in labels.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(counts)
    if not domains:
        return Classifier([], [], [])
    share = F.create_map(*[x for d in domains for x in (F.lit(d), F.lit(min(1.0, sample / counts[d])))])
    chosen = scratch.write(labels.where(draw("id") < share[F.col("domain")]).repartition(1), "mix-sample")  # the sample is bounded
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(chosen, "id")
    seen = texts.select("domain", F.array_distinct(F.transform(tokens(F.col("text")), lambda t: bucket(t, buckets))).alias("buckets"))
    seen = scratch.write(seen, "mix-buckets")
    sizes = {r.domain: r.n for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    size = [max(1, sizes.get(d, 0)) for d in domains]
    places = _telling(seen, domains, size, most, buckets)
    table = numbers(places, "int")
    kept = F.array_distinct(F.filter(F.transform("buckets", lambda b: F.get(table, b)), lambda place: place >= 0))
    rows = scratch.write(seen.select(kept.alias("kept"), *[(F.col("domain") == d).cast("double").alias(f"y{i}") for i, d in enumerate(domains)]).coalesce(4), "mix-features")

    # Adam steps on the mean loss; the gradient is one sum per feature and domain
    weights = [[0.0] * (most + 1) for _ in domains]
    drift, spread = [[0.0] * (most + 1) for _ in domains], [[0.0] * (most + 1) for _ in domains]
    total = max(1, sum(sizes.values()))
    for epoch in range(1, epochs + 1):
        p = with_posterior(rows, "kept", weights, "p").withColumn("at", F.concat("kept", F.array(F.lit(most))))
        wrong = p.select(F.explode("at").alias("at"), *[(F.col("p")[i] - F.col(f"y{i}")).alias(f"g{i}") for i in range(len(domains))])
        for row in wrong.groupBy("at").agg(*[F.sum(f"g{i}").alias(f"g{i}") for i in range(len(domains))]).collect():
            for i in range(len(domains)):
                g, at = row[f"g{i}"] / total, row["at"]
                drift[i][at] = 0.9 * drift[i][at] + 0.1 * g
                spread[i][at] = 0.99 * spread[i][at] + 0.01 * g * g
                weights[i][at] -= pace * (drift[i][at] / (1 - 0.9**epoch)) / (math.sqrt(spread[i][at] / (1 - 0.99**epoch)) + 1e-8)
    for i, d in enumerate(domains):  # from the sample's shares to those of all labels
        weights[i][-1] += math.log(counts[d] / sum(counts.values())) - math.log(size[i] / total)
    scratch.drop("mix-labels", "mix-sample", "mix-buckets", "mix-features")
    return Classifier(domains, places, weights)


def posteriors(docs: DataFrame, model: Classifier, text_column: str = "text") -> DataFrame:
    """``docs`` with tokens and posterior (an array in the order of the domains)."""
    found = once(docs.drop("tokens", "posterior"), "__tokens", tokens(F.col(text_column))).withColumn("tokens", F.size("__tokens").cast("long"))
    if not model.domains:
        return found.withColumn("posterior", F.array().cast("array<double>")).drop("__tokens")
    kept = once(found, "__kept", features(F.col("__tokens"), model.places)).drop("__tokens")
    return with_posterior(kept, "__kept", model.weights, "posterior").drop("__kept")


def _moved(rate: Column, steps: list[list[float]]) -> Column:
    """The rate after the given gradient steps."""
    if not steps:
        return rate
    history = numbers(steps, "array<double>")

    def step(now: Column, gradient: Column) -> Column:
        slopes = [F.col("posterior")[i] * gradient[i] for i in range(len(steps[0]))]
        return F.greatest(F.lit(0.0), now - sum(slopes[1:], slopes[0]))

    return F.aggregate(history, rate, step)


def fit_rates(
    scored: DataFrame, domains: list[str], weights: dict[str, float], scratch: Scratch, total_tokens: float | None = None, tolerance: float = 1e-3, rounds: int = 100, rewrite: int = 10
) -> tuple[DataFrame, dict]:
    """``scored`` with ``rate``, and a report. Without ``total_tokens`` the
    total is the largest at which no domain needs more than it has."""
    n = len(domains)
    stored = scratch.write(scored.withColumn("rate", F.lit(1.0)), "mix-rates-0")
    held = [F.col("tokens") * F.col("posterior")[i] for i in range(n)]
    sums = [F.sum(x * F.col("now")).alias(f"e{i}") for i, x in enumerate(held)] + [F.sum(F.when(F.col("now") > 0, x)).alias(f"a{i}") for i, x in enumerate(held)]

    def totals(steps: list[list[float]]) -> tuple[list[float], list[float]]:
        """Expected tokens by domain, and what documents with a rate above 0 hold."""
        row = once(stored.select("tokens", "posterior", "rate"), "now", _moved(F.col("rate"), steps)).agg(*sums).first()
        return [row[f"e{i}"] or 0.0 for i in range(n)], [max(row[f"a{i}"] or 0.0, 1e-9) for i in range(n)]

    now, scale = totals([]) if n else ([], [])
    want = [max(0.0, weights.get(d, 0.0)) * (now[i] > 0) for i, d in enumerate(domains)]
    if not sum(want):
        return stored, {"converged": not n or not sum(weights.values()), "rounds": 0, "targets": {}, "totals": dict(zip(domains, now, strict=True)), "path": []}
    want = [w / sum(want) for w in want]
    whole = total_tokens if total_tokens is not None else min(now[i] / w for i, w in enumerate(want) if w > 0)
    target = [w * whole for w in want]
    steps: list[list[float]] = []
    path: list[list[float]] = []
    done = turn = 0
    while max(abs(a - b) for a, b in zip(now, target, strict=True)) > tolerance * max(whole, 1e-9) and done < rounds:
        steps.append([(a - b) / s for a, b, s in zip(now, target, scale, strict=True)])
        path.append(steps[-1])
        done += 1
        if len(steps) == rewrite:
            turn += 1
            stored = scratch.write(stored.withColumn("rate", _moved(F.col("rate"), steps)), f"mix-rates-{turn}")
            scratch.drop(f"mix-rates-{turn - 1}")
            steps = []
        now, scale = totals(steps)
    report = {
        "converged": max(abs(a - b) for a, b in zip(now, target, strict=True)) <= tolerance * max(whole, 1e-9), "rounds": done,
        "targets": dict(zip(domains, target, strict=True)), "totals": dict(zip(domains, now, strict=True)), "path": path,
    }
    return once(stored.withColumnRenamed("rate", "__rate"), "rate", _moved(F.col("__rate"), steps)).drop("__rate"), report


def copies(rate: Column, chance: Column, sure: float = 0.1) -> Column:
    """Whole copies whose mean is the rate; a part within ``sure`` of a whole
    number is rounded. Mixing rounds numeric noise only, so that its copies meet
    the targets that its rates meet."""
    part = rate - F.floor(rate)
    extra = F.when(part >= 1 - sure, 1).when(part <= sure, 0).when(chance < part, 1).otherwise(0)
    return (F.floor(rate) + extra).cast("int")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], id_column: str = "doc_id", text_column: str = "text", total_tokens: float | None = None, keep_text: bool = False) -> tuple[DataFrame, list[str], dict]:
    """(``docs`` with tokens, posterior, rate and copies, and with their text
    if it is to be kept; the domains; the report)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("tokens", "posterior", "rate", "copies")
    model = fit_classifier(docs, labels, scratch, id_column, text_column)
    scored = posteriors(docs, model, text_column)
    if keep_text:  # a text is read again rather than written beside its rate
        _, report = fit_rates(scored.select("tokens", "posterior"), model.domains, weights, scratch, total_tokens)
        rated = once(scored, "rate", _moved(F.lit(1.0), report["path"]))
    else:
        rated, report = fit_rates(scored.drop(text_column), model.domains, weights, scratch, total_tokens)
    return rated.withColumn("copies", copies(F.col("rate"), draw(id_column, "tokens", "rate"), NUMERIC)), model.domains, report
