"""Mixing against a dense solution in numpy, and the classifier by held-out labels."""

import numpy as np
from pyspark.sql import functions as F

from sitelight.llm import mixing, queries
from sitelight.llm.common import Scratch

SF = "/root/testdata/sf0.01"


def dense_rates(tokens, shares, target, rounds):
    rate = np.ones(len(tokens))
    mass = tokens[:, None] * shares
    for _ in range(rounds):
        scale = np.maximum((mass * (rate > 0)[:, None]).sum(axis=0), 1e-9)
        rate = np.maximum(0, rate - shares @ ((rate @ mass - target) / scale))
    return rate, rate @ mass


def test_rates_against_dense_steps(spark):
    draw = np.random.default_rng(5)
    tokens = draw.integers(0, 400, 300)
    shares = draw.dirichlet([0.2, 0.2, 0.2], 300)
    rows = [(i, int(t), [float(x) for x in p]) for i, (t, p) in enumerate(zip(tokens, shares, strict=True))]
    scored = spark.createDataFrame(rows, "doc_id long, tokens long, posterior array<double>")
    weights = {"a": 0.6, "b": 0.3, "c": 0.1}
    got, report = mixing.fit_rates(scored, ["a", "b", "c"], weights, Scratch(spark), total_tokens=50_000.0, rewrite=4)
    got = got.orderBy("doc_id").toPandas()
    want, totals = dense_rates(tokens, shares, np.array([30_000, 15_000, 5_000]), report["rounds"])
    assert report["converged"] and np.allclose(got.rate, want, atol=1e-9) and (got.rate >= 0).all()
    assert np.allclose(totals, [30_000, 15_000, 5_000], atol=50)


def test_copies_have_the_rate_as_their_mean(spark):
    rows = [(i, rate) for i in range(4000) for rate in (0.0, 0.05, 0.5, 0.95, 1.0, 2.3)]
    frame = spark.createDataFrame(rows, "id long, rate double").withColumn("copies", mixing.copies(F.col("rate"), mixing.draw("id", "rate")))
    means = {r.rate: r.mean for r in frame.groupBy("rate").agg(F.mean("copies").alias("mean")).collect()}
    assert means[0.0] == 0 and means[0.05] == 0 and means[0.95] == 1 and means[1.0] == 1
    assert abs(means[0.5] - 0.5) < 0.05 and abs(means[2.3] - 2.3) < 0.05


def test_copies_meet_the_targets(spark):
    """A domain that holds over ten times its target is thinned out, not dropped."""
    rows = [(i, "alpha beta gamma " * 5 if i % 5 < 3 else "delta epsilon zeta " * 5) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 5 < 3, "a").otherwise("b").alias("domain"))
    rated, domains, report = mixing.mix(docs, labels, {"a": 0.94, "b": 0.06})
    sums = rated.agg(*[F.sum(F.col("copies") * F.col("tokens") * F.col("posterior")[i]).alias(d) for i, d in enumerate(domains)]).first()
    low = rated.where("rate < 0.1").count()
    assert report["converged"] and low > 2000
    assert all(abs(sums[d] / report["targets"][d] - 1) < 0.2 for d in domains)


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = queries.domains(spark, SF).where("domain IS NOT NULL")
    held_out = F.col("doc_id") % 4 == 0
    model = mixing.fit_classifier(docs, labels.where(~held_out), Scratch(spark))
    got = mixing.posteriors(docs, model).join(labels.where(held_out), "doc_id").toPandas()
    predicted = np.array([model.domains[int(np.argmax(p))] for p in got.posterior])
    assert all(abs(sum(p) - 1) < 1e-9 for p in got.posterior)
    assert (predicted == got.domain).mean() > 0.75
    good = got.domain == "good"
    assert (predicted[good] == "good").mean() > 0.85


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "some text", "x"), (3, "some text", "x"), (None, "no id", "x"), (4, "idiot " * 20000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(3, "b"), (3, "a"), (4, "c"), (None, "a"), (1, None), (99, "a")], "doc_id long, domain string")
    rated, domains, report = mixing.mix(docs, labels, {"a": 0.5, "c": 0.5, "missing": 1.0})
    got = rated.collect()
    assert domains == ["a", "c"] and len(got) == 6 and all(r.rate >= 0 and len(r.posterior) == 2 for r in got)
    assert sorted(r.tokens for r in got) == [0, 0, 2, 2, 2, 20000]
    kept, _, again = mixing.mix(docs, labels, {"a": 0.5, "c": 0.5}, keep_text=True)
    assert sorted((str(r.text)[:9], round(r.rate, 6)) for r in kept.collect()) == sorted((str(t)[:9], round(r.rate, 6)) for r in got for t in [x[1] for x in rows if x[0] == r.doc_id][:1])
    none, domains, _ = mixing.mix(docs, labels.limit(0), {"a": 1.0})
    assert domains == [] and all(r.rate == 1 and r.copies == 1 and r.posterior == [] for r in none.collect())
    empty, _, _ = mixing.mix(docs.limit(0), labels, {"a": 1.0})
    assert empty.count() == 0


def test_main_path_is_free_of_python(spark):
    rated, _, _ = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), queries.domains(spark, SF), queries.MIXTURE, keep_text=True)
    plan = rated._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
