import pytest
from conftest import project_frame
from pyspark.sql import functions as F

from sitelight.functions.columns import confidence_label, wilson_interval
from sitelight.operators import dashboard, risk, rules, segments


@pytest.mark.parametrize("value, bucket", [
    (None, "small"), (float("nan"), "small"), (0.0, "small"), (24_999_999.0, "small"), (25_000_000.0, "medium"),
    (74_999_999.0, "medium"), (75_000_000.0, "large"), (1e8, "large"),
])
def test_size_bucket(spark, value, bucket):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(segments.size_bucket(F.col("v"))).first()[0] == bucket


@pytest.mark.parametrize("delay, days, expected", [(30.0, 365, 30 / 366), (5.0, 0, 5.0), (None, 3, None), (3.0, None, None), (1.0, -1, None)])
def test_normalized_delay(spark, delay, days, expected):
    df = spark.createDataFrame([(delay, days)], "d double, n int")
    assert df.select(segments.normalized_delay(F.col("d"), F.col("n"))).first()[0] == expected


@pytest.mark.parametrize("k, n, low, high", [(0, 0, 0, 0), (3, 3, 0.4385, 1.0), (0, 3, 0.0, 0.5615), (2, 3, 0.2077, 0.9385), (2, 2, 0.3424, 1.0)])
def test_wilson(spark, k, n, low, high):
    df = spark.createDataFrame([(k, n)], "k int, n int")
    bounds = df.select(*wilson_interval(F.col("k"), F.col("n"))).first()
    assert bounds[0] == pytest.approx(low, abs=1e-4) and bounds[1] == pytest.approx(high, abs=1e-4)


def test_confidence(spark):
    df = spark.range(0, 8).select("id", confidence_label(F.col("id")).alias("c")).orderBy("id")
    assert [r.c for r in df.collect()] == ["low"] * 3 + ["medium"] * 3 + ["high"] * 2


def test_demo_scores(demo):
    projects, _ = demo
    rows = {r.project_id: r for r in risk.scores(projects).collect()}
    assert [rows[f"PRJ{i:03d}"].score for i in range(1, 16)] == [56, 37, 65, 31, 45, 53, 63, 42, 71, 37, 55, 37, 64, 38, 59]
    assert {r.breakdown.top_driver for r in rows.values()} == {"size_risk"}
    subs = rows["PRJ009"].breakdown.subscores
    assert [subs.type_risk, subs.region_risk, subs.size_risk, subs.complexity_risk, subs.duration_risk] == [0.6667, 0.75, 1.0, 1.0, 0.1537]
    flags = {k: r.breakdown.flags for k, r in rows.items() if r.breakdown.flags}
    everything = ["sparse_type", "sparse_region", "unknown_duration"]
    assert flags == {"PRJ006": everything, "PRJ011": everything, "PRJ003": everything[1:], "PRJ013": everything[1:],
                     "PRJ008": everything[2:], "PRJ015": everything[2:]}


def test_scores_of_odd_rows(spark):
    df = project_frame(spark, [
        {"project_type": "A"}, {"project_type": None, "region": None, "contract_value_usd": None, "subcontractor_count": None},
        {"portfolio_id": "empty-values", "contract_value_usd": None, "subcontractor_count": None, "delay_days": -9.0},
    ])
    rows = {r.project_id: r.breakdown for r in risk.scores(df).collect()}
    assert rows["id001"].flags == ["sparse_type", "sparse_region"]
    assert rows["id001"].subscores.size_risk == 0.0 and rows["id001"].subscores.complexity_risk == 0.0
    assert rows["id002"].subscores.size_risk == 0.0 and rows["id002"].subscores.duration_risk == 0.0


def test_contributions_and_bands(spark, demo):
    projects, _ = demo
    parts = [r for r in risk.contributions(risk.scores(projects)).collect() if r.project_id == "PRJ009"]
    parts.sort(key=lambda r: r.position)
    assert [p.dimension for p in parts] == ["size_risk", "complexity_risk", "region_risk", "type_risk", "duration_risk"]
    assert parts[2].points == pytest.approx(15.0)
    bands = spark.createDataFrame([(34,), (35,), (64,), (65,)], "s int").select(risk.risk_band(F.col("s"))).collect()
    assert [b[0] for b in bands] == ["success", "warning", "warning", "destructive"]


def test_demo_rules(demo):
    projects, _ = demo
    found = rules.rules(projects, segments.segments(projects))
    rows = {(r.scope, r.outcome): r for r in found.collect()}
    assert len(rows) == 36
    top = rows["project_type=Infrastructure", "high_overrun"]
    assert (top.rate, top.sample_size, top.ci_low, top.ci_high, top.confidence) == (0.6667, 3, 0.2077, 0.9385, "medium")
    assert rows["size_bucket=large", "any_dispute"].confidence == "low"
    assert rows["size_bucket=medium", "any_dispute"].rate == 0.6
    base = {r.outcome: r.baseline for r in rules.baselines(found).collect()}
    assert [round(base[o], 6) for o in ("high_overrun", "high_delay", "any_safety_incident", "any_dispute")] == [0.222222, 0.079996, 0.800008, 0.695661]
    signals = sorted(rules.top_signals(found, 5).collect(), key=lambda r: r.position)
    assert [round(s.salience, 6) for s in signals] == [0.769858, 0.549972, 0.527131, 0.496904, 0.491907]
    assert rules.rules(projects).exceptAll(found).isEmpty()


def test_insight_wording(demo):
    projects, _ = demo
    rows = {r.scope: r for r in rules.insights(rules.rules(projects)).collect()}
    assert rows["size_bucket=large"].subject == "large size-bucket"
    assert rows["region=Northeast"].subject == "Northeast region"
    assert rows["project_type=Commercial"].subject == "Commercial"


def test_demo_kpis(demo):
    projects, _ = demo
    line = dashboard.kpis(projects, risk.scores(projects)).first()
    assert line.total_contract_usd == 685_000_000 and line.n_completed == 9 and line.n_in_progress == 6
    assert line.mean_delay_days == pytest.approx(47.6) and line.n_scored == 15
    means = {r.project_type: r.mean_delay_days for r in dashboard.mean_by_type(projects, "delay_days").collect()}
    assert means == {"Commercial": 42.75, "Energy": 2.5, "Industrial": 6.0, "Infrastructure": 83.0, "Residential": 28.0}


def test_orderings(demo):
    projects, _ = demo
    scores = risk.scores(projects)
    assert [r.project_id for r in sorted(dashboard.riskiest(projects, scores).collect(), key=lambda r: r.position)] == [
        "PRJ009", "PRJ003", "PRJ013", "PRJ007", "PRJ015"]
    some = scores.where("project_id <> 'PRJ003'")
    watched = [(r.project_id, r.score) for r in dashboard.monitor(projects, some).collect()]
    assert watched[0] == ("PRJ013", 64) and watched[-1] == ("PRJ003", None)
    assert [r.project_id for r in dashboard.flagged(projects, some).collect()] == ["PRJ009", "PRJ007", "PRJ003"]
    assert [r.project_id for r in dashboard.flagged(projects).collect()] == ["PRJ009", "PRJ007", "PRJ003"]


def test_flag_texts(demo):
    projects, _ = demo
    reasons = {(r.project_id, r.flag): r.reason for r in dashboard.flag_reasons(projects).collect()}
    assert reasons["PRJ009", "delay_days_high"] == "Delay 201 days exceeds 150 day threshold"
    assert reasons["PRJ007", "cost_overrun_high"] == "Overrun 26.7% exceeds 25% threshold"
    counts = {r.category: r.n_projects for r in dashboard.flag_categories(projects).collect()}
    assert counts == {"cost_overrun": 2, "schedule_delay": 1, "safety": 2, "disputes": 3}


def test_sort_rules(spark):
    df = spark.createDataFrame([(1, "a10", 5.0), (2, "a2", None), (3, None, 1.0), (4, "A1", 9.0)], "project_id int, name string, v double")
    ids = lambda d: [r.project_id for r in d.collect()]
    assert ids(dashboard.sort_column(df, "v")) == [3, 1, 4, 2]
    assert ids(dashboard.sort_column(df, "v", descending=True)) == [2, 4, 1, 3]
    assert ids(dashboard.sort_column(df, "name")) == [4, 2, 1, 3]
    assert ids(dashboard.search(df, " A1 ", ["name"])) == [1, 4]
    assert ids(dashboard.search(df, "  ")) == [1, 2, 3, 4]


def test_distribution(spark):
    df = project_frame(spark, [{"delay_days": float(d)} for d in (1, 2, 3, 10)] + [
        {"portfolio_id": "few", "delay_days": 1.0}, {"portfolio_id": "flat", "delay_days": 2.0},
        {"portfolio_id": "flat", "delay_days": 2.0}, {"portfolio_id": "flat", "delay_days": 2.0}])
    rows = {r.portfolio_id: r for r in dashboard.distribution(df, ["delay_days"]).collect()}
    assert rows["p"].p50 == 2.5 and rows["few"].p50 is None and rows["few"].n == 1
    assert rows["flat"].median_position == 50.0


def test_category_choices(spark):
    df = project_frame(spark, [{"project_type": " B "}, {"project_type": "A"}, {"project_type": " ", "region": None}])
    portfolios = spark.createDataFrame([("p",), ("new",)], "portfolio_id string")
    rows = [(r.portfolio_id, r.kind, r.choice) for r in dashboard.category_choices(df, portfolios).collect()]
    assert [c for p, k, c in rows if (p, k) == ("p", "project_type")] == ["A", "B"]
    assert [c for p, k, c in rows if (p, k) == ("new", "region")] == ["Midwest", "Mountain", "Northeast", "Southeast", "Southwest"]
