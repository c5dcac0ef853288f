import numpy as np
from conftest import project_frame

from sitelight.operators import clustering, models


def test_demo_models(demo):
    projects, _ = demo
    runs = {r.model_type: r for r in models.model_runs(projects).collect()}
    naive, honest = runs["naive"], runs["pre_construction"]
    assert naive.n_training_samples == honest.n_training_samples == 9
    assert naive.accuracy == honest.accuracy == 1.0
    assert "delay_days" in naive.features_used and "delay_days" not in honest.features_used
    assert honest.features_used == ["contract_value_usd", "subcontractor_count", "project_type_Commercial", "project_type_Industrial",
                                    "project_type_Infrastructure", "project_type_Residential", "region_Midwest", "region_Northeast", "region_Southeast"]
    assert set(honest.feature_importances) == set(honest.features_used)
    assert all(v >= 0 for v in naive.feature_importances.values())


def sample(n, seed):
    random = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind, region = random.choice(["A", "B", "C"]), random.choice(["N", "S"])
        value, subs = float(random.lognormal(16, 1)), int(random.integers(1, 15))
        eta = 0.3 * (subs - 7) + (1.2 if kind == "A" else -0.4) + random.normal()
        rows.append({"project_type": kind, "region": region, "contract_value_usd": value, "subcontractor_count": subs,
                     "payment_disputes": int(eta > 0)})
    return rows


def reference_fit(rows):
    """Penalised Newton on explicit one-hot columns."""
    kinds, regions = sorted({r["project_type"] for r in rows}), sorted({r["region"] for r in rows})
    x = np.array([[r["contract_value_usd"], r["subcontractor_count"], *[r["project_type"] == k for k in kinds], *[r["region"] == g for g in regions]] for r in rows], float)
    y = np.array([r["payment_disputes"] for r in rows], float)
    scale = np.r_[x[:, :2].std(axis=0), np.ones(x.shape[1] - 2)]
    shift = np.r_[x[:, :2].mean(axis=0), np.zeros(x.shape[1] - 2)]
    z = np.c_[np.ones(len(x)), (x - shift) / scale]
    penalty, theta = np.r_[0, 1 / scale**2], np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ theta))
        theta += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-12), z.T @ (y - p) - penalty * theta)
    names = ["contract_value_usd", "subcontractor_count", *[f"project_type_{k}" for k in kinds], *[f"region_{g}" for g in regions]]
    return dict(zip(names, np.abs(theta[1:] / scale))), float(np.mean((z @ theta > 0) == (y == 1)))


def test_equals_newton_on_dense_columns(spark):
    first, second = sample(400, 1), sample(120, 2)
    df = project_frame(spark, [{**r, "portfolio_id": "a"} for r in first] + [{**r, "portfolio_id": "b"} for r in second])
    runs = {r.portfolio_id: r for r in models.fit(df, models.PRE_CONSTRUCTION).collect()}
    for portfolio, rows in (("a", first), ("b", second)):
        weights, accuracy = reference_fit(rows)
        got = runs[portfolio].feature_importances
        assert abs(runs[portfolio].accuracy - accuracy) < 1e-9
        for name, value in weights.items():
            assert abs(got[name] - value) <= 1e-4 * max(abs(value), 1e-9) + 1e-9, name


def test_thin_and_single_class(spark):
    df = project_frame(spark, [{"portfolio_id": "thin"} for _ in range(4)] + [{"portfolio_id": "thin", "final_status": "In Progress"}]
                       + [{"portfolio_id": "calm", "payment_disputes": 0} for _ in range(6)]
                       + [{"portfolio_id": "gaps", "delay_days": None} for _ in range(6)])
    runs = {r.portfolio_id: r for r in models.fit(df, models.NAIVE).collect()}
    assert runs["thin"].status == "insufficient" and runs["thin"].n_completed == 4 and runs["thin"].accuracy is None
    assert runs["calm"].accuracy == 1.0 and runs["calm"].feature_importances == {} and runs["calm"].n_training_samples == 6
    assert runs["gaps"].status == "insufficient" and runs["gaps"].n_training_samples == 0
    ready = {r.portfolio_id: r.trainable for r in models.trainable(df).collect()}
    assert ready == {"thin": False, "calm": True, "gaps": True}


def test_shares_gap_and_latest(spark):
    runs = spark.createDataFrame(
        [("p", "naive", 0.9, {"delay_days": 3.0, "region_N": 1.0}, 1), ("p", "naive", 1.0, {"delay_days": 1.0}, 2),
         ("p", "pre_construction", 0.75, {"region_N": 0.0}, 1)],
        "portfolio_id string, model_type string, accuracy double, feature_importances map<string,double>, created_at int")
    latest = models.latest_runs(runs)
    assert {(r.model_type, r.created_at) for r in latest.collect()} == {("naive", 2), ("pre_construction", 1)}
    assert latest.count() == 2 and models.leakage_gap(latest).first().gap_points == 25.0
    shares = models.importance_share(runs.where("created_at = 1")).collect()
    assert [(s.feature, s.share, s.leaky, s.position) for s in sorted(shares, key=lambda s: s.position)] == [
        ("delay_days", 0.75, True, 1), ("region_N", 0.25, False, 2)]


def lloyd(x, k, seed):
    random = np.random.default_rng(seed)
    centres = x[random.choice(len(x), k, replace=False)]
    for _ in range(100):
        label = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(k)])
    return ((x - centres[label]) ** 2).sum()


def test_clusters(spark):
    random = np.random.default_rng(5)
    rows = [{"portfolio_id": "big", "project_type": random.choice(["A", "B"]), "region": random.choice(["N", "S"]),
             "contract_value_usd": float(random.lognormal(16 + 2 * (i % 3), 0.3)), "subcontractor_count": int(4 + 9 * (i % 3) + random.integers(0, 3))}
            for i in range(120)]
    sizes = {"three": 3, "five": 5, "eight": 8}
    rows += [{"portfolio_id": name, "contract_value_usd": 1e7 * (i + 1), "subcontractor_count": 3 * i, "project_type": "AB"[i % 2]} for name, n in sizes.items() for i in range(n)]
    for i, r in enumerate(rows):
        r["project_id"] = f"id{i:04d}"
    df = project_frame(spark, rows)
    got = {r.project_id: (r.portfolio_id, r.cluster_id) for r in clustering.assign_clusters(df).collect()}
    assert len(got) == len(rows)
    labels = lambda p: [got[r["project_id"]][1] for r in rows if r["portfolio_id"] == p]
    assert set(labels("three")) == {0} and set(labels("five")) == {0, 1} and set(labels("eight")) == {0, 1}
    assert set(labels("big")) == {0, 1, 2}
    x = np.array([[np.log1p(r["contract_value_usd"]), r["subcontractor_count"], r["project_type"] == "A", r["project_type"] == "B",
                   r["region"] == "N", r["region"] == "S"] for r in rows if r["portfolio_id"] == "big"], float)
    mine = np.array(labels("big"))
    cost = sum(((x[mine == j] - x[mine == j].mean(axis=0)) ** 2).sum() for j in range(3))
    assert cost <= min(lloyd(x, 3, s) for s in range(20)) * 1.001
    means = [x[mine == j, 0].mean() for j in range(3)]
    assert means == sorted(means)


def test_clusters_are_filled_and_settled(spark):
    """A crowd at one point, and a few rows far off: plain starts would all lie in the crowd."""
    rows = [{"project_id": f"a{i:03d}", "portfolio_id": "crowd", "contract_value_usd": 1e6, "subcontractor_count": 4} for i in range(300)]
    rows += [{"project_id": f"b{i}", "portfolio_id": "crowd", "contract_value_usd": 1e9, "subcontractor_count": 30 + i % 2} for i in range(2)]
    rows += [{"project_id": f"c{i}", "portfolio_id": "crowd", "contract_value_usd": 1e3, "subcontractor_count": 60} for i in range(2)]
    rows += [{"project_id": f"d{i}", "portfolio_id": "same", "contract_value_usd": 1e6, "subcontractor_count": 4} for i in range(9)]
    df = project_frame(spark, rows)
    clusters, report = clustering.fit_clusters(df)
    found = {r.project_id: r.cluster_id for r in clusters.collect()}
    assert [len({found[r["project_id"]] for r in rows if r["project_id"][0] == group}) for group in "abcd"] == [1, 1, 1, 1]
    assert len({found["a000"], found["b0"], found["c0"]}) == 3
    settled = {r.portfolio_id: r for r in report.collect()}
    assert settled["crowd"].converged and settled["same"].converged and settled["crowd"].rounds < 20
    checks = {r.portfolio_id: (r.n_rows, r.n_clusters, r.n_misplaced) for r in clustering.misplaced(df, clusters).collect()}
    assert checks == {"crowd": (304, 3, 0), "same": (9, 1, 0)}


def test_a_cluster_without_rows_takes_the_farthest():
    import pandas as pd

    blank = {"portfolio_id": "p", "type_key": "A", "region_key": "N", "spread": 1.0, "restart": 0, "moving": True, "rounds": 3}
    state = pd.DataFrame([{**blank, "value_0": 1.0, "count_0": 1.0, "constant_0": 0.0, "value_1": 90.0, "count_1": 9.0, "constant_1": 0.0}])
    sums = pd.DataFrame([{"portfolio_id": "p", "type_key": "A", "region_key": "N", "restart": 0, "cluster": 0, "n": 4, "v": 8.0, "s": 12.0, "far_distance": 25.0, "far_v": 7.0, "far_s": 3.0}])
    after = clustering._next_centres(2)(sums, state).iloc[0]
    assert (after.value_0, after.count_0, after.value_1, after.count_1, after.constant_1) == (2.0, 3.0, 7.0, 3.0, 0.0) and after.moving and after.rounds == 4
