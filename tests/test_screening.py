import numpy as np
import pyarrow as pa
import pytest
from conftest import project_frame

from sitelight.operators import screening

BID = "bid_id string, portfolio_id string, project_type string, region string, contract_value_usd double, subcontractor_count int, k int"


def brute_force(bid, rows):
    """Explicit one-hot vectors, cosine distance, stable order."""
    rows = [r for r in rows if r["portfolio_id"] == bid[1]]
    if not rows:
        return []
    rows.sort(key=lambda r: r["project_id"])
    median = lambda c: float(np.median([r[c] for r in rows if r[c] is not None] or [0.0]))
    value_gap, subs_gap = median("contract_value_usd"), median("subcontractor_count")
    types = sorted({r["project_type"] or "unknown" for r in rows})
    regions = sorted({r["region"] or "unknown" for r in rows})

    def vector(value, subs, kind, region):
        return np.r_[np.log1p(max(0.0, value)), subs, [float(t == kind) for t in types], [float(g == region) for g in regions]]

    value = bid[4]
    value = value_gap if value is not None and np.isnan(value) else (value or 0.0)
    query = vector(value, bid[5] or 0, bid[2], bid[3])
    if np.linalg.norm(query) < 1e-12:
        return [r["project_id"] for r in rows][: bid[6]]
    distances = []
    for r in rows:
        v = vector(value_gap if r["contract_value_usd"] is None else r["contract_value_usd"],
                   subs_gap if r["subcontractor_count"] is None else r["subcontractor_count"],
                   r["project_type"] or "unknown", r["region"] or "unknown")
        distances.append(round(1 - query @ v / np.linalg.norm(query) / np.linalg.norm(v), 12))
    order = np.argsort(distances, kind="stable")
    return [rows[i]["project_id"] for i in order][: bid[6]]


def random_history(n, seed):
    random = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        copy = i % 3 == 0  # a third of all rows is one and the same point
        rows.append({
            "project_id": f"id{i:05d}",
            "portfolio_id": "hot" if i % 7 else "cold",
            "project_type": "T0" if copy else random.choice(["T0", "T1", "T2", None]),
            "region": "R0" if copy else random.choice(["R0", "R1", None]),
            "contract_value_usd": 5e6 if copy else (None if random.random() < 0.05 else float(random.lognormal(16, 1.5))),
            "subcontractor_count": 6 if copy else (None if random.random() < 0.05 else int(random.integers(0, 12))),
            "payment_disputes": None if i % 5 == 0 else i % 2,
        })
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    rows = random_history(1500, seed)
    random = np.random.default_rng(seed + 10)
    bids = []
    for i in range(60):
        bids.append((f"b{i:02d}", random.choice(["hot", "cold"]), random.choice(["T0", "T1", "T2", "unknown", "new"]),
                     random.choice(["R0", "R1", "elsewhere"]), float(random.lognormal(16, 2)), int(random.integers(0, 20)), int(random.integers(1, 21))))
    bids += [("nan", "hot", "T0", "R0", float("nan"), 3, 5), ("null", "hot", "T1", "R0", None, None, 20),
             ("zero", "cold", "new", "elsewhere", -5.0, 0, 4), ("negative", "hot", None, None, -1.0, 2, 7),
             ("same", "hot", "T0", "R0", 5e6, 6, 20), ("nowhere", "empty", "T0", "R0", 1e6, 1, 5)]
    df, history = spark.createDataFrame(bids, BID), project_frame(spark, rows)
    got = {}
    for r in screening.nearest(df, history).collect():
        got.setdefault(r.bid_id, []).append((r.position, r.project_id))
    for bid in bids:
        assert [p for _, p in sorted(got.get(bid[0], []))] == brute_force(bid, [dict(r) for r in rows]), bid


def test_only_near_blocks_are_opened(spark):
    """With larger portfolios most blocks stay closed."""
    rows = project_frame(spark, random_history(6000, 3))
    encoded = screening.encode_history(rows)
    blocks = screening.blocked(encoded, 5).groupBy(*screening.BLOCK).count()
    largest = blocks.agg({"count": "max"}).first()[0]
    assert blocks.count() > 80 and largest < 200


def test_demo_cohort(spark, demo):
    projects, _ = demo
    bids = spark.createDataFrame([("b", "demo", "Infrastructure", "Northeast", 75e6, 18, 5), ("c", "other", "Infrastructure", "Northeast", 75e6, 18, 5),
                                  ("d", "demo", "Infrastructure", "Northeast", 75e6, 18, 50)], BID)
    rows = {r.bid_id: r for r in screening.screen(bids, projects).collect()}
    row = rows["b"]
    assert row.similar_project_ids == ["PRJ013", "PRJ003", "PRJ007", "PRJ005", "PRJ001"] and row.caveats == []
    o = row.outcomes
    assert (o.delay_days.p25, o.delay_days.p50, o.delay_days.p75) == (47, 47, 89)
    assert (o.cost_overrun_pct.p25, o.cost_overrun_pct.p50, o.cost_overrun_pct.p75) == (8.2, 11.4, 18.4)
    assert (o.safety_incidents.p25, o.safety_incidents.p50, o.safety_incidents.p75, o.safety_incidents.n, o.safety_incidents.confidence) == (2.75, 3.5, 4.5, 4, "medium")
    assert o.any_dispute.rate == 1.0 and round(o.any_dispute.ci_low, 6) == 0.565509
    empty = rows["c"]
    assert empty.cohort_size == 0 and empty.similar_project_ids == [] and empty.caveats[0].startswith("No similar projects")
    assert empty.outcomes.any_dispute.rate is None and empty.outcomes.delay_days.confidence == "low"
    assert "d" not in rows


def test_k_out_of_bounds_is_rejected_with_a_reason(spark, demo):
    projects, _ = demo
    bids = spark.createDataFrame([(f"k{k}", "demo", "Energy", "Mountain", 3e7, 9, k) for k in (-3, 0, 1, 20, 21, None)], BID)
    assert {(r.bid_id, r.k, r.error) for r in screening.rejected_bids(bids).collect()} == {(f"k{k}", k, "k must be between 1 and 20") for k in (-3, 0, 21)}
    assert {r.bid_id: r.cohort_size for r in screening.screen(bids, projects).collect()} == {"k1": 1, "k20": 15, "kNone": 5}


def test_small_cohort_caveat(spark):
    history = project_frame(spark, [{"payment_disputes": None}, {"payment_disputes": 0}, {"payment_disputes": 2}])
    bids = spark.createDataFrame([("b", "p", "Commercial", "Northeast", 1e7, 5, 5)], BID)
    row = screening.screen(bids, history).first()
    assert row.caveats == ["n<5 cohort (n=3) — treat ranges as directional, not predictive."]
    assert row.outcomes.any_dispute.n == 2 and row.outcomes.any_dispute.rate == 0.5


def test_runs_and_pieces_of_the_directory_give_the_same_rows(spark, monkeypatch):
    """Cells cut into runs, a directory in several pieces, bids in several groups."""
    for name, rows in (("RUN_BLOCKS", 3), ("PIECE_BLOCKS", 16), ("BID_ROWS", 20)):
        monkeypatch.setattr(screening, name, rows)
    test_equals_brute_force(spark, 2)


def test_bisection_opens_what_trying_every_block_opens():
    random = np.random.default_rng(4)
    edges = np.sort(random.uniform(10, 19, 200)).reshape(100, 2)
    blocks = [{"portfolio_id": "p", "type_key": t, "region_key": "R0", "subs": s, "bin": i, "run": 0, "low": low, "high": high, "n": int(random.integers(1, 9))}
              for t in ("T0", "T1") for s in (0.0, 3.0, 9.0) for i, (low, high) in enumerate(edges)]
    bids = []
    for i in range(50):
        value, subs = float(random.uniform(0, 20)), float(random.integers(0, 12))
        bids.append({"bid_id": i, "portfolio_id": "p", "k": int(random.integers(1, 21)), "bid_log_value": value, "bid_subs": subs,
                     "bid_norm": float(np.sqrt(value**2 + subs**2 + 2)), "bid_type": random.choice(["T0", "T1", "none"]), "bid_region": "R0"})
    kind = pa.struct([("bid_id", pa.int64()), ("k", pa.int32()), ("bid_log_value", pa.float64()), ("bid_subs", pa.float64()),
                      ("bid_norm", pa.float64()), ("bid_type", pa.string()), ("bid_region", pa.string())])
    meeting = screening._Meeting(pa.array([{f.name: b[f.name] for f in kind} for b in bids], kind), pa.array(blocks))
    reach = meeting.reach()
    opened = set(zip(*(part.tolist() for part in meeting.opened(reach)[:2]), strict=True))
    for i, bid in enumerate(bids):
        sure, best = [], []
        for block in blocks:
            fixed = bid["bid_subs"] * block["subs"] + float(bid["bid_type"] == block["type_key"]) + 1.0
            at = lambda x: max(0.0, min(2.0, 1 - (bid["bid_log_value"] * x + fixed) / (bid["bid_norm"] * np.sqrt(x * x + block["subs"] ** 2 + 2))))  # noqa: B023, E731
            peak = bid["bid_log_value"] * (block["subs"] ** 2 + 2) / fixed
            best.append(at(max(block["low"], min(block["high"], peak))) - screening.SLACK)
            sure += [max(at(block["low"]), at(block["high"])) + screening.SLACK] * block["n"]
        assert sorted(sure)[bid["k"] - 1] <= reach[i] + 1e-12 < np.inf
        assert {b for r, b in opened if r == i} == {j for j, d in enumerate(best) if d <= reach[i]}
    assert len(opened) < 0.2 * len(bids) * len(blocks)
