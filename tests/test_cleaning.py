import pytest
from conftest import raw_frame

from sitelight.operators import cleaning
from sitelight.sources.project_files import read_project_files


def cleaned(spark, rows):
    projects, summary = cleaning.clean(raw_frame(spark, rows))
    return {r.project_id_external: r for r in projects.collect()}, {r.portfolio_id: r for r in summary.collect()}


def test_missing_column_is_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("project_id,project_name\n1,x\n")
    with pytest.raises(ValueError, match="Missing required columns: .*region"):
        read_project_files(spark, str(tmp_path / "a.csv"))


def test_quotes_newlines_and_null_tokens(spark, tmp_path):
    from sitelight import schema as S

    target = tmp_path / "portfolios" / "p1"
    target.mkdir(parents=True)
    values = ["A1", '"two\nlines, ""quoted"""', "N/A", "1e3", "2020-01-01", "null", "None", "3", "", "nan", "1", "0", "Completed"]
    (target / "raw.csv").write_text(",".join(S.REQUIRED_COLUMNS) + "\n" + ",".join(values) + "\n")
    row = read_project_files(spark, str(target / "raw.csv"), multiline=True).first()
    assert row.portfolio_id == "p1"
    assert row.project_name == 'two\nlines, "quoted"'
    assert [row.project_type, row.end_date, row.region, row.delay_days, row.cost_overrun_pct] == [None] * 5


def test_files_with_their_own_header_order(spark, tmp_path):
    from sitelight import schema as S

    values = dict(zip(S.REQUIRED_COLUMNS, "K1,Mill,Energy,5,2020-01-02,2020-02-03,West,2,3,4,0,1,Completed".split(","), strict=True))
    orders = {"a": [*S.REQUIRED_COLUMNS], "b": ["note", *reversed(S.REQUIRED_COLUMNS), "note"], "c": [*S.REQUIRED_COLUMNS]}
    for name, columns in orders.items():
        (tmp_path / "portfolios" / name).mkdir(parents=True)
        (tmp_path / "portfolios" / name / "raw.csv").write_text(",".join(columns) + "\n" + ",".join(values.get(c, "extra") for c in columns) + "\n")
    rows = read_project_files(spark, str(tmp_path / "portfolios/*/*.csv")).collect()
    assert sorted(r.portfolio_id for r in rows) == ["a", "b", "c"]
    assert all(r[c] == v for r in rows for c, v in values.items())


def test_first_copy_wins_and_null_keys_leave(spark):
    rows, summary = cleaned(spark, [
        {"project_id": None, "project_name": "keyless"}, {"project_id": "B-7", "project_name": "early"}, {"project_id": "A-1"},
        {"project_id": "B-7", "project_name": "late"}, {"project_id": "B-7", "project_name": "latest"}, {"project_id": "B-7", "portfolio_id": "q"},
    ])
    assert set(rows) == {"A-1", "B-7"} and rows["A-1"].project_name == "Depot"
    assert summary["p"].rows_rejected == 3 and summary["p"].row_count == 2 and summary["q"].rows_rejected == 0


def test_median_of_completed_only(spark):
    done = [{"cost_overrun_pct": v} for v in ("1.5", "9", "6.5", "3", None)]
    running = [{"cost_overrun_pct": v, "final_status": "In Progress"} for v in ("400", None)]
    rows, summary = cleaned(spark, done + running)
    assert rows["PRJ004"].cost_overrun_pct == 4.75 and rows["PRJ005"].cost_overrun_pct == 400.0 and rows["PRJ006"].cost_overrun_pct == 4.75
    assert [(i.column, i.n_filled, i.value) for i in summary["p"].imputations] == [("cost_overrun_pct", 2, 4.75)]


def test_running_outcomes_stay_empty(spark):
    rows, _ = cleaned(spark, [
        {"payment_disputes": "7"}, {"payment_disputes": None}, {"payment_disputes": "2"},
        {"payment_disputes": None, "safety_incidents": None, "subcontractor_count": None, "final_status": "In Progress"},
    ])
    assert rows["PRJ001"].payment_disputes == 4.5
    assert rows["PRJ003"].payment_disputes is None and rows["PRJ003"].safety_incidents is None
    assert rows["PRJ003"].subcontractor_count == 13


def test_no_reference_rows_means_no_fill(spark):
    rows, summary = cleaned(spark, [{"delay_days": None, "final_status": "In Progress"}])
    assert rows["PRJ000"].delay_days is None and summary["p"].imputations == []


@pytest.mark.parametrize("change, flag", [
    ({"cost_overrun_pct": "26"}, "cost_overrun_high"), ({"delay_days": "151"}, "delay_days_high"),
    ({"safety_incidents": "5"}, "safety_incidents_high"), ({"payment_disputes": "5"}, "payment_disputes_high"),
    ({"cost_overrun_pct": "25", "delay_days": "150", "safety_incidents": "4"}, None),
])
def test_flags(spark, change, flag):
    rows = cleaning.flag_anomalies(cleaning.coerce_types(raw_frame(spark, [change]))).collect()
    assert rows[0].anomaly_flags == ([flag] if flag else [])


def test_nan_fires_nothing(spark):
    df = spark.sql("select double('nan') as cost_overrun_pct, double('nan') as delay_days, 0 as safety_incidents, null as payment_disputes")
    assert cleaning.flag_anomalies(df).first().anomaly_flags == []


def test_coercions(spark):
    df = raw_frame(spark, [
        {"delay_days": "12d", "contract_value_usd": "1,000", "start_date": "2021-02-30", "cost_overrun_pct": "1e1"},
        {"end_date": "2021-01-01", "start_date": "2021-01-31"},
    ])
    first, second = cleaning.coerce_types(df).orderBy("project_id").collect()
    assert first.delay_days is None and first.contract_value_usd is None and first.start_date is None
    assert first.cost_overrun_pct == 10.0 and first.actual_duration_days is None
    assert second.actual_duration_days == -30
    lost = {r.column: r.n_invalid for r in cleaning.coercion_report(df).collect()}
    assert lost["delay_days"] == 1 and lost["contract_value_usd"] == 1 and lost["start_date"] == 1
    assert lost["end_date"] == 0 and "actual_duration_days" in lost


def test_demo(demo):
    projects, summary = demo
    rows = {r.project_id_external: r for r in projects.collect()}
    assert len(rows) == 15
    flags = {k: r.anomaly_flags for k, r in rows.items() if r.anomaly_flags}
    assert flags == {
        "PRJ003": ["payment_disputes_high"],
        "PRJ007": ["cost_overrun_high", "safety_incidents_high", "payment_disputes_high"],
        "PRJ009": ["cost_overrun_high", "delay_days_high", "safety_incidents_high", "payment_disputes_high"],
    }
    assert rows["PRJ003"].delay_days == 47.0 and rows["PRJ015"].cost_overrun_pct == 8.2
    assert rows["PRJ013"].safety_incidents is None
    durations = {k: r.actual_duration_days for k, r in rows.items() if r.actual_duration_days is not None}
    assert durations == {"PRJ001": 897, "PRJ002": 575, "PRJ004": 578, "PRJ005": 910, "PRJ007": 1277,
                         "PRJ009": 1307, "PRJ010": 701, "PRJ012": 821, "PRJ014": 517}
    line = summary.first()
    assert (line.row_count, line.anomaly_count, line.rows_rejected) == (15, 3, 0)
    assert [(i.column, i.n_filled, i.value) for i in line.imputations] == [
        ("delay_days", 2, 47.0), ("cost_overrun_pct", 2, 8.2)]


def test_validation(spark):
    from sitelight import schema as S

    columns = [c for c in S.OUTPUT_COLUMNS if c != "anomaly_flags"]
    def entry(**change):
        base = dict.fromkeys(columns)
        base.update(project_id_external="A", start_date="2025-01-01", end_date="2025-01-31", actual_duration_days="99", **change)
        return [base[c] for c in columns]

    data = [entry(), entry(contract_value_usd="-1"), entry(subcontractor_count="-2"), entry(final_status="Paused"),
            entry(delay_days="-3", final_status=" ")]
    data[3][columns.index("start_date")] = "01/02/2025"
    data.append([None] * len(columns))
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))
    valid, rejected = cleaning.validate_projects(df)
    assert [r.actual_duration_days for r in valid.collect()] == [30, 30]
    errors = sorted(r.errors for r in rejected.collect())
    assert errors == [["bad_date:start_date", "bad_status"], ["missing:project_id_external"],
                      ["negative:contract_value_usd"], ["negative:subcontractor_count"]]
