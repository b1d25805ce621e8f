"""Loan files, staged tables and report output."""

import re

import pytest

from loanvane.operators.cohort import label_loans
from loanvane.plans import loan_study
from loanvane.runtime import bounded_rows, small_table
from loanvane.sources import loan_csv, reports
from loanvane.sources.loan_view import VIEW_YEARS, loan_view

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def loan_file(tmp_path):
    text = (
        'id,issue_d,loan_amnt,int_rate,desc,loan_status,odd\n'
        '1, Dec-2015 ,1000,7.5,"first line\nsecond ""quoted"" line",Fully Paid,x\n'
        '2,Jan-2014,NA, 8.25 ,,Charged Off,NA\n'
        '3,,500,,"",Current,"NA"\n'
    )
    (tmp_path / "part.csv").write_text(text)
    return str(tmp_path)


def test_csv_scan(spark, loan_file):
    df = loan_csv.read_loans(spark, loan_file, multiline=True)
    assert dict(df.dtypes)["loan_amnt"] == "double" and dict(df.dtypes)["odd"] == "string"
    rows = {r["id"]: r for r in df.collect()}
    assert len(rows) == 3
    assert rows["1"]["issue_d"] == "Dec-2015"
    assert rows["1"]["desc"] == 'first line\nsecond "quoted" line'
    assert rows["2"]["loan_amnt"] is None and rows["2"]["int_rate"] == 8.25 and rows["2"]["odd"] is None
    assert rows["3"]["issue_d"] is None and rows["3"]["desc"] is None and rows["3"]["odd"] is None


RECORDS = [
    '1, Dec-2015 ,1000,7.5,"first line\nsecond ""quoted"" line\n\n",Fully Paid,x',
    '2,Jan-2014,NA, 8.25 ,,Charged Off,NA',
    '3,,500,,"",Current,"NA"',
    '4,May-2015,about 7,1,"two\nlines",Current,x',
    '5,May-2015,7,1',
    '6,May-2015,7,1,t,Current,x,more',
]


@pytest.mark.parametrize("block", [40, 64, 1 << 20])
def test_scan_splits_records_and_parts_bad_ones(spark, tmp_path, block):
    head = "id,issue_d,loan_amnt,int_rate,desc,loan_status,odd\n"
    many = [r.replace(r[0], str(10 * k + int(r[0])), 1) for k in range(1, 20) for r in RECORDS]
    (tmp_path / "a.csv").write_text(head + "\n".join(RECORDS) + "\n\n")
    (tmp_path / "b.csv").write_text(head + "\n".join(many))
    (tmp_path / "c.csv").write_text(head)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        parts = loan_csv.part_scan(loan_csv.scan_loans(spark, str(tmp_path / "*.csv")), str(tmp_path / f"out{block}"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = {int(r["id"]): r for r in parts.good.collect()}
    assert sorted(rows) == sorted(10 * k + i for k in range(20) for i in (1, 2, 3))
    assert rows[51]["desc"] == 'first line\nsecond "quoted" line\n\n' and rows[1]["issue_d"] == "Dec-2015"
    assert rows[2]["loan_amnt"] is None and rows[2]["int_rate"] == 8.25 and rows[2]["odd"] is None
    assert rows[3]["desc"] is None and rows[3]["odd"] is None
    assert (parts.n_read, parts.n_bad, parts.bad.count()) == (120, 60, 60)
    assert set(RECORDS[3:]) < {r[loan_csv.BAD_RECORD] for r in parts.bad.collect()}


def test_scan_of_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,loan_amnt\n")
    parts = loan_csv.part_scan(loan_csv.scan_loans(spark, str(tmp_path / "a.csv")), str(tmp_path / "out"))
    assert (parts.n_read, parts.n_bad, parts.good.count(), parts.good.columns) == (0, 0, 0, ["id", "loan_amnt"])


def test_loan_table_round_trip(spark, loan_file, tmp_path):
    labelled = label_loans(loan_csv.read_loans(spark, loan_file, multiline=True))
    loan_csv.write_loan_table(labelled, str(tmp_path / "table"))
    back = loan_csv.read_loan_table(spark, str(tmp_path / "table"))
    assert {(r["id"], r["issue_year"], r["default_prelim"]) for r in back.collect()} == {("1", "2015", 0), ("2", "2014", 1)}
    plan = back.filter("issue_year = '2015'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(issue_year" in plan


def test_report_output(spark, tmp_path):
    df = spark.createDataFrame([("Logit", 0.12345)], "model string, auc double")
    shown = reports.report_table(df, {"model": "Model", "auc": "AUC"}, 3)
    reports.write_report(shown, str(tmp_path / "report"))
    back = spark.read.option("header", True).csv(str(tmp_path / "report")).collect()
    assert [(r["Model"], r["AUC"]) for r in back] == [("Logit", "0.123")]
    reports.write_figure_data(df, str(tmp_path / "figure"))
    assert spark.read.parquet(str(tmp_path / "figure")).count() == 1


def test_small_table_size_check(spark):
    assert "LocalTableScan" in small_table(spark.range(10).selectExpr("id * 2 AS x"))._jdf.queryExecution().executedPlan().toString()
    for large in (small_table(spark.range(10), limit=5), small_table(spark.range(10), max_bytes=8)):
        assert large.is_cached and large.count() == 10
        large.unpersist()
    with pytest.raises(ValueError):
        bounded_rows(spark.range(10), 5)


def test_no_query_input_is_copied(spark):
    plan = loan_view(spark, SF).select("id", "grade")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_quantity" not in plan.split("Relation")[0] and "Repartition" not in plan


def test_modelling_table(spark):
    data = loan_study.build_modelling_data(loan_view(spark, SF), VIEW_YEARS, target_rows=400)
    audit = {r["step"]: r for r in data.audit.collect()}
    assert audit[4]["n_rows"] == audit[7]["n_rows"] == data.table.count() <= 400
    assert audit[3]["rows_removed"] == audit[2]["n_rows"] - audit[3]["n_rows"]
    assert "collections_12_mths_ex_med" not in data.table.columns and "fico_range_low" not in data.table.columns
    assert "mths_since_last_delinq" not in data.table.columns and "fico_avg" in data.table.columns
    assert "id" not in data.profile.toPandas()["variable"].tolist()
    split = loan_study.split_and_impute(data.table)
    assert "id" not in split.numeric and "fico_bin" in split.categorical and "term_60" in split.numeric
    narrow = loan_study.split_and_impute(data.table, use_score_band=False)
    assert "fico_bin" not in narrow.categorical


def test_records_reach_over_pieces_and_lines_move_once(spark, monkeypatch):
    """Pieces of two lines, records of one to nine: ends are put together. No window holds a whole block of a file."""
    from loanvane.sources import loan_csv

    monkeypatch.setattr(loan_csv, "PIECE_BITS", 1)
    rows, lines = [], ["id,note"]
    for i in range(40):
        text = "\n".join(f"part {k}" for k in range(1 + i * 5 % 9))
        rows.append(f'{i},"{text}"')
        lines += rows[-1].split("\n")
    table = spark.createDataFrame([(v, "f", 0 if i < 60 else 1000, i) for i, v in enumerate(lines)], "value string, file string, block long, at long")
    cut = loan_csv.split_records(table)
    assert sorted(r["record"] for r in cut.collect()) == sorted(rows)
    monkeypatch.setattr(loan_csv, "PIECE_BITS", 14)
    cut = loan_csv.split_records(table.repartition(4))
    assert sorted(r["record"] for r in cut.collect()) == sorted(rows)
    assert "Window" in (plan := cut._jdf.queryExecution().optimizedPlan().toString())
    assert not any(w.startswith("at#") for w in re.findall(r"windowspecdefinition\(file#\d+, block#\d+L?, (\w+#)", plan))


def test_raw_loans_are_counted_for_the_audit_only(spark, monkeypatch):
    """The modelling table takes one pass over the raw loans; stages are counted when the audit trail is asked for."""
    count = loan_study.stage_counts
    monkeypatch.setattr(loan_study, "stage_counts", None)
    data = loan_study.build_modelling_data(loan_view(spark, SF), VIEW_YEARS)
    assert data.rows == data.table.count() > 400
    sample = loan_study.build_modelling_data(loan_view(spark, SF), VIEW_YEARS, target_rows=400)
    assert sample.rows == sample.table.count()
    monkeypatch.setattr(loan_study, "stage_counts", count)
    audit = {r["step"]: r["n_rows"] for r in sample.audit.collect()}
    assert audit[1] == loan_view(spark, SF).count() and audit[3] == data.rows and audit[7] == sample.rows
