"""Null rules, edge tables and error cases operator by operator."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabulith.functions.kinds import columns_by_kind, financial_columns, resolve_column
from tabulith.operators import aggregation as A
from tabulith.operators import charts as Ch
from tabulith.operators import cleaning as C
from tabulith.operators import compliance as Co
from tabulith.operators import finance as Fi
from tabulith.operators import joins as J
from tabulith.operators import profiling as P
from tabulith.operators import selection as S
from tabulith.operators import sorting as So
from tabulith.operators import windows as X
from tabulith.operators.insights import insights
from tabulith.plans.cleaning import clean_table
from tabulith.operators import sorting as S_sorting
from tabulith.plans.overview import analysis_flow, insight_flow, join_flow, profile_flow
from tabulith.sources import files, report


def test_markers_keep_other_blanks(spark, rows):
    df = spark.createDataFrame([("\tN/A\n",), (" x ",), ("",), ("NIL",), ("n/a ",), ("Nil",), (None,)], "s string")
    assert [r[0] for r in C.null_markers(df).collect()] == [None, " x ", None, None, None, "Nil", None]
    assert rows(C.marker_counts(df)) == [("s", 4)]


def test_names():
    assert C.standard_names(["A b", "A_b", " %Total--Sum ", "___", "é x"]) == ["a_b", "a_b_2", "total_sum", "unnamed_column", "é_x"]


@pytest.mark.parametrize("text, want", [
    ("2024-01-15", datetime(2024, 1, 15)), ("2024/1/5 06:07:08", datetime(2024, 1, 5, 6, 7, 8)),
    ("03/22/2024", datetime(2024, 3, 22)), ("22/03/2024", datetime(2024, 3, 22)), ("15 Jan 2024", datetime(2024, 1, 15)),
    ("January 15, 2024", datetime(2024, 1, 15)), ("2024-01-15T10:00:00", datetime(2024, 1, 15, 10)), ("85", None),
    ("4.5", None), ("2024-13-45", None), ("word", None), ("5 Foo 2024", None)])
def test_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(C.as_timestamp(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("text, want", [("$1,234.50", 1234.5), (" €7 ", 7.0), ("1e3", 1000.0), ("1d", None), ("-", None), ("¥-3", -3.0)])
def test_numbers(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(C.as_number(F.col("s"))).first()[0] == want


def test_types_from_all_rows_or_the_first(spark):
    df = spark.createDataFrame([(i, "2024-01-01" if i < 8 else "x", "5" if i < 20 else "x") for i in range(30)], "i int, d string, n string")
    assert C.inferred_kinds(df) == {"d": "text", "n": "text"}
    assert C.inferred_kinds(spark.createDataFrame([(None,)], "s string")) == {"s": "text"}


MESSY = [(1, "85", " Ann ", "$1,000", "2024-01-15"), (2, "N/A", "-", "$2,000", "2024-02-15"), (3, "60", "Bob", "$3,000", None),
         (3, "60", "Bob", "$3,000", None), (4, "", "Cy", "n/a", "2024-04-15"), (5, "70", "Di", "$500", "2024-05-15")]


def test_clean_table(spark, rows):
    df = spark.createDataFrame(MESSY, "ID int, `Exam Score` string, Name string, Paid string, `When?` string").repartition(3)
    done = clean_table(df, ["ID"])
    got = [tuple(r) for r in done.table.orderBy("id").collect()]
    assert done.table.columns == ["id", "exam_score", "name", "paid", "when"]
    assert got[1][1] == 71.67 and got[1][2] == "Unknown" and got[0][2] == "Ann"  # mean of 85, 60, 70
    assert got[2][4] == datetime(2024, 2, 15)  # carried forward
    assert got[3][3] == 1625.0
    assert done.duplicates_removed == 1
    # 5 rows lack: 2 scores, 1 name, 1 payment, 1 date; markers: 2 + 1 + 1; 30 cells
    assert done.data_completeness == round((1 - 9 / 30) * 100, 1) and done.completeness_simple == round((1 - 5 / 30) * 100, 1)
    facts = {(r["column"], r["metric"]): r["value"] for r in done.report.collect()}
    assert facts["exam_score", "missing_rows"] == "2, 4" and facts["when", "converted_to"] == "datetime"
    assert facts["Exam Score", "renamed_to"] == "exam_score" and facts["name", "action"] == "filled 1 with 'Unknown'"


def test_clean_table_without_gaps_or_text(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "a int, b double")
    done = clean_table(df, ["a"])
    assert done.table.count() == 2 and done.data_completeness == 100.0


def test_all_null_number_stays_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b double")
    assert C.impute_numeric(df).where("b IS NULL").count() == 2


def test_filters_and_nulls(spark):
    df = spark.createDataFrame([(1.0, "Red"), (2.0, None), (None, "blue")], "n double, s string")
    assert S.filter_compare(df, "n", "!=", 1).count() == 2
    assert S.filter_compare(df, "s", "!=", "red").count() == 2
    assert S.filter_compare(df, "s", "==", "RED").count() == 1
    assert S.filter_contains(df, "s", "na").count() == 0  # a missing text is no text
    assert S.filter_contains(df, "s", "^b", negate=True).count() == 2
    assert S.filter_auto(df, "n", "2").count() == 1 and S.filter_auto(df, "s", "LU").count() == 1
    for bad in (lambda: S.filter_compare(df, "s", ">", "a"), lambda: S.filter_compare(df, "n", "~", 1),
                lambda: S.filter_between(df, "s", 1, 2), lambda: S.filter_compare(df, "x", "==", 1)):
        with pytest.raises(ValueError):
            bad()


def test_calculated_column_divides_by_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 3.0)], "a double, b double")
    assert [r["c"] for r in S.calculated_column(df, "c", "a", "b", "divide").collect()] == [None, 0.33]
    assert [r["c"] for r in S.calculated_column(df, "c", "a", "b", "ratio_pct").collect()] == [None, 33.33]
    with pytest.raises(ValueError):
        S.calculated_column(df, "c", "a", "b", "power")


def test_bins(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 2, 2.1, 4, 10)] + [(None,)], "x double")
    assert [r["x_bin"] for r in S.bin_equal_width(df, "x", 5).collect()] == [1, 1, 2, 2, 5, None]
    named = S.bin_equal_width(df, "x", 2, ["low", "high"])
    assert [r["x_binned"] for r in named.collect()] == ["low", "low", "low", "low", "high", None]
    same = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert {r["x_bin"] for r in S.bin_equal_width(same, "x", 5).collect()} == {3}
    assert S.bin_equal_width(df.where("x IS NULL"), "x").first()["x_bin"] is None


def test_mapping_and_one_hot(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert [r[0] for r in S.map_values(df, "s", {"a": "z"}).collect()] == ["z", "b", None]
    assert [tuple(r) for r in S.one_hot(df, "s").collect()] == [(1, 0), (0, 1), (0, 0)]
    sparse = S.one_hot(df, "s", sparse=True)
    assert [r["s_onehot"] for r in sparse.collect()] == [{"a": 1}, {"b": 1}, None]
    assert S.rename_column(df, "s", "t").columns == ["t"] and S.rename_column(df, "x", "t").columns == ["s"]


def test_groups_drop_null_keys(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), (None, 9.0)], "g string, v double")
    assert rows(A.group_agg(df, "g", "v", "sum")) == [("a", 1.0), ("b", 0.0)]
    assert rows(A.group_agg(df, "g", "v", "median")) == [("a", 1.0), ("b", None)]
    assert A.group_agg(df, "g", "v", "nonsense").columns == ["g", "v_sum"]
    assert rows(A.pivot_table(df, "g", "v", "sum")) == [("a", 1.0)]


def test_correlation_of_constants_and_gaps(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0, None), (2.0, 5.0, 4.0, 1.0), (3.0, 5.0, 6.0, 1.0)], "a double, k double, b double, h double")
    got = {(r["col1"], r["col2"]): r["correlation"] for r in A.correlation_matrix(df).collect()}
    assert got["a", "b"] == 1.0 and got["a", "k"] is None and got["k", "k"] is None and got["a", "h"] is None
    assert got["a", "a"] == 1.0 and len(got) == 16


def test_kpis_of_few_rows(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 4.0, None)], "i int, v double, e double")
    got = A.kpis(df, ["i"], ["v", "e"]).collect()
    assert len(got) == 1 and got[0]["growth_pct"] == 100.0 and got[0]["std"] == 1.41


def test_compare_two_values_needs_a_host(spark):
    df = spark.createDataFrame([("A", "x", 1.0), ("B", "x", 2.0)], "s string, t string, v double")
    assert {r["group_value"] for r in A.compare_two_values(df, "v", "a", "b").collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        A.compare_two_values(df, "v", "a", "q")


def test_seasonality_needs_twelve_rows(spark):
    df = spark.createDataFrame([(datetime(2024, m, 1), float(m)) for m in range(1, 12)], "d timestamp_ntz, v double")
    assert A.seasonality(df, "d", "v").count() == 0 and A.seasonality_peaks(df, "d", "v").count() == 0
    more = df.union(spark.createDataFrame([(datetime(2024, 12, 1), 0.5)], df.schema))
    row = A.seasonality_peaks(more, "d", "v").first()
    assert (row["peak_month"], row["low_month"], row["seasonal_range"]) == ("November", "December", 10.5)


def test_joins_with_null_and_hot_keys(spark, rows):
    a = spark.createDataFrame([(" X ", 1), ("y", 2), (None, 3)] + [("hot", i) for i in range(50)], "k string, v int")
    b = spark.createDataFrame([("x", 10), (None, 30), ("hot", 40), ("hot", 41), ("z", 50)], "k string, w int")
    sizes = {"inner": 101, "left": 103, "right": 103, "outer": 105}
    for how, n in sizes.items():
        plain = J.smart_join(a, b, "k", "k", how)
        assert plain.columns == ["k", "v", "k_joined", "w"] and plain.count() == n
        assert rows(J.smart_join(a, b, "k", "k", how, split_sides=True)) == rows(plain)
        stats = J.join_stats(a, b, "k", "k", how).first()
        assert stats["merged_rows"] == n and stats["left_matched"] == 101
        together = J.smart_join(a, b, "k", "k", how, null_match=True)
        assert together.where("k IS NULL AND k_joined IS NULL AND v = 3 AND w = 30").count() == 1
        assert J.join_stats(a, b, "k", "k", how, null_match=True).first()["merged_rows"] == together.count()
    quality = J.join_quality(a, b, "k", "k").first()
    assert quality["quality_score"] > 100 and quality["distinct_match_rate_left"] == 96.2
    with pytest.raises(ValueError):
        J.smart_join(a, b, "k", "w")
    with pytest.raises(ValueError):
        J.smart_join(a, b, "k", "k", "cross")


def test_column_matching(spark):
    orders = spark.createDataFrame([(1, "C1", 5.0), (2, "C2", 6.0)], "Order_ID long, Customer_ID string, Amount double")
    customers = spark.createDataFrame([("c1 ", 9.0), ("C3", 8.0)], "customer id string, Credit double".replace("customer id", "`customer id`"))
    got = J.match_columns(orders, customers).collect()
    assert (got[0]["col1"], got[0]["col2"], got[0]["name_similarity"], got[0]["value_overlap"]) == ("Customer_ID", "customer id", 1.0, 0.5)
    mixed = spark.createDataFrame([(1.0, "2"), (2.0, "x")], "d double, s string")
    whole = spark.createDataFrame([(1,), (2,)], "n long")
    overlap = {r["col1"]: r["shared"] for r in J.value_overlap(mixed, whole).collect()}
    assert overlap == {"d": 2, "s": 1}
    wide = whole.select(*[(F.col("n") + i).alias(f"c{i}") for i in range(70)])
    many = {(r["col1"], r["col2"]): r["shared"] for r in J.value_overlap(wide, wide).collect()}
    assert len(many) == 4900 and many["c3", "c3"] == 2 and many["c3", "c4"] == 1 and many["c3", "c69"] == 0 and many["c69", "c68"] == 1


def test_profiles_of_edge_tables(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (1.0, None, "a"), (float("nan"), None, None)], "x double, e string, s string")
    row = P.profile_dataset(df).first()
    assert (row["rows"], row["total_missing"], row["total_duplicates"]) == (3, 5, 1)
    consts = {r["column"]: r["value"] for r in P.constant_columns(df.select("e", "s")).collect()}
    assert consts == {"e": "N/A", "s": "a"}
    text = {r["column"]: r for r in P.profile_categorical(df).collect()}
    assert text["e"]["count"] == 0 and text["e"]["most_common"] is None and text["s"]["most_common_pct"] == 100.0
    times = P.profile_datetime(spark.createDataFrame([(datetime(2024, 1, 1, 23),), (datetime(2024, 1, 3, 1),)], "d timestamp_ntz"))
    assert times.first()["date_range_days"] == 1


def test_expectations(spark):
    df = spark.createDataFrame([(1, "a")], "x int, s string")
    assert P.expectations(df, ["x"], ["x"], 1) is df
    for bad in (lambda: P.expect_table(None), lambda: P.expect_table(df.limit(0)), lambda: P.expect_columns(df, "y"),
                lambda: P.expect_numeric(df, "s"), lambda: P.expect_min_rows(df, 5), lambda: P.expect_table([1])):
        with pytest.raises(P.ExpectationError):
            bad()
    assert "missing" in P.error_result(lambda: P.expect_columns(df, "y"))()["error"]


def test_finance_edges(spark, rows):
    df = spark.createDataFrame([("a", 0.0, 5.0), ("a", 10.0, 5.0), ("b", 4.0, None), ("b", 4.0, 4.0)], "c string, b double, a double")
    detail = [(r["variance_pct"], r["status"]) for r in Fi.budget_detail(df, "b", "a").collect()]
    assert detail == [(None, "Over Budget"), (-50.0, "Under Budget"), (None, "On Target"), (0.0, "On Target")]
    assert Fi.budget_summary(df, "b", "a").first()["on_target_items"] == 1
    two = Fi.expense_summary(df, "b", "c").first()
    assert two["top_3_percentage"] == 100.0 and two["largest_category"] == "a"
    clean = spark.createDataFrame([("x", 100.0, 5.0)], "i string, amt double, tax double")
    assert rows(Fi.tax_findings(clean, "amt", "tax", "i")) == [("none", None, "positive", 0)]
    assert Fi.audit_summary(clean, "amt", "tax").first()["total_findings"] == 0
    ratios = Fi.financial_ratios(df.selectExpr("0.0D AS r", "a AS c"), "r", "c").first()
    assert ratios["gross_margin"] is None and ratios["total_revenue"] == 0.0
    kinds = spark.createDataFrame([("Sales", 5.0), ("rent", 2.0), (None, 1.0)], "t string, v double")
    row = Fi.income_expense(kinds, "v", "t").first()
    assert (row["total_income"], row["total_expenses"], row["savings_rate"]) == (5.0, 3.0, 40.0)


def test_compliance_finds_columns(spark):
    df = spark.createDataFrame([("pen", 0.05, " ", "2024-01-01", "1", 7.0), ("pen", 0.07, "T1", "bad", "2", 7.0), ("ink", 0.05, None, "2030-01-01", "3", None),
                                ("ink", 0.05, "T2", "2020-01-01", "50", None)], "Item string, Tax double, `Tax ID` string, Date string, `Invoice No` string, Amount double")
    row = Co.compliance_summary(df, datetime(2025, 1, 1)).first()
    assert (row["missing_tax_ids"], row["future_dated"], row["aged"], row["sequence_gaps"], row["duplicate_amount_rows"]) == (2, 1, 1, 1, 4)
    assert row["checks_with_issues"] == 3 and row["total_issues"] == 6 and row["overall_status"] == "Needs Review"
    assert Co.missing_tax_id(df.drop("Tax ID")) is None and Co.tax_consistency(df.drop("Item")) is None
    assert resolve_column(df, Co.TAX_ID_NAMES) == "Tax ID"


def test_sequence_gaps_edges(spark):
    two = spark.createDataFrame([(1,), (9,)], "n int")
    assert X.sequence_gaps(two, "n").count() == 0
    twins = spark.createDataFrame([("1",), ("1",), ("2",), ("x",), ("30",)], "n string")
    assert [tuple(r) for r in X.sequence_gaps(twins, "n").collect()] == [(2.0, 30.0, 28.0)]


def test_trend_and_pareto_edges(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0)], "t int, v double")
    assert X.trend(df, ["t"], "v").first()["direction"] == "Flat"
    assert X.trend(df.limit(2), ["t"], "v").count() == 0
    zero = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "g string, v double")
    assert X.pareto_summary(zero, "g", "v").count() == 0


def test_top_and_bottom_see_missing_values(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0)], "i int, v double")
    got = [(r["end"], r["i"]) for r in So.top_bottom_n(df, "v", 1, ["i"]).collect()]
    assert got == [("top", 1), ("bottom", 2)]


def test_charts_of_edge_tables(spark):
    same = spark.createDataFrame([(2.0,)] * 3, "x double")
    holes = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    assert [r["count"] for r in Ch.histogram(holes, "x", 2).orderBy("bin").collect()] == [1, 1]
    assert Ch.histogram(same, "x", 4).agg(F.sum("count")).first()[0] == 3
    assert Ch.histogram(same.limit(0), "x").count() == 0
    assert Ch.radar_profile(same).first()["scaled"] == 100.0


def test_kinds(spark):
    df = spark.createDataFrame([(1, True, "a", datetime(2024, 1, 1), 2.0)], "n int, b boolean, s string, d timestamp_ntz, Net_Profit double")
    assert columns_by_kind(df) == {"numeric": ["n", "Net_Profit"], "categorical": ["s"], "datetime": ["d"], "boolean": ["b"]}
    assert financial_columns(df) == ["Net_Profit"] and financial_columns(df.select("n")) == ["n"]


def test_csv_and_report(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c,d\n1,1.5,"x, y",True\n2,NA,"say ""hi""",False\n')
    source = files.scan(spark, str(tmp_path / "t.csv"))
    assert dict(source.table.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean"}
    assert [tuple(r) for r in source.table.collect()] == [(1, 1.5, "x, y", True), (2, None, 'say "hi"', False)]
    assert source.shape() == (2, 4) and source.name == "t.csv" and source.size_kb > 0
    with pytest.raises(ValueError):
        files.scan(spark, "t.xlsx")
    done = clean_table(source.table.select("a", "b", "c"), ["a"])
    written = report.report_sink(report.report_sections(done.table, ["a"], done.report), str(tmp_path / "out"))
    assert set(written) == {"cleaned_data", "column_totals", "dashboard", "statistics", "anomalies", "data_profile", "cleaning_report"}
    assert spark.read.parquet(written["data_profile"]).count() == 3
    report.report_sink({"totals": files.column_totals(done.table)}, str(tmp_path / "csv"), "csv")
    assert spark.read.csv(str(tmp_path / "csv" / "totals"), header=True).count() == 3


def test_flows(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}", float(i)) for i in range(40)], "id int, g string, v double")
    done = clean_table(df, ["id"])
    assert set(profile_flow(done.table)) == {"dataset", "columns", "constants", "high_cardinality"}
    assert analysis_flow(done.table, ["id"])["kpis"].count() == 2
    found, summary = insight_flow(done, ["id"])
    assert found.count() == summary.first()["total_insights"]
    joined, stats, quality = join_flow(df, df.limit(5), "id", "id")
    assert joined.count() == 40 and stats.count() == 1 and quality.first()["quality_label"] == "Poor Match"


def test_insights_of_a_small_table(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "i int, s string, v double")
    got = [(r["category"], r["severity"]) for r in insights(df, ["i"], 89.0, 2).collect()]
    assert got == [("Data Quality", "warning"), ("Data Quality", "info"), ("Low Variance", "info"), ("Correlation", "info"), ("Sample Size", "warning")]


def test_row_steps_run_on_a_stream(spark, tmp_path):
    """Cleaning and filters are per-row, and outlier flags with fixed bounds too."""
    from tabulith.operators.anomalies import Bounds, flag_anomalies
    src = str(tmp_path / "in")
    data = spark.createDataFrame([(i, "N/A" if i % 2 else " $1,000 ", float(i)) for i in range(20)], "i int, s string, v double")
    data.write.parquet(src)

    def steps(df):
        out = C.impute_categorical(C.trim_strings(C.null_markers(df)))
        out = S.filter_compare(S.calculated_column(out, "w", "v", "i", "add"), "v", ">", 3)
        return flag_anomalies(out, [Bounds("v", 0.0, 15.0, "Z-Score")])

    stream = steps(spark.readStream.schema(data.schema).parquet(src))
    q = (stream.writeStream.format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start())
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("steps").collect())) == sorted(map(tuple, steps(spark.read.parquet(src)).collect()))


def test_a_hot_key_on_the_optional_side_is_split(spark):
    from tabulith.operators import joins as J
    left = spark.createDataFrame([(1 if i % 3 == 0 else 1000 + i, i) for i in range(300)], "k long, a int")
    right = spark.createDataFrame([(1 if i % 3 == 0 else 1100 + i, i) for i in range(300)], "k long, b int")
    for how in ("left", "right", "outer"):
        auto = J.smart_join(left, right, "k", "k", how)
        plain = J.smart_join(left, right, "k", "k", how, split_sides=False)
        assert "LeftAnti" in auto._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" not in plain._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(auto.collect(), key=repr) == sorted(plain.collect(), key=repr)
    even = spark.range(300).withColumnRenamed("id", "k")
    assert "LeftAnti" not in J.smart_join(left, even, "k", "k")._jdf.queryExecution().optimizedPlan().toString()


def test_first_rows_of_any_number(spark):
    df = spark.createDataFrame([(g, i, (i * 7919) % 5003) for g in ("a", None, "c") for i in range(5000 if g == "a" else 10)], "g string, i int, o int")
    for n in (3, 2000):
        got = S_sorting.first_rows(df, ["o", "i"], n, ["g"]).collect()
        want = [r for g in ("a", None, "c") for r in sorted([r for r in df.collect() if r["g"] == g], key=lambda r: (r["o"], r["i"]))[:n]]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_written_tables_go(spark):
    import os
    from tabulith import session
    table = session.written_once(spark.range(10), "t")
    folder = session._scratch_root(spark)[0].toUri().getPath()
    assert table.count() == 10 and os.listdir(folder) and folder.startswith(session.shared_dir(spark).replace("file:", ""))
    session.discard_scratch(spark)
    assert not os.path.exists(folder)
    wide = spark.createDataFrame([("x" * 1000,)] * 50, "s string")
    assert 50_000 < session.table_bytes(wide) < 60_000


def test_duplicates_despite_clashing_fingerprints(spark, rows, monkeypatch):
    data = [(1, "a", None), (1, None, "a"), (1, "a", None), (2, "b", "b"), (2, "b", "b"), (2, "b", "b"), (3, None, None)]
    df = spark.createDataFrame(data, "k int, x string, y string")
    want = [(7, 3, 21, 5, 3)]
    shown = ("rows", "columns", "total_cells", "total_missing", "total_duplicates")
    assert rows(P.profile_dataset(df).select(*shown)) == want
    monkeypatch.setattr(P, "fingerprint", lambda columns: [F.lit(1), F.col("k") % 2])
    assert rows(P.profile_dataset(df).select(*shown)) == want
    empty = P.profile_dataset(df.limit(0)).first()
    assert (empty["rows"], empty["total_duplicates"], empty["total_missing"]) == (0, 0, 0)


def test_gate_counts_while_writing(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i) if i % 4 else None, "x") for i in range(20)], "id int, v double, s string")
    gate = P.Gate(["id"], ["v", "s"], 30, {"v over 2": F.col("v") > 2, "an id": F.col("id").isNotNull()}, "t")
    found = {(r["check"], r["subject"]): (r["passed"], r["message"]) for r in P.gated_write(df, str(tmp_path / "out"), gate).collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    assert found["rows", "t"] == found["column", "id"] == found["numeric", "v"] == found["rule", "an id"] == (True, None)
    assert found["min_rows", "30"] == (False, "t: 20 row(s), at least 30 needed") and not found["numeric", "s"][0]
    assert found["rule", "v over 2"] == (False, "t: 7 of 20 row(s) break 'v over 2'")
    with pytest.raises(P.ExpectationError):
        gate.check()
    with pytest.raises(P.ExpectationError):
        P.Gate(["nope"]).watch(df)
    clean = P.Gate(min_rows=1)
    clean.watch(df).write.format("noop").mode("overwrite").save()
    clean.check()


def test_columns_per_value_are_bounded(spark, monkeypatch):
    from tabulith.operators import selection
    monkeypatch.setattr(selection, "WIDEST", 3)
    df = spark.createDataFrame([(i, str(i), 1.0) for i in range(4)], "k int, c string, v double")
    with pytest.raises(ValueError, match="sparse=True"):
        selection.one_hot(df, "c")
    with pytest.raises(ValueError, match="long=True"):
        A.pivot_table(df, "k", "v", "sum", "c")
    assert selection.one_hot(df.where("k < 3"), "c").columns == ["k", "v", "c_0", "c_1", "c_2"]
    assert selection.one_hot(df, "c", sparse=True).count() == A.pivot_table(df, "k", "v", "sum", "c", long=True).count() == 4


def test_dates_are_filled_by_their_keys_alone(spark, rows):
    """Wide rows, repeated and null order keys, and two date columns with different gaps."""
    day = lambda d: datetime(2024, 1, d)
    data = [(1, day(1), None, "a"), (2, None, day(5), "b"), (None, None, None, "c"), (3, day(3), None, "d"), (3, day(3), None, "d"), (4, None, None, "e")]
    df = spark.createDataFrame(data, "k int, x timestamp, y timestamp, wide string").repartition(3)
    got = rows(C.impute_datetime(df, ["k"]).select("k", F.day("x").alias("x"), F.day("y").alias("y"), "wide"))
    want = [(None, 1, 5, "c"), (1, 1, 5, "a"), (2, 1, 5, "b"), (3, 3, 5, "d"), (3, 3, 5, "d"), (4, 3, 5, "e")]
    assert got == sorted(want, key=repr)
    full = df.where("k = 1").drop("y")
    assert C.impute_datetime(full, ["k"]) is full


def test_tables_without_rows(spark):
    """Counts taken on the way are zeros, not errors, where no row comes by."""
    for df in (spark.createDataFrame([], "k string, x double, d timestamp"),
               spark.range(5).selectExpr("cast(id AS string) AS k", "cast(id AS double) AS x", "current_timestamp() AS d").where("k = 'none'")):
        done = clean_table(df, ["k"])
        assert done.table.count() == 0 and done.duplicates_removed == 0
        assert done.report.where("metric = 'original_rows'").first()["value"] == "0"
        assert P.profile_dataset(df).first()["rows"] == 0
        assert A.group_agg(df, "k", "x", "median").count() == A.describe_numeric(df).count() == 0
        gate = P.Gate(["k"], ["x"], 1)
        gate.watch(df).write.format("noop").mode("overwrite").save()
        assert [r["passed"] for r in gate.report().orderBy("check").collect()] == [True, False, True, False]


def test_pairs_of_missing_keys_are_made_in_several_tasks(spark):
    left = spark.range(3100).selectExpr("if(id < 3000, null, id) AS k", "id AS a")
    right = spark.range(3050).selectExpr("if(id < 2000, null, id + 1050) AS k", "id AS b")
    for how, alone in (("inner", 0), ("left", 50), ("right", 1000), ("outer", 1050)):
        joined = J.smart_join(left, right, "k", "k", how, null_match=True)
        tasks = joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.expr("count_if(k IS NULL AND a IS NOT NULL AND b IS NOT NULL) AS pairs"),
                                                           F.expr("count_if(a IS NULL OR b IS NULL) AS alone")).collect()
        assert sum(t["pairs"] for t in tasks) == 3000 * 2000
        assert sum(t["alone"] for t in tasks) == alone
        assert max(t["pairs"] for t in tasks) <= 3000 * 2000 / 2, how


def test_pairs_of_missing_keys_take_little_disk(spark, tmp_path):
    left = spark.range(100).selectExpr("cast(null AS long) AS k", "id AS a")
    right = spark.range(20_000).selectExpr("cast(null AS long) AS k", "sha2(cast(id AS string), 256) AS name")
    path = tmp_path / "pairs"
    J.smart_join(left, right, "k", "k", "outer", null_match=True).write.parquet(str(path))
    found = spark.read.parquet(str(path))
    assert found.distinct().count() == found.count() == 100 * 20_000
    assert sum(f.stat().st_size for f in path.glob("*.parquet")) < 4 * 100 * 20_000  # a name has 64 bytes


def test_csv_kinds_of_odd_values_and_no_regular_expression_in_casts(spark, tmp_path):
    columns = {"whole": ["1", " -2", "+3\t"], "real": ["1e-5", ".5", "-Infinity"], "words": [" inf", "NaN1", "nAn"], "hexed": ["0x1p-3", "2.", "7"],
               "suffix": ["1.5d", "2", "3"], "day": ["1996-01-02", "1996-01-03", "1996-01-04"], "flag": ["N", "I", "F"], "yes": ["true", "FALSE", "True"],
               "far": ["99999999999999999999", "1", "2"], "signs": ["1-", "2", "3"], "infinite": ["inf", "+INF", "-infinity"], "minus": ["-", "1", "2"]}
    path = str(tmp_path / "odd.csv")
    with open(path, "w") as f:
        f.write("\n".join(",".join(row) for row in [list(columns), *zip(*columns.values())]) + "\n")
    out = files.scan_csv(spark, path).table
    kinds = dict(out.dtypes)
    assert {c for c, k in kinds.items() if k == "bigint"} == {"whole"}
    assert {c for c, k in kinds.items() if k == "double"} == {"real", "hexed", "far", "infinite"}
    assert {c for c, k in kinds.items() if k == "boolean"} == {"yes"}
    assert [r["whole"] for r in out.collect()] == [1, -2, 3]
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
