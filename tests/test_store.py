"""Layouts and orders: what a store, a packed order and the scoped analysis spare."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks import queries
from factorloom.operators import hot_series, series
from factorloom.operators.packed_order import Field, PackedOrder, date_field
from factorloom.plans import analysis, factors
from factorloom.sources import files, market, store
from factorloom.sources import sample_tables as st
from tests.conftest import TINY


@pytest.fixture(scope="module")
def daily(spark, tmp_path_factory):
    rows = market.scan_prices(st.raw_prices(spark, TINY), keep=st.TIES)
    return store.DailyStore.create(rows, "daily_shapes", str(tmp_path_factory.mktemp("store")), 8)


def test_a_panel_from_a_store_moves_no_daily_row(spark, daily, plan_text):
    text = plan_text(factors.price_panel(daily.prices(), order=st.PRICE_ORDER, sizes=daily.series()))
    assert "Exchange" not in text and "SortAggregate" not in text
    assert "Bucketed: true" in text
    plain = spark.table(daily.table).repartition(5)
    assert "Exchange" in plan_text(factors.price_panel(plain, order=st.PRICE_ORDER, split_rows=None))


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setJobGroup("other", "other")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_planning_a_panel_from_a_store_reads_no_prices(spark, daily, monkeypatch):
    """Whether a series is split is decided from the table of series alone."""
    sizes, asked = daily.series(), []
    monkeypatch.setattr(hot_series, "materialize",
                        lambda df, name="step": asked.append(df.inputFiles()) or df)
    factors.price_panel(daily.prices(), order=st.PRICE_ORDER, sizes=sizes)
    assert len(asked) == 1 and all("/series/" in f for f in asked[0])


def test_a_store_with_an_oversized_series_gives_the_same_panel(spark, daily):
    options = {"order": st.PRICE_ORDER, "months": (1, 3), "days_per_month": 7, "back": (1,)}
    whole = factors.price_panel(daily.prices(), **options, sizes=daily.series())
    cut = factors.price_panel(daily.prices(), **options, sizes=daily.series(), split_rows=100, chunk_rows=70)
    keys = ["exchg", "isin", "year"]
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (whole, cut))
    assert len(a) == len(b) > 0
    for c in a.columns:
        assert (a[c].isna() == b[c].isna()).all()
        if c not in keys:
            assert ((a[c] - b[c]).abs() <= 1e-9 * a[c].abs().clip(lower=1e-9)).where(a[c].notna(), True).all(), c


def files_read(df) -> int:
    df.collect()
    found = []

    def walk(plan):
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(plan.executedPlan())
        if name.endswith("QueryStage"):
            return walk(plan.plan())
        if name.startswith("Scan parquet") and "daily_shapes" in plan.toString():
            found.append(plan.metrics().apply("numFiles").value())
        children = plan.children()
        for k in range(children.size()):
            walk(children.apply(k))
    walk(df._jdf.queryExecution().executedPlan())
    return sum(found)


def test_a_country_filter_prunes_files_at_run_time(spark, daily, plan_text, tmp_path):
    known = store.store_exchanges(st.exchanges(spark, TINY), str(tmp_path / "exchanges"))
    scoped = market.in_country(daily.prices(), known, "Developed")
    assert "dynamicpruningexpression" in plan_text(scoped)
    every = daily.prices()
    assert 0 < files_read(scoped) < files_read(every)
    expected = every.where("exchg IN ('1', '3')").count()
    assert scoped.count() == expected > 0


def test_loads_add_up(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a", "2000-01-03", 1.0), ("1", "a", "2000-01-04", 2.0), ("2", "a", "2000-01-03", 3.0),
                                  (None, "a", "2000-01-03", 4.0), ("1", None, "2000-01-03", 5.0)],
                                 "exchg string, isin string, day string, x double").withColumn("datadate", F.to_date("day"))
    made = store.DailyStore.create(rows.where("x < 2.5 OR x > 3.5"), "daily_loads", str(tmp_path / "s"), 3)
    assert made.buckets == 3
    made.append(rows.where("x > 2.5"))
    again = store.DailyStore.open(spark, "daily_loads", str(tmp_path / "s"))
    assert sorted((r.exchg, r.isin, r.n_rows, str(r.last_day)) for r in again.series().collect()) == [
        ("1", "a", 2, "2000-01-04"), ("2", "a", 1, "2000-01-03")]
    assert again.prices("2000-01-03").count() == 1 and again.prices(end="2000-01-04").count() == 2


# --- packed orders ---------------------------------------------------------------

ORDER = PackedOrder(date_field("d"), Field("a", 39, low=-5), Field("b", 6), Field("c", 20, per_unit=100))


def test_anchors_in_an_order_of_five_columns_are_combined_by_hash(spark, plan_text):
    for name in ("factor_momentum", "month_anchor", "january_snapshot", "factor_size"):
        text = plan_text(queries.QUERIES[name](spark, TINY))
        assert "HashAggregate" in text and "SortAggregate" not in text, name
    assert len(st.PRICE_ORDER) == 5 and st.PRICE_ORDER[0] == "datadate"


def test_packed_keys_sort_like_their_columns(spark):
    days = [None, "0001-01-01", "1969-12-31", "1970-01-01", "9999-12-31"]
    rows = [(d, a, b, c) for d in days for a in (None, -5, 0, 2 ** 39 - 8) for b in (None, 0, 62)
            for c in (None, 0.0, 0.01, 1234.56)]
    df = spark.createDataFrame(rows, "d string, a long, b int, c double").withColumn("d", F.to_date("d")).repartition(7)
    packed = df.withColumn("key", ORDER.key(df)).orderBy("key").select("d", "a", "b", "c").collect()
    plain = df.orderBy("d", "a", "b", "c").collect()
    assert [tuple(r) for r in packed] == [tuple(r) for r in plain]
    assert df.select(ORDER.key(df).alias("k")).distinct().count() == len(rows)
    one = PackedOrder(date_field("d"), Field("b", 6))
    assert dict(df.select(one.key(df).alias("k")).dtypes)["k"] == "bigint"


@pytest.mark.parametrize("row", [("2000-01-01", -6, 1, 1.0), ("2000-01-01", 1, 63, 1.0), ("2000-01-01", 1, 1, 0.005)])
def test_values_that_break_the_promise_end_the_query(spark, row):
    df = spark.createDataFrame([row], "d string, a long, b int, c double").withColumn("d", F.to_date("d"))
    with pytest.raises(PySparkException, match="does not fit|no multiple"):
        df.select(ORDER.key(df)).collect()


def test_widths_are_limited():
    with pytest.raises(ValueError):
        PackedOrder(Field("a", 63), Field("b", 63), Field("c", 1))
    with pytest.raises(ValueError):
        PackedOrder(Field("a", 64))


def test_a_packed_order_gives_the_anchors_of_a_struct(spark):
    rows = market.scan_prices(st.raw_prices(spark, TINY), keep=st.TIES)
    key = ["exchg", "isin", "month_no"]
    packed = series.month_anchor(rows, order=st.PRICE_ORDER).orderBy(*key).collect()
    assert packed == series.month_anchor(rows, order=tuple(st.PRICE_ORDER)).orderBy(*key).collect()


# --- scope, quarantine, replaced partitions --------------------------------------

def test_statements_are_scoped_by_the_analysis(spark):
    raw, exchanges = st.listed_twice(st.raw_statements(spark, TINY)), st.exchanges(spark, TINY)
    chosen = exchanges.select("exchg", "country").distinct()
    scoped = analysis.scoped_statements(raw, chosen)
    twice = scoped.join(chosen, "exchg").groupBy("isin", "fyear").agg(F.count_distinct("country").alias("n"))
    assert twice.where("n = 2").count() > 0
    scanned = market.scan_statements(raw, exchanges=exchanges)
    assert analysis.scoped_statements(scanned, chosen).count() == scanned.count() == scoped.count()


def test_rejected_rows_carry_their_reason(spark, tmp_path):
    lines = ["Title", "1,Kenya,2.5", "2,,3.5", "x,Chad,1", "3,Mali,abc", "4,Togo,1,2,3", "5,Ghana,", "Notes,,"]
    (tmp_path / "export.csv").write_text("\n".join(lines) + "\n")
    text = files.read_export_lines(spark, str(tmp_path / "export.csv"), ["rank", "country", "value"])
    schema = "rank long, country string, value double"
    from pyspark.sql import types as T
    layout = T.StructType.fromDDL(schema)
    good, rejected = files.quarantined(text, layout, files.is_number("rank"), ["country"])
    assert sorted(map(tuple, good.collect())) == [(1, "Kenya", 2.5), (5, "Ghana", None)]
    reasons = {r.fields[0] if r.fields[0] else r.fields[-1]: r.reason for r in rejected.collect()}
    assert reasons["2"] == "country is missing" and reasons["3"] == "value is no double"
    assert reasons["x"] == "no data row" and "broken line" in reasons.values()
    assert good.count() + rejected.count() == len(lines)


def test_replacing_a_year_leaves_the_others_untouched(spark, tmp_path):
    path = str(tmp_path / "panel")
    rows = spark.range(3000).select((F.col("id") % 3 + 2000).cast("int").alias("year"), F.lit(7).alias("same"))
    files.write_panel(rows, path, rows_per_file=400)
    # Equal rows are divided among files as well.
    assert all(n <= 400 for n in [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()])

    def of_year(year):
        return {str(p) for p in (tmp_path / "panel" / f"year={year}").glob("*.parquet")}
    before = {y: of_year(y) for y in (2000, 2001, 2002)}
    for _ in range(2):
        files.replace_partitions(rows.where("year = 2001").limit(10), path)
        assert of_year(2000) == before[2000] and of_year(2002) == before[2002] and not of_year(2001) & before[2001]
        assert {r.year: r["count"] for r in spark.read.parquet(path).groupBy("year").count().collect()} == {
            2000: 1000, 2001: 10, 2002: 1000}
    assert not re.search("staging", " ".join(p.name for p in (tmp_path / "panel").iterdir()))
