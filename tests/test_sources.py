import datetime
import math
import pathlib

import pytest
from pyspark.sql import functions as F

from factorloom import schema, session
from factorloom.plans import factors
from factorloom.sources import files, market
from factorloom.sources import sample_tables as st
from tests.conftest import TINY


def day(text):
    return datetime.date.fromisoformat(text)


def raw_prices(spark, dates, **values):
    base = dict(isin="A", conm="c", exchg="1", prcod=1.0, prchd=2.0, prcld=3.0, prccd=8.0,
                cshtrd=5.0, ajexdi=2.0, cshoc=10.0, div=None, prcstd="10", tpci="0", gind="i",
                gsubind="s") | values
    return spark.createDataFrame(
        [tuple(base.get(f.name, day(d)) for f in schema.RAW_PRICE.fields) for d in dates],
        schema.RAW_PRICE)


def test_price_dates_exclude_both_ends(spark):
    raw = raw_prices(spark, ["2000-01-01", "2000-01-02", "2000-01-03"])
    rows = market.scan_prices(raw, "2000-01-01", "2000-01-03").collect()
    assert [r.datadate for r in rows] == [day("2000-01-02")]
    assert (rows[0].adj_close_price, rows[0].adj_trading_volume,
            rows[0].market_capitalization, rows[0].trs_flag) == (4.0, 10.0, 80.0, 1)


def test_price_columns_and_missing_keys(spark):
    assert market.scan_prices(raw_prices(spark, ["2000-01-01"])).columns == schema.PRICE.names
    assert market.scan_prices(raw_prices(spark, ["2000-01-01"], isin=None)).count() == 0
    row = market.scan_prices(raw_prices(spark, ["2000-01-01"], ajexdi=0.0, prcstd=None)).first()
    assert row.adj_close_price is None and row.trs_flag == 0


def test_nan_in_a_source_is_missing(spark):
    row = market.scan_prices(raw_prices(spark, ["2000-01-01"], prccd=math.nan)).first()
    assert (row.close_price, row.adj_close_price, row.market_capitalization) == (None, None, None)


def test_first_statement_of_a_year_across_exchanges(spark):
    def row(exchg, year, date, at, **other):
        kind = dict(popsrc="I", datafmt="HIST_STD", consol="C") | other
        return ("A", exchg, year, day(date), at, 1.0, 1.0, 1.0, 1.0, *kind.values())
    raw = spark.createDataFrame(
        [row("1", 2000, "2000-01-01", 1.0), row("2", 2000, "2000-06-30", None),
         row("1", 2000, "2000-12-31", 3.0), row("1", 2001, "2001-12-31", 4.0),
         row("1", 2001, "2001-03-31", 5.0, consol="N"), row("1", 2002, "2002-01-01", 6.0)],
        schema.RAW_STATEMENT)
    rows = market.scan_statements(raw, "2000-01-01", "2001-12-31").orderBy("fyear").collect()
    assert [(r.fyear, r.exchg, r.assets) for r in rows] == [(2000, "2", None), (2001, "1", 4.0)]
    assert market.scan_statements(raw).columns == schema.STATEMENT.names
    assert [r.year for r in factors.quality(market.scan_statements(raw)).orderBy("year").collect()] \
        == [2002, 2003, 2004]


def test_nan_becomes_null_and_absent_columns_are_reported(spark):
    df = spark.createDataFrame([(1.0, "a"), (math.nan, "b"), (None, "c")], "x double, s string")
    assert [r.x for r in schema.nan_to_null(df).collect()] == [1.0, None, None]
    with pytest.raises(ValueError, match="y"):
        schema.conform(df, schema._struct("x:d y:d"))


def test_csv_is_matched_by_name(spark, tmp_path):
    (tmp_path / "wdi.csv").write_text('Region,Code,Value\n"Asia, East",VNM,1.5\nAfrica,KEN,..\n')
    df = files.read_csv(spark, str(tmp_path / "wdi.csv"), schema._struct("Code:s Region:s Value:d"))
    assert [tuple(r) for r in df.orderBy("Code").collect()] == [
        ("KEN", "Africa", None), ("VNM", "Asia, East", 1.5)]
    with pytest.raises(ValueError, match="Nope"):
        files.read_csv(spark, str(tmp_path / "wdi.csv"), schema._struct("Nope:s"))


def test_export_with_title_sections_and_footer(spark, tmp_path):
    (tmp_path / "hdi.csv").write_text(
        "Table 1,,\nrank,Country,Value\n,VERY HIGH,\n1,Switzerland,0.962\n 2 ,Norway,0.961\n"
        ",LOW,\n191,South Sudan,..\n,Notes,\n")
    df = files.read_export(spark, str(tmp_path / "hdi.csv"), ["rank", "country", "hdi"],
                           schema._struct("rank:i country:s hdi:d"), files.is_number("rank"))
    assert [tuple(r) for r in df.orderBy("rank").collect()] == [
        (1, "Switzerland", .962), (2, "Norway", .961), (191, "South Sudan", None)]


def test_code_pattern_predicate(spark):
    df = spark.createDataFrame([("KEN",), ("Country Code",), (None,)], "code string")
    assert df.filter(files.matches("code", "^[A-Z]{3}$")).count() == 1


def test_panel_is_written_by_year(spark, tmp_path):
    panel = spark.range(100).select(F.col("id").cast("string").alias("isin"),
                                    (F.col("id") % 2 + 2000).cast("int").alias("year"),
                                    F.col("id").cast("double").alias("v"))
    files.write_panel(panel, str(tmp_path / "panel"))
    back = files.read_parquet(spark, str(tmp_path / "panel"))
    assert back.filter("year = 2001").count() == 50
    assert {p.name for p in (tmp_path / "panel").glob("year=*")} == {"year=2000", "year=2001"}


def test_preview_is_ordered_and_limited(spark):
    rows = files.first_rows(spark.range(100).orderBy(F.desc("id")), ["id"], 5).collect()
    assert [r.id for r in rows] == [0, 1, 2, 3, 4]


def test_materialized_tables_go_to_the_configured_folder(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.shared_folder(spark) == folder
    df = session.materialize(spark.range(3).withColumn("x", F.lit(None).cast("double")), "three")
    assert df.count() == 3 and df.columns == ["id", "x"]
    assert len(list(pathlib.Path(folder).glob("three-*"))) == 1


def test_sample_sources_have_the_source_columns(spark):
    prices, statements = st.raw_prices(spark, TINY), st.raw_statements(spark, TINY)
    assert set(schema.RAW_PRICE.names) <= set(prices.columns)
    assert set(schema.RAW_STATEMENT.names) == set(statements.columns)
    schema.conform(prices, schema.RAW_PRICE)


def test_statements_are_unique_within_a_country(spark):
    rows = [("X", "106", 2010, "2010-06-30", 1.0), ("X", "251", 2010, "2010-12-31", 2.0),
            ("X", "252", 2010, "2010-11-30", 3.0), ("X", "999", 2010, "2010-01-31", 4.0)]
    columns = "isin string, exchg string, fyear int, datadate string, at double"
    raw = spark.createDataFrame(rows, columns).withColumns({
        "datadate": F.to_date("datadate"), "popsrc": F.lit("I"), "datafmt": F.lit("HIST_STD"),
        "consol": F.lit("C"), **{c: F.lit(1.0) for c in ("revt", "oiadp", "ebitda", "oancf")}})
    exchanges = market.exchange_table(spark, [
        ("106", "a", "Australia", "l"), ("251", "b", "Singapore", "l"), ("252", "c", "Singapore", "l")])
    scoped = market.scan_statements(raw, exchanges=exchanges)
    assert {(r.exchg, r.assets) for r in scoped.collect()} == {("106", 1.0), ("252", 3.0)}
    for country, assets in (("Australia", 1.0), ("Singapore", 3.0)):
        kept = market.in_country(scoped, exchanges, country).collect()
        alone = market.scan_statements(market.in_country(raw, exchanges, country)).collect()
        assert [r.assets for r in kept] == [r.assets for r in alone] == [assets]
    assert [r.assets for r in market.scan_statements(raw).collect()] == [4.0]


def test_rows_of_one_day_have_a_fixed_order(spark):
    rows = [("X", "1", "2001-01-02", float(k)) for k in range(50)]
    df = spark.createDataFrame(rows, "isin string, exchg string, datadate string, p double")
    df = df.withColumn("datadate", F.to_date("datadate"))
    from factorloom.operators import series
    picked = {series.month_anchor(df.repartition(k), "p").first().anchor_price for k in (1, 3, 7)}
    assert len(picked) == 1


def test_an_existing_panel_is_not_replaced_unasked(spark, tmp_path):
    panel = spark.range(100).withColumn("year", F.lit(2000))
    files.write_panel(panel, str(tmp_path / "panel"), rows_per_file=10)
    assert spark.read.parquet(str(tmp_path / "panel")).count() == 100
    with pytest.raises(Exception, match="exists"):
        files.write_panel(panel, str(tmp_path / "panel"))


def test_fields_of_another_type_are_counted(spark):
    text = spark.createDataFrame([("1", "a"), ("x", "b"), (" ", None), (None, "c")], "n string, s string")
    row = files.failed_casts(text, schema._struct("n:l s:s")).first()
    assert (row.n, row.s) == (1, 0)


class _Cluster:
    """A session's settings as a cluster has them."""

    def __init__(self, spark, folder, file_system="file:///"):
        self.conf, self.sparkContext, self.master, self._folder = self, self, "spark://host:7077", folder
        self._jsc, self._file_system = self, file_system

    def get(self, key, default=None):
        return {"spark.checkpoint.dir": self._folder, "fs.defaultFS": self._file_system}.get(key, default)

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None

    def hadoopConfiguration(self):
        return self


def test_a_cluster_needs_a_shared_folder(spark):
    for folder in (None, "/tmp/own"):
        with pytest.raises(RuntimeError):
            session.shared_folder(_Cluster(spark, folder))
    assert session.shared_folder(_Cluster(spark, "file:///mnt/shared")) == "file:///mnt/shared"
    assert session.shared_folder(_Cluster(spark, "/shared", "hdfs://name")) == "/shared"


def test_processes_of_one_machine_share_its_disk(spark):
    cluster = _Cluster(spark, "/tmp/checkpoints")
    cluster.master = "local-cluster[3,2,3000]"
    assert session.shared_folder(cluster) == "/tmp/checkpoints"
    cluster = _Cluster(spark, None)
    cluster.master = "local-cluster[3,2,3000]"
    with pytest.raises(RuntimeError):
        session.shared_folder(cluster)


def test_own_tables_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_WRITTEN", [])
    session.materialize(spark.range(3), "gone")
    folder = pathlib.Path(session.shared_folder(spark).removeprefix("file://"))
    assert len(list(folder.glob("gone-*"))) == 1
    assert session.drop_tables(spark) == 1 and not list(folder.glob("gone-*"))


@pytest.fixture
def other_cluster(spark, monkeypatch):
    """The session as on a cluster whose machines may or may not share a folder; nothing was tried yet."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_TRIED", {})
    monkeypatch.setattr(session, "_WRITTEN", [])
    monkeypatch.setattr(session, "_HELD", [])
    return spark


def test_a_plain_folder_that_a_cluster_shares_is_found_by_trying(other_cluster, monkeypatch):
    folder = other_cluster.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.shared_folder(other_cluster) == folder
    assert not list(pathlib.Path(folder).glob("seen-*"))
    assert session.materialize(other_cluster.range(3), "tried").count() == 3
    assert session.drop_tables(other_cluster) == 1
    tries = []
    monkeypatch.setattr(session, "_written_and_read", lambda *a: bool(tries.append(a)))
    assert session.shared_folder(other_cluster) == folder and not tries
    key = (other_cluster.sparkContext.applicationId, folder)
    session._TRIED[key] = frozenset(["another"]), True  # executors on a machine that was not there
    with pytest.raises(RuntimeError):
        session.shared_folder(other_cluster)
    assert len(tries) == 1


def test_a_folder_counts_as_shared_only_if_all_rows_come_back(spark, tmp_path):
    assert session._written_and_read(spark, f"{tmp_path}/all")
    (tmp_path / "file").write_text("")
    assert not session._written_and_read(spark, f"{tmp_path}/file/none")
    assert not list(tmp_path.glob("all*"))


def test_rows_are_held_where_machines_share_no_folder(other_cluster, monkeypatch, plan_text):
    monkeypatch.setattr(session, "_written_and_read", lambda *a: False)
    with pytest.raises(RuntimeError):
        session.shared_folder(other_cluster)
    day = F.date_add(F.lit("1582-10-01").cast("date"), F.col("id").cast("int"))
    df = other_cluster.range(30).select(
        F.col("id").alias("a.b"), F.expr("uuid()").alias("u"), day.alias("day"), F.lit(None).cast("double").alias("x"),
        F.array(F.struct(F.col("id").alias("n"))).alias("s"), F.expr("cast(X'ff41' AS string)").alias("bytes"))
    held = session.materialize(df, "held")
    assert held.columns == df.columns and held.dtypes == df.dtypes
    first, again = ({tuple(r) for r in held.select(F.expr("struct(*)").cast("string"), F.hex("bytes"), "day").collect()}
                    for _ in range(2))
    assert first == again and len(first) == 30  # the rows are computed once
    assert held.filter("hex(bytes) = 'FF41'").count() == 30
    assert {r.day for r in held.collect()} == {r.day for r in df.select("day").collect()}
    assert "InMemoryTableScan" in plan_text(held) and "Range" not in plan_text(held).split("InMemoryRelation")[0]
    assert "BroadcastHashJoin" in plan_text(other_cluster.range(9).join(held.select(F.col("`a.b`").alias("id")), "id"))
    assert session.drop_tables(other_cluster) == 1 and not held.storageLevel.useDisk


def test_operators_run_alike_where_machines_share_no_folder(other_cluster, monkeypatch):
    from factorloom.llm.frames import components, placed
    from factorloom.operators import ranks, series

    rows = other_cluster.range(200).select(
        F.lit("X").alias("isin"), (F.col("id") % 2).cast("string").alias("exchg"),
        F.date_add(F.lit("2001-01-01").cast("date"), F.col("id").cast("int")).alias("datadate"),
        (F.col("id") * 7 % 31 + 1.0).alias("adj_close_price"))
    links = other_cluster.range(1, 60).selectExpr("id AS a", "id DIV 3 * 2 AS b")
    trees = other_cluster.range(50).selectExpr("cast(id % 3 AS string) AS tree", "id * 7 % 50 AS leaf")

    def found():
        rank = ranks.spearman(rows.withColumn("y", F.dayofyear("datadate")), "adj_close_price", "y")
        return [sorted(map(tuple, df.collect())) for df in (
            series.daily_returns(rows, split_rows=20, chunk_rows=30), components(links, "a", "b"),
            placed(trees, "leaf"), rank.select("n", F.round("spearman", 9)))]

    written = found()
    monkeypatch.setattr(session, "_TRIED", {})
    monkeypatch.setattr(session, "_written_and_read", lambda *a: False)
    assert found() == written
    assert session._HELD
    session.drop_tables(other_cluster)
