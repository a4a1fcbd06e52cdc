"""One query per operator, over the whole sample tables.

The sample series have about seven rows a month, so queries that end in a
regression pass ``days_per_month=7``; the others use the library's 21.
Computed sums and means are rounded, because two engines add in different
orders; plain arithmetic is compared as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factorloom.functions.scalars import (bucket, capitalization, month_number, month_start,
                                          reporting_year, shift_months, split_adjusted_price,
                                          split_adjusted_volume)
from factorloom.operators import crosssec, groups, ranks, reconcile, regression, selection, series
from factorloom.plans import analysis, development, factors, growing_panel, report
from factorloom.schema import (HDI_CUTS, HDI_LEVELS, PPP_CUTS, PPP_GROUPS, QUALITY, TARGET, VALUE,
                               _struct, factor_columns, growth_columns, liquidity_columns,
                               momentum_columns, volatility_columns)
from factorloom.session import materialize, shared_folder
from factorloom.sources import files, market, store
from factorloom.sources import sample_tables as st

ORDER = st.PRICE_ORDER
YEARS = st.PPP_SAMPLE_YEARS
SPARSE = 7
# Averages of amounts in cents often lie exactly between two roundings, where
# the last bit decides.  Both engines add this before rounding.
OFF_GRID = 0.0000137


def r(column, digits: int = 6):
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def rounded(df, columns, digits: int = 6):
    return df.withColumns({c: r(c, digits) for c in columns})


def rounded_amounts(df, columns):
    return df.withColumns({c: r(F.col(c) + F.lit(OFF_GRID), 3) for c in columns})


def prices(spark, sf):
    return market.scan_prices(st.raw_prices(spark, sf), keep=st.TIES)


def long_prices(spark, sf):
    return market.scan_prices(st.long_prices(st.raw_prices(spark, sf)), keep=st.TIES)


def statements(spark, sf):
    return market.scan_statements(st.raw_statements(spark, sf))


# --- sources and scalars -----------------------------------------------------

def scan_price_panel(spark, sf):
    return market.scan_prices(st.raw_prices(spark, sf, industry=True),
                              "1995-01-02", "2001-11-04")


def scan_fundamentals_first(spark, sf):
    scanned = market.scan_statements(st.raw_statements(spark, sf), "1995-01-01", "2001-12-31")
    return rounded(scanned, QUALITY)


def scan_skip_preamble(spark, sf):
    customer = st.table(spark, sf, "customer")
    data = customer.select(F.col("c_custkey").cast("string").alias("rank"),
                           F.col("c_name").alias("country"),
                           F.concat(F.lit(" "), F.col("c_acctbal").cast("string")).alias("value"))
    sections = customer.select("c_mktsegment").distinct().select(
        F.lit(None).cast("string").alias("rank"), F.col("c_mktsegment").alias("country"),
        F.lit(None).cast("string").alias("value"))
    title = spark.range(1).select(F.lit("Table 1.").alias("rank"), F.lit("Index").alias("country"),
                                  F.lit("Value").alias("value"))
    return files.data_rows(title.unionByName(sections).unionByName(data),
                           _struct("rank:l country:s value:d"), files.is_number("rank"))


def exchange_map(spark, sf):
    """Nations with their exchange, from literal rows in which a code is repeated."""
    nations = st.table(spark, sf, "nation").select(
        "n_name", F.col("n_regionkey").cast("string").alias("exchg"))
    return nations.join(st.exchanges(spark, sf), "exchg")


def statements_by_country(spark, sf):
    """Securities on exchanges of two countries keep a statement in each."""
    raw = st.listed_twice(st.raw_statements(spark, sf))
    return rounded(market.scan_statements(raw, exchanges=st.exchanges(spark, sf)), QUALITY)


def _shared_path(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_export_file(spark, sf):
    """A spreadsheet export with title, sections and footer, written and read again."""
    customer, path = st.table(spark, sf, "customer"), _shared_path(spark, "export")
    lines = customer.select(F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name",
                                        F.concat(F.lit(" "), F.col("c_acctbal").cast("string"))))
    sections = customer.select(F.concat(F.lit(","), F.col("c_mktsegment"), F.lit(","))).distinct()
    frame = spark.createDataFrame([("Table 1. Index,,",), ("Rank,Country,Value",), ("Notes,,",)], "value string")
    frame.union(sections).union(lines).write.text(path)
    return files.read_export(spark, path, ["rank", "country", "value"],
                             _struct("rank:l country:s value:d"), files.is_number("rank"))


def read_csv_file(spark, sf):
    path = _shared_path(spark, "csv")
    st.table(spark, sf, "customer").write.option("header", True).csv(path)
    return files.read_csv(spark, path, _struct("c_custkey:l c_mktsegment:s c_acctbal:d"))


def write_panel_readback(spark, sf):
    path = _shared_path(spark, "panel")
    rows = st.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey",
                                                "o_totalprice")
    files.write_panel(rows, path, rows_per_file=1000)
    return spark.read.parquet(path).select("year", "o_orderkey", "o_totalprice")


def replace_years_readback(spark, sf):
    """A panel of which two years are written again with other figures, twice."""
    path = _shared_path(spark, "panel")
    rows = st.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey",
                                                "o_totalprice")
    files.write_panel(rows, path)
    later = rows.filter("year IN (1996, 1997)").withColumn("o_totalprice", F.col("o_totalprice") + 1.0)
    for _ in range(2):
        files.replace_partitions(later, path)
    return spark.read.parquet(path).select("year", "o_orderkey", "o_totalprice")


def _export_lines(spark, sf):
    """Customers as text, some with fields that are missing or not of their type, and sections."""
    customer = st.table(spark, sf, "customer")
    key = F.col("c_custkey")
    data = customer.select(
        F.when(key % 11 != 0, key.cast("string")).alias("rank"),
        F.when(key % 13 != 0, F.col("c_name")).otherwise(F.lit(" ")).alias("country"),
        F.when(key % 7 == 0, F.lit("n/a")).when(key % 17 != 0, F.col("c_acctbal").cast("string")).alias("value"))
    sections = customer.select("c_mktsegment").distinct().select(
        F.lit("Section").alias("rank"), F.col("c_mktsegment").alias("country"),
        F.lit(None).cast("string").alias("value"))
    return data.unionByName(sections)


def _quarantined(spark, sf):
    return files.quarantined(_export_lines(spark, sf), _struct("rank:l country:s value:d"),
                             F.col("rank").isNull() | files.is_number("rank"), ["rank", "country"])


def export_accepted(spark, sf):
    return _quarantined(spark, sf)[0]


def export_rejected(spark, sf):
    return _quarantined(spark, sf)[1].select(
        "reason", *[F.coalesce(F.get("fields", F.lit(k)), F.lit("-")).alias(c)
                    for k, c in enumerate(("rank", "country", "value"))])


def preview_first_n(spark, sf):
    return files.first_rows(st.table(spark, sf, "customer").select("c_custkey", "c_name"),
                            ["c_custkey"])


def sample_n(spark, sf):
    return files.sample_rows(st.table(spark, sf, "customer").select("c_custkey", "c_name"), 10,
                             "c_custkey", seed=7)


def price_semi_country(spark, sf):
    scoped = market.in_country(prices(spark, sf), st.exchanges(spark, sf), "Developing")
    return scoped.select("exchg", "isin", "datadate", *st.TIES, "close_price")


def scalar_adjusted_prices(spark, sf):
    raw = st.raw_prices(spark, sf)
    return raw.select("isin", "datadate", *st.TIES,
                      split_adjusted_price("prccd", "ajexdi").alias("adj_close_price"),
                      split_adjusted_volume("cshtrd", "ajexdi").alias("adj_trading_volume"),
                      capitalization("prccd", "cshoc").alias("market_capitalization"))


def scalar_calendar(spark, sf):
    day = F.to_date("o_orderdate")
    return st.table(spark, sf, "orders").select(
        "o_orderkey", F.year(day).alias("year"), F.month(day).alias("month"),
        month_number(day).alias("month_no"), month_start(day).alias("month_start"),
        *[shift_months(month_start(day), k).alias(f"plus_{k}m") for k in (1, 6, 12, 24, 36)],
        shift_months(month_start(day), -12).alias("minus_12m"),
        reporting_year(F.year(day)).alias("reporting_year"))


# --- series ------------------------------------------------------------------

def january_snapshot(spark, sf):
    return series.january_snapshot(prices(spark, sf), ["close_price", "adj_close_price",
                                                       "trading_volume"], ORDER)


def month_anchor(spark, sf):
    return series.month_anchor(prices(spark, sf), order=ORDER)


def horizon_anchor_dates(spark, sf):
    found = series.horizon_lookup(series.month_anchor(prices(spark, sf), order=ORDER))
    return found.select("exchg", "isin", "anchor_date",
                        *[f"bf_{k}m" for k in (1, 6, 12, 24, 36)], "aft_12m")


def daily_returns(spark, sf):
    return rounded(series.daily_returns(prices(spark, sf), order=ORDER)
                   .select("exchg", "isin", "datadate", *st.TIES, "daily_return"),
                   ["daily_return"], 9)


def rolling_volatility(spark, sf):
    return rounded(series.rolling_volatility(long_prices(spark, sf), order=ORDER)
                   .select("exchg", "isin", "datadate", *st.TIES, *volatility_columns()),
                   volatility_columns())


def rolling_liquidity(spark, sf):
    return rounded_amounts(series.rolling_liquidity(long_prices(spark, sf), order=ORDER)
                           .select("exchg", "isin", "datadate", *st.TIES, *liquidity_columns()),
                           liquidity_columns())


# --- factor families ---------------------------------------------------------

def factor_size(spark, sf):
    return factors.size(prices(spark, sf), ORDER)


def factor_yield(spark, sf):
    return factors.dividend_yield(prices(spark, sf), ORDER)


def factor_quality(spark, sf):
    return rounded(factors.quality(statements(spark, sf)), QUALITY)


def factor_value(spark, sf):
    return rounded(factors.value(factors.quality(statements(spark, sf)),
                                 factors.size(prices(spark, sf), ORDER)), VALUE, 4)


def factor_momentum(spark, sf):
    return rounded(factors.momentum(prices(spark, sf), ORDER), [*momentum_columns(), TARGET], 9)


def factor_volatility(spark, sf):
    return rounded(factors.volatility(long_prices(spark, sf), ORDER), volatility_columns())


def factor_liquidity(spark, sf):
    return rounded_amounts(factors.liquidity(long_prices(spark, sf), ORDER), liquidity_columns())


def factor_growth(spark, sf):
    return rounded(factors.growth(factors.quality(statements(spark, sf))), growth_columns())


def _store(spark, sf):
    return store.DailyStore.create(prices(spark, sf), f"daily_{uuid.uuid4().hex}", _shared_path(spark, "store"))


def store_factor_panel(spark, sf):
    """The panel from a table of daily prices in buckets: no daily row is moved."""
    daily = _store(spark, sf)
    return _rounded_panel(factors.factor_panel(daily.prices(), statements(spark, sf), order=ORDER,
                                               days_per_month=SPARSE, sizes=daily.series()))


def grown_factor_panel(spark, sf):
    """The panel of three loads, the later ones computed from the state before and their own rows."""
    rows, cuts = prices(spark, sf), [F.lit(d).cast("date") for d in ("1997-06-15", "1998-01-12")]
    day = F.col("datadate")
    state = growing_panel.begin(rows.filter(day < cuts[0]), ORDER, days_per_month=SPARSE)
    for low, high in ((cuts[0], cuts[1]), (cuts[1], F.lit("9999-12-31").cast("date"))):
        state = growing_panel.extend(state, rows.filter((day >= low) & (day < high)))
    return _rounded_panel(factors.with_statements(state.panel(), statements(spark, sf)))


def store_country_prices(spark, sf):
    """Prices of a country from the table; only the folders of its exchanges are read."""
    known = store.store_exchanges(st.exchanges(spark, sf), _shared_path(spark, "exchanges"))
    scoped = market.in_country(_store(spark, sf).prices(), known, "Developing")
    return scoped.select("exchg", "isin", "datadate", *st.TIES, "close_price")


def store_series(spark, sf):
    """The series of a table that was loaded in two parts."""
    rows = prices(spark, sf)
    early = F.col("datadate") < F.lit("1997-07-01").cast("date")
    daily = store.DailyStore.create(rows.filter(early), f"daily_{uuid.uuid4().hex}", _shared_path(spark, "store"), 8)
    daily.append(rows.filter(~early))
    return daily.series()


def _rounded_panel(df):
    df = rounded_amounts(rounded(df, VALUE, 4), liquidity_columns())
    return rounded(df, [*QUALITY, *volatility_columns(), *growth_columns(), *momentum_columns(),
                        TARGET])


def merge_factor_panel(spark, sf):
    p, q = prices(spark, sf), factors.quality(statements(spark, sf))
    size = factors.size(p, ORDER)
    merged = factors.merge_families([
        size, q, factors.value(q, size), factors.dividend_yield(p, ORDER),
        factors.volatility(p, ORDER, days_per_month=SPARSE),
        factors.liquidity(p, ORDER, days_per_month=SPARSE),
        factors.growth(q), factors.momentum(p, ORDER)])
    return _rounded_panel(merged)


def factor_panel_one_pass(spark, sf):
    """The same panel as merge_factor_panel, computed in one pass over the prices."""
    return _rounded_panel(factors.factor_panel(prices(spark, sf), statements(spark, sf),
                                               order=ORDER, days_per_month=SPARSE))


def factor_panel_split(spark, sf):
    """The same panel with every series cut into ranges."""
    return _rounded_panel(factors.factor_panel(prices(spark, sf), statements(spark, sf), order=ORDER,
                                               days_per_month=SPARSE, split_rows=100, chunk_rows=150))


# --- cross-section and models ------------------------------------------------

def _panel(spark, sf, days=SPARSE):
    # Read twice (group summaries, scores), hence written once.
    return materialize(factors.factor_panel(prices(spark, sf), statements(spark, sf), order=ORDER,
                                            days_per_month=days), "panel")


def normalize_cross_section(spark, sf):
    columns = [*factor_columns(), TARGET]
    return rounded(crosssec.normalize_cross_section(_panel(spark, sf), columns), columns)


def null_ratio_columns(spark, sf):
    panel = _panel(spark, sf, 21).join(st.exchanges(spark, sf).select("exchg", "country"), "exchg")
    scored = crosssec.normalize_cross_section(panel, [*factor_columns(), TARGET])
    ratios = crosssec.null_ratios(scored, factor_columns(), ("country",))
    return rounded(ratios, ["null_ratio"]).withColumn("kept", F.col("null_ratio") < 0.2)


def quartiles_by_exchange_year(spark, sf):
    """Quartiles of all factors and the target in each exchange and year, in one go."""
    found = selection.group_quantiles(_panel(spark, sf), ["exchg", "year"], [*factor_columns(), TARGET], few=4)
    cuts = {f"q{25 * (k + 1)}": r(F.get("quantiles", F.lit(k)) + F.lit(OFF_GRID), 3) for k in range(3)}
    return found.select("exchg", "year", "column", "n", *[c.alias(name) for name, c in cuts.items()])


def spearman_by_country(spark, sf):
    """Rank correlation of every factor with the next year's return, in each country."""
    panel = _panel(spark, sf).join(st.exchanges(spark, sf).select("exchg", "country"), "exchg")
    return rounded(selection.spearman_matrix(panel, ["country"], factor_columns(), TARGET), ["spearman"], 9)


def dropna_complete_rows(spark, sf):
    return rounded(crosssec.complete_rows(st.ppp(spark, sf)), [str(y) for y in YEARS], 4)


def linear_fit(spark, sf):
    fit = regression.linear_fit(st.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(rounded(fit, ["slope", "intercept"], 4), ["x_min", "x_max"])


def fit_line_points(spark, sf):
    fit = regression.linear_fit(st.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(regression.fit_line_points(fit), ["x", "y"], 4)


def spearman_rank(spark, sf):
    return rounded(ranks.spearman(st.table(spark, sf, "lineitem"), "l_quantity",
                                  "l_extendedprice"), ["spearman"], 9)


def _design(spark, sf):
    return analysis.regression_design(prices(spark, sf), statements(spark, sf),
                                      st.exchanges(spark, sf), order=ORDER, days_per_month=SPARSE)


def gram_sums(spark, sf):
    design = _design(spark, sf)
    sums = regression.gram_sums(design.rows, [*design.factors, TARGET], "country")
    return rounded(sums, ["total"])


def _rounded_fit(fit):
    return rounded(rounded(fit, ["beta"], 5), ["pvalue"])


def ols_grouped(spark, sf):
    design = _design(spark, sf)
    return _rounded_fit(regression.ols_grouped(design.scored, design.factors, TARGET,
                                               "country", kept=design.kept))


def ols_grouped_dropped(spark, sf):
    """A fit in which the rule for mostly missing factors drops one."""
    return _rounded_fit(analysis.analyze_countries(
        prices(spark, sf), statements(spark, sf), st.exchanges(spark, sf), order=ORDER,
        days_per_month=10))


# --- groups and reconciliation -----------------------------------------------

def rowwise_mean(spark, sf):
    return rounded(development.average_ppp(st.ppp(spark, sf), YEARS)
                   .select("country_code", "average_ppp"), ["average_ppp"], 4)


def ppp_outer_complete(spark, sf):
    complete = development.complete_ppp(st.ppp(spark, sf), st.ppp_metadata(spark, sf), YEARS)
    return rounded(complete, ["average_ppp", *[str(y) for y in YEARS]], 4)


def _development(spark, sf):
    return development.development_groups(st.ppp(spark, sf), st.ppp_metadata(spark, sf), YEARS,
                                          cuts=None)


def bucket_quartiles(spark, sf):
    return _development(spark, sf).select("country_code", "development_group")


def bucket_fixed_thresholds(spark, sf):
    return st.table(spark, sf, "orders").select(
        "o_orderkey", bucket("o_totalprice", PPP_CUTS, PPP_GROUPS).alias("development_group"))


def bucket_index_levels(spark, sf):
    return st.development_index(spark, sf).select(
        "country", bucket("hdi", HDI_CUTS, HDI_LEVELS, missing="LOW").alias("hdi_group"))


def group_boundary_member(spark, sf):
    return rounded(groups.boundary_members(_development(spark, sf), "development_group",
                                           "average_ppp", "country_name"), ["average_ppp"], 4)


def crosstab_groups(spark, sf):
    return groups.crosstab(_development(spark, sf), "development_group", "income_group",
                           PPP_GROUPS)


def crosstab_groups_wide(spark, sf):
    return groups.crosstab_wide(_development(spark, sf), "development_group", "income_group",
                                ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


def ranked_averages(spark, sf):
    complete = development.complete_ppp(st.ppp(spark, sf), st.ppp_metadata(spark, sf), YEARS)
    return rounded(groups.ranked(complete, "average_ppp", "country_code")
                   .select("country_name", "average_ppp"), ["average_ppp"], 4)


def filter_group_members(spark, sf):
    return groups.group_members(_development(spark, sf), "development_group",
                                "Low Development").select("country_name")


def _labelled_documents(spark, sf):
    return reconcile.left_lookup(
        st.table(spark, sf, "documents").select("doc_id", "lang", "source"),
        st.table(spark, sf, "labels"), "doc_id", "doc_id", ["quality"])


def left_join_lookup(spark, sf):
    return _labelled_documents(spark, sf)


def unmatched_keys(spark, sf):
    return reconcile.unmatched_keys(
        st.table(spark, sf, "documents").select("doc_id", "lang", "source"),
        st.table(spark, sf, "labels"), "doc_id", "doc_id")


def repair_keys(spark, sf):
    overrides = (st.table(spark, sf, "documents").filter(F.col("lang") == "fr")
                 .select("doc_id", F.lit(1).alias("override_code")))
    return reconcile.repair_keys(_labelled_documents(spark, sf), overrides, "doc_id", "quality")


def propose_repairs(spark, sf):
    """Codes for misspelt names of parts, by the nearest known name."""
    part = st.table(spark, sf, "part")
    name = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    known = part.groupBy(name.alias("known")).agg(F.min("p_partkey").alias("code"))
    key = F.col("p_partkey")
    misspelt = F.when(key % 3 == 0, F.concat(F.substring(name, 1, 2), F.substring(name, 4, 90))).when(
        key % 3 == 1, F.concat(F.lit("x"), F.upper(name))).otherwise(F.concat(F.substring(name, 1, 5), F.lit(", the q"),
                                                                             F.substring(name, 6, 90)))
    wanted = part.filter(key % 20 < 2).select(misspelt.alias("country"))
    return reconcile.propose_repairs(wanted, known, "country", "known", "code")


def rejoin_after_repair(spark, sf):
    metadata = st.country_metadata(spark, sf)
    coded = reconcile.left_lookup(
        st.development_index(spark, sf).select("country"), metadata, "country", "table_name",
        ["country_code", "region", "income_group"])
    fixed = reconcile.repair_keys(coded, st.code_overrides(spark, sf), "country", "country_code")
    return reconcile.rejoin_after_repair(fixed, metadata, "country_code",
                                         ["region", "income_group"])


def distinct_groups(spark, sf):
    return groups.distinct_labels(st.ppp_metadata(spark, sf), "region", "income_group")


def rank_difference(spark, sf):
    return development.rank_difference(st.development_index(spark, sf)).select(
        "country", "hdi_rank", "gni_rank_minus_hdi_rank")


def group_mean_abs(spark, sf):
    table = development.index_levels(development.rank_difference(st.development_index(spark, sf)))
    return rounded(groups.mean_abs(table, "hdi_group", "gni_rank_minus_hdi_rank"), ["mean_abs"])


def label_countries(spark, sf):
    listing = (st.table(spark, sf, "supplier")
               .join(st.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
               .select("s_suppkey", F.initcap(F.translate("n_name", "_", " ")).alias("country")))
    named = (st.table(spark, sf, "nation")
             .join(st.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .select("n_name", F.col("r_name").alias("label")))
    return reconcile.label_countries(listing, named, "country", "n_name", ["label"])


def development_groups(spark, sf):
    return rounded(_development(spark, sf), ["average_ppp", *[str(y) for y in YEARS]], 4)


def _hdi(spark, sf):
    return development.hdi_groups(st.development_index(spark, sf),
                                  st.country_metadata(spark, sf), st.code_overrides(spark, sf))


def hdi_groups(spark, sf):
    return rounded(_hdi(spark, sf).select("country", "hdi", "hdi_group", "country_code", "region",
                                          "income_group"), ["hdi"], 9)


def chart_feed_map(spark, sf):
    return rounded(development.map_feed(_hdi(spark, sf), "country_code", "hdi", "country"),
                   ["value"], 9)


def chart_feed_scatter(spark, sf):
    return rounded(development.scatter_feed(_hdi(spark, sf), "gni_per_capita", "hdi", "region"),
                   ["y"], 9)


def rows_without_group(spark, sf):
    return _hdi(spark, sf).filter(F.col("income_group").isNull()).select("country", "country_code")


def spearman_index_difference(spark, sf):
    table = development.rank_difference(st.development_index(spark, sf))
    return rounded(ranks.spearman(table, "hdi", "gni_rank_minus_hdi_rank"), ["spearman"], 9)


# --- reports -----------------------------------------------------------------

def _results(spark, sf, country=None):
    return analysis.analyze_countries(prices(spark, sf), st.raw_statements(spark, sf),
                                      st.exchanges(spark, sf), country, order=ORDER,
                                      days_per_month=SPARSE)


def _significant(spark, sf):
    return report.significant_factors(_results(spark, sf), st.exchanges(spark, sf))


def significant_factors(spark, sf):
    return _rounded_fit(_significant(spark, sf))


def sig_count_by_label(spark, sf):
    return report.count_by_label(_significant(spark, sf))


def sig_avg_by_label(spark, sf):
    return rounded(report.average_by_label(_significant(spark, sf)), ["per_country"])


def fill_missing_groups(spark, sf):
    strict = report.significant_factors(_results(spark, sf), st.exchanges(spark, sf), 0.0005)
    return _rounded_fit(report.fill_missing_groups(strict))


def beta_matrix(spark, sf):
    names = ["Developed", "Developing"]
    return rounded(report.beta_matrix(_significant(spark, sf), names), names, 5)


def analyze_one_country(spark, sf):
    return _rounded_fit(_results(spark, sf, "Developed"))


def analyze_all_countries(spark, sf):
    return _rounded_fit(_results(spark, sf))


def analyze_dual_listed(spark, sf):
    """Countries with securities that are listed in two of them, from the source's rows."""
    quotes = market.scan_prices(st.quoted_twice(st.raw_prices(spark, sf)), keep=st.TIES)
    return _rounded_fit(analysis.analyze_countries(
        quotes, st.listed_twice(st.raw_statements(spark, sf)), st.exchanges(spark, sf), order=ORDER,
        days_per_month=SPARSE))


QUERIES = {f.__name__: f for f in (
    store_factor_panel, grown_factor_panel, store_country_prices, store_series, replace_years_readback, export_accepted,
    export_rejected, propose_repairs, quartiles_by_exchange_year, spearman_by_country, analyze_dual_listed,
    scan_price_panel, scan_fundamentals_first, scan_skip_preamble, statements_by_country,
    read_export_file, read_csv_file, write_panel_readback, exchange_map, preview_first_n,
    sample_n, price_semi_country, scalar_adjusted_prices, scalar_calendar, january_snapshot,
    month_anchor, horizon_anchor_dates, daily_returns, rolling_volatility, rolling_liquidity,
    factor_size, factor_yield, factor_quality, factor_value, factor_momentum, factor_volatility,
    factor_liquidity, factor_growth, merge_factor_panel, factor_panel_one_pass,
    factor_panel_split, ols_grouped_dropped, normalize_cross_section, null_ratio_columns, dropna_complete_rows, linear_fit,
    fit_line_points, spearman_rank, gram_sums, ols_grouped, rowwise_mean, ppp_outer_complete,
    bucket_quartiles, bucket_fixed_thresholds, bucket_index_levels, group_boundary_member,
    crosstab_groups, crosstab_groups_wide, ranked_averages, filter_group_members,
    left_join_lookup, unmatched_keys, repair_keys, rejoin_after_repair, distinct_groups,
    rank_difference, group_mean_abs, label_countries, development_groups, hdi_groups,
    chart_feed_map, chart_feed_scatter, rows_without_group, spearman_index_difference,
    significant_factors, sig_count_by_label, sig_avg_by_label,
    fill_missing_groups, beta_matrix, analyze_one_country, analyze_all_countries)}
