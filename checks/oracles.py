"""The same results in plain SQL, written independently of the Spark plans.

Momentum uses self-joins, rolling figures use sliding frames, z-scores use
windows, and the regression is an orthogonalization of the columns (recursive
query) with a numerically integrated t distribution.
"""

from __future__ import annotations

QUALITY = ["assets", "revenue", "operating_income", "earnings_before_interest", "cash_flow"]
VALUE = {"pbr": "assets", "psr": "revenue", "por": "operating_income",
         "per": "earnings_before_interest", "pcr": "cash_flow"}
ROLLING = [1, 3, 6, 12, 24, 36]
BACK = [1, 6, 12, 24, 36]
YEARS = list(range(1995, 2002))
VOL = [f"daily_vol_{m}m" for m in ROLLING]
LIQ = [f"avg_transaction_amount_{m}m" for m in ROLLING]
MOM = [f"momentum_{m}m" for m in BACK]
YOY = [f"{c}_yoy" for c in QUALITY]
FACTORS = ["market_capitalization", *QUALITY, *VALUE, "dividend_per_share", *VOL, *LIQ, *YOY, *MOM]
TARGET = "return_1y_later"
TIES = "k_order, k_line, k_part"
GROUPS = ["Low Development", "Middle Low Development", "Middle High Development",
          "High Development"]


def r(expr: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({expr}, {digits}) + 0.0::double AS {name or expr}"


def amount(name: str) -> str:
    return f"round({name} + 0.0000137::double, 3) + 0.0::double AS {name}"


def listed(items) -> str:
    return ", ".join(items)


LISTING = """listing AS (
  SELECT s_suppkey, s_name AS conm, CAST(n_regionkey AS VARCHAR) AS exchg
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

PRICE = LISTING + """, price AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS isin, CAST(l_shipdate AS DATE) AS datadate, conm, exchg,
    l_extendedprice * (1::double - l_discount / 2::double) AS open_price,
    l_extendedprice * (1::double + l_tax) AS high_price,
    l_extendedprice * (1::double - l_discount) AS low_price,
    l_extendedprice AS close_price, l_quantity AS trading_volume,
    CAST(l_linenumber AS DOUBLE) AS ajexdi,
    l_extendedprice / CAST(l_linenumber AS DOUBLE) AS adj_close_price,
    l_quantity * CAST(l_linenumber AS DOUBLE) AS adj_trading_volume,
    l_quantity * 1000::double AS num_of_listed_stocks,
    l_extendedprice * (l_quantity * 1000::double) AS market_capitalization,
    l_tax AS dividend_per_share, l_returnflag, l_linestatus, l_partkey,
    l_orderkey AS k_order, l_linenumber AS k_line, l_partkey AS k_part,
    CAST(year(l_shipdate) AS INTEGER) AS year, month(l_shipdate) AS month,
    CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS month_no,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_shipdate AS DATE), l_orderkey,
                       l_linenumber, l_partkey, l_extendedprice) AS pos
  FROM lineitem JOIN listing ON l_suppkey = s_suppkey)"""

# Four suppliers of an exchange as one security: series longer than the longest frame.
LONG = (PRICE.replace("CAST(l_suppkey AS VARCHAR) AS isin", "CAST(l_suppkey // 4 AS VARCHAR) AS isin")
        .replace("conm, exchg,\n", "conm, CAST(l_suppkey // 4 % 5 AS VARCHAR) AS exchg,\n")
        .replace("PARTITION BY l_suppkey", "PARTITION BY l_suppkey // 4"))

STATEMENT_ROWS = """raw_statement AS (
  SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS fyear, quarter(l_shipdate) AS quarter,
    CASE WHEN l_linestatus = 'O' THEN 'I' ELSE 'D' END AS popsrc,
    CASE WHEN l_returnflag = 'R' THEN 'SUMM_STD' ELSE 'HIST_STD' END AS datafmt,
    max(CAST(l_shipdate AS DATE)) AS datadate, sum(l_extendedprice) AS assets,
    sum(l_extendedprice * (1::double - l_discount)) AS revenue,
    sum(l_extendedprice * (1::double - l_discount) * (1::double - l_tax)) AS operating_income,
    sum(l_extendedprice * (1::double - l_tax)) AS earnings_before_interest,
    sum(l_quantity * l_extendedprice / 100::double) AS cash_flow
  FROM lineitem GROUP BY ALL)"""


def statement(where: str = "true") -> str:
    return STATEMENT_ROWS + f""", statement AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT CAST(l_suppkey AS VARCHAR) AS isin, exchg, fyear, datadate, {listed(QUALITY)},
      row_number() OVER (PARTITION BY l_suppkey, fyear ORDER BY datadate) AS rn
    FROM raw_statement JOIN listing ON l_suppkey = s_suppkey
    WHERE popsrc = 'I' AND datafmt = 'HIST_STD' AND {where}) WHERE rn = 1)"""


QUALITY_CTE = f"""quality AS (
  SELECT exchg, isin, fyear + 2 AS year, datadate, {listed(QUALITY)} FROM statement)"""


def snapshot(source: str, columns) -> str:
    firsts = listed(f"min_by({c}, pos) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in columns)
    return f"""SELECT exchg, isin, year, min(datadate) AS datadate, {firsts}
  FROM {source} WHERE month = 1 GROUP BY exchg, isin, year"""


RETURNS = """returns AS (
  SELECT *, filled / nullif(lag(filled) OVER (PARTITION BY exchg, isin ORDER BY pos), 0)
    - 1::double AS daily_return
  FROM (SELECT *, last_value(adj_close_price IGNORE NULLS) OVER (
          PARTITION BY exchg, isin ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM price))"""


def vol_rolled(days: int = 21) -> str:
    made = listed(f"""CASE WHEN count(daily_return) OVER w{m} = {days * m + 1}
      THEN stddev_samp(daily_return) OVER w{m} END AS daily_vol_{m}m""" for m in ROLLING)
    frames = listed(f"""w{m} AS (PARTITION BY exchg, isin ORDER BY pos
      ROWS BETWEEN {days * m} PRECEDING AND CURRENT ROW)""" for m in ROLLING)
    return f"vol_rolled AS (SELECT *, {made} FROM returns WINDOW {frames})"


def liq_rolled(days: int = 21) -> str:
    made = listed(f"avg(adj_close_price * adj_trading_volume) OVER w{m} "
                  f"AS avg_transaction_amount_{m}m" for m in ROLLING)
    frames = listed(f"""w{m} AS (PARTITION BY exchg, isin ORDER BY pos
      ROWS BETWEEN {days * m} PRECEDING AND CURRENT ROW)""" for m in ROLLING)
    return f"liq_rolled AS (SELECT *, {made} FROM price WINDOW {frames})"


ANCHOR = """anchor AS MATERIALIZED (
  SELECT exchg, isin, month_no, min(datadate) AS anchor_date,
    min_by(adj_close_price, pos) AS anchor_price
  FROM price GROUP BY exchg, isin, month_no)"""


def _horizon() -> str:
    steps = [(f"bf_{k}m", -k) for k in BACK] + [("aft_12m", 12)]
    joins = " ".join(f"JOIN anchor {n} ON {n}.exchg = a.exchg AND {n}.isin = a.isin "
                     f"AND {n}.month_no = a.month_no + ({k})" for n, k in steps)
    taken = listed(f"{n}.anchor_date AS {n}, {n}.anchor_price AS {n}_price" for n, _ in steps)
    return f"""horizon AS (SELECT a.exchg, a.isin, a.month_no, a.anchor_date, a.anchor_price,
  {taken} FROM anchor a {joins} WHERE a.month_no % 12 = 0)"""


HORIZON = _horizon()
MOMENTUM = f"""momentum AS (SELECT exchg, isin, CAST(year(anchor_date) AS INTEGER) AS year,
  anchor_date AS datadate,
  {listed(f"(anchor_price - bf_{k}m_price) / nullif(bf_{k}m_price, 0) AS momentum_{k}m"
          for k in BACK)},
  (aft_12m_price - anchor_price) / nullif(anchor_price, 0) AS return_1y_later FROM horizon)"""

SIZE = f"size AS ({snapshot('price', ['market_capitalization'])})"
YIELD = f"dividend AS ({snapshot('price', ['dividend_per_share'])})"
RATIOS = listed(f"market_capitalization / nullif({d}, 0) AS {n}" for n, d in VALUE.items())
VALUES = f"""value AS (SELECT q.exchg, q.isin, q.year, s.datadate, {RATIOS}
  FROM quality q JOIN size s ON q.exchg = s.exchg AND q.isin = s.isin AND q.year = s.year)"""
GROWTH = f"""growth AS (SELECT exchg, isin, year, datadate,
  {listed(f"f_{c} / nullif(lag(f_{c}) OVER (PARTITION BY exchg, isin ORDER BY year), 0) - 1::double "
          f"AS {c}_yoy" for c in QUALITY)}
  FROM (SELECT *, {listed(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY exchg, isin "
                          f"ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
                          f"AS f_{c}" for c in QUALITY)} FROM quality))"""


def panel(days: int) -> str:
    keys = "USING (exchg, isin, year)"
    return ",\n".join([
        PRICE, statement(), QUALITY_CTE, RETURNS, vol_rolled(days), liq_rolled(days), ANCHOR,
        HORIZON, MOMENTUM, SIZE, YIELD, VALUES, GROWTH,
        f"volatility AS ({snapshot('vol_rolled', VOL)})",
        f"liquidity AS ({snapshot('liq_rolled', LIQ)})",
        f"""panel AS MATERIALIZED (SELECT exchg, isin, year, {listed(FACTORS)}, {TARGET}
  FROM size JOIN quality {keys} JOIN value {keys} JOIN dividend {keys} JOIN volatility {keys}
  JOIN liquidity {keys} JOIN growth {keys} JOIN momentum {keys})"""])


def panel_columns() -> str:
    exact = ["market_capitalization", "dividend_per_share"]
    plain = [c for c in [*FACTORS, TARGET] if c not in {*exact, *VALUE, *LIQ}]
    return listed(["exchg, isin, year", *exact, *[r(c, 4) for c in VALUE],
                   *[amount(c) for c in LIQ], *[r(c) for c in plain]])


EXCHANGE = """exchange AS (
  SELECT CAST(r_regionkey AS VARCHAR) AS exchg, r_name AS exchange_name,
    CASE WHEN r_regionkey IN (0, 2, 4) THEN 'Developing' ELSE 'Developed' END AS country,
    CASE WHEN r_regionkey IN (0, 2, 4) THEN 'Developing Country' ELSE 'Developed Country' END
      AS label
  FROM region)"""

SCORED = f"""scored AS MATERIALIZED (SELECT exchg, isin, year, {listed(
    f"({c} - avg({c}) OVER g) / nullif(stddev_samp({c}) OVER g, 0) AS {c}"
    for c in [*FACTORS, TARGET])}
  FROM panel WINDOW g AS (PARTITION BY exchg, year))"""

# Complete rows of the kept factors, one list per row.
def design(factors) -> str:
    return f"""complete AS (SELECT country, {listed(factors)}, {TARGET}
  FROM scored JOIN exchange USING (exchg)
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in [*factors, TARGET])}),
columns_of AS (SELECT country, count(*) AS n,
  [{listed(f"list({c} ORDER BY {', '.join([TARGET, *factors[:6]])})" for c in [*factors, TARGET])}]
    AS m FROM complete GROUP BY country)"""


DESIGN, K = design(FACTORS), len(FACTORS)


# Modified Gram-Schmidt: column k+1 is normalized and projected out of those after it.
# Its row of the triangular factor is appended to `tri`.
def ortho(factors) -> str:
    K = len(factors)
    return f"""ortho AS (
  SELECT country, n, 0 AS k, m, CAST([] AS DOUBLE[][]) AS tri FROM columns_of
  UNION ALL
  SELECT country, n, k + 1,
    list_transform(m, lambda c, i: CASE WHEN i <= k + 1 THEN c ELSE
      list_transform(c, lambda x, j: x - m[k+1][j] * dots[i] / dots[k+1]) END),
    list_append(tri, list_transform(dots, lambda d, i:
      CASE WHEN i < k + 1 THEN 0::double ELSE d / sqrt(dots[k+1]) END))
  FROM (SELECT *, list_transform(m, lambda c: list_inner_product(c, m[k+1])) AS dots
        FROM ortho WHERE k < {K})),
solved AS (
  SELECT country, n, 0 AS k, list_inner_product(m[{K + 1}], m[{K + 1}]) AS rss,
    list_transform(tri, lambda row, i: list_concat(row, list_transform(range(1, {K + 1}),
      lambda j: CASE WHEN j = i THEN 1::double ELSE 0::double END))) AS a
  FROM ortho WHERE k = {K}
  UNION ALL
  SELECT country, n, k + 1, rss, list_transform(a, lambda row, i:
    CASE WHEN i = {K} - k THEN list_transform(row, lambda x: x / a[{K} - k][{K} - k])
    ELSE list_transform(row, lambda x, j: x - row[{K} - k] * a[{K} - k][j] / a[{K} - k][{K} - k])
    END)
  FROM solved WHERE k < {K}),
names AS (SELECT unnest([{listed(f"'{c}'" for c in factors)}]) AS factor,
  unnest(range(1, {K + 1})) AS i),
estimate AS (SELECT country, factor, n, a[i][{K + 1}] AS beta,
  a[i][{K + 1}] / sqrt(rss / (n - {K}) * list_inner_product(a[i][{K + 2}:], a[i][{K + 2}:])) AS t
  FROM solved, names WHERE k = {K}),
fit AS MATERIALIZED (SELECT country, factor, beta,
  1::double - 2::double * exp(lgamma((nu + 1) / 2) - lgamma(nu / 2)) / sqrt(nu * pi())
    * list_sum(list_transform(range(0, 4001), lambda s:
        CASE WHEN s = 0 OR s = 4000 THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END
        * pow(1::double + pow(abs(t) * s / 4000::double, 2) / nu, -(nu + 1) / 2)))
    * abs(t) / 12000::double AS pvalue,
  n AS n_obs, CAST(n - {K} AS BIGINT) AS df_resid, CAST({K} AS BIGINT) AS rank
  FROM (SELECT *, CAST(n - {K} AS DOUBLE) AS nu FROM estimate))"""

def fitted(days: int, factors) -> str:
    return "WITH RECURSIVE " + ",\n".join([panel(days), EXCHANGE, SCORED, design(factors), ortho(factors)])


FIT = fitted(7, FACTORS)
# At ten days a month the longest volatility is missing in most rows, and goes.
SHORTER = [c for c in FACTORS if c != "daily_vol_36m"]
FIT_COLUMNS = f"country, factor, {r('beta', 5)}, {r('pvalue')}, n_obs, df_resid, rank"


# Every third security is also on the next exchange, where its statements come 40 days later.
LISTED_TWICE = """twice AS (
  SELECT s_suppkey, s_name, n_regionkey AS region, 0 AS later
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT s_suppkey, s_name, (n_regionkey + 1) % 5, 40
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 = 0),
listing AS (
  SELECT s_suppkey, s_name AS conm, CAST(region AS VARCHAR) AS exchg, later, region IN (0, 2, 4) AS developing
  FROM twice)"""
DUAL = FIT.replace(LISTING, LISTED_TWICE).replace(
    "PARTITION BY l_suppkey, fyear ORDER BY datadate", "PARTITION BY l_suppkey, developing, fyear ORDER BY datadate + later")
SERIES = """SELECT exchg, isin, count(*) AS n_rows, min(datadate) AS first_day, max(datadate) AS last_day
FROM price GROUP BY exchg, isin"""
EXPORT = """lines AS (
  SELECT CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS rank,
    CASE WHEN c_custkey % 13 <> 0 THEN c_name ELSE ' ' END AS country,
    CASE WHEN c_custkey % 7 = 0 THEN 'n/a' WHEN c_custkey % 17 <> 0 THEN CAST(c_acctbal AS VARCHAR) END AS value,
    c_acctbal FROM customer
  UNION ALL SELECT DISTINCT 'Section', c_mktsegment, NULL, NULL FROM customer),
judged AS (SELECT *, CASE WHEN rank = 'Section' THEN 'no data row' WHEN rank IS NULL THEN 'rank is missing'
    WHEN country = ' ' THEN 'country is missing' WHEN value = 'n/a' THEN 'value is no double' END AS reason FROM lines)"""
LONG_PANEL = f"""long AS (SELECT * FROM (UNPIVOT (SELECT exchg, year, {TARGET}, {listed(
    f"CAST({c} AS DOUBLE) AS {c}" for c in FACTORS)} FROM panel) ON {listed(FACTORS)} INTO NAME "column" VALUE value))"""


def significant(level: float) -> str:
    return f"""significant AS (SELECT c.country, f.factor, f.beta, f.pvalue, c.label
  FROM (SELECT DISTINCT country, label FROM exchange) c
  LEFT JOIN (SELECT * FROM fit WHERE pvalue <= {level}) f ON c.country = f.country)"""


# --- countries ---------------------------------------------------------------

PPP = f"""ppp AS (
  SELECT CAST(c_custkey AS VARCHAR) AS country_code, c_name AS country_name,
    {listed(f'''sum(o_totalprice) FILTER (WHERE year(o_orderdate) = {y}) AS "{y}"'''
            for y in YEARS)}
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name)"""
PPP_MEAN = f"""averaged AS (SELECT *, list_avg([{listed(f'"{y}"' for y in YEARS)}])
  AS average_ppp FROM ppp)"""
META = """metadata AS (
  SELECT CAST(c_custkey AS VARCHAR) AS country_code, r_name AS region,
    c_mktsegment AS income_group
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""
COMPLETE = f"""complete AS (SELECT a.*, region, income_group
  FROM averaged a JOIN metadata USING (country_code)
  WHERE {" AND ".join(f'"{y}" IS NOT NULL' for y in YEARS)})"""
GROUPED = f"""grouped AS (SELECT c.*, CASE WHEN average_ppp >= q[3] THEN '{GROUPS[3]}'
    WHEN average_ppp >= q[2] THEN '{GROUPS[2]}' WHEN average_ppp >= q[1] THEN '{GROUPS[1]}'
    ELSE '{GROUPS[0]}' END AS development_group
  FROM complete c, (SELECT quantile_cont(average_ppp, [0.25, 0.5, 0.75]) AS q FROM complete))"""
DEVELOPMENT = "WITH " + ", ".join([PPP, PPP_MEAN, META, COMPLETE, GROUPED])
PPP_ROUNDED = listed(r(f'"{y}"', 4) for y in YEARS)

INDEX = """idx AS (
  SELECT c_custkey, c_name AS country, (c_acctbal + 1000::double) / 11000::double AS hdi,
    gni_per_capita
  FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS gni_per_capita
                           FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey),
leveled AS (SELECT *, CASE WHEN hdi >= 0.8::double THEN 'VERY HIGH'
    WHEN hdi >= 0.7::double AND hdi < 0.8::double THEN 'HIGH'
    WHEN hdi >= 0.55::double AND hdi < 0.7::double THEN 'MEDIUM' ELSE 'LOW' END AS hdi_group
  FROM idx)"""
RANKED = """hdi_places AS (SELECT c_custkey, rank() OVER (ORDER BY hdi DESC) AS hdi_rank FROM idx
  WHERE hdi IS NOT NULL),
gni_places AS (SELECT c_custkey, rank() OVER (ORDER BY gni_per_capita DESC) AS gni_rank FROM idx
  WHERE gni_per_capita IS NOT NULL),
differed AS (SELECT country, hdi_group, hdi_rank, gni_rank - hdi_rank AS gni_rank_minus_hdi_rank
  FROM leveled LEFT JOIN hdi_places USING (c_custkey) LEFT JOIN gni_places USING (c_custkey))"""
WDI = """wdi AS (
  SELECT 'C' || c_custkey AS country_code, c_name, n_name, r_name AS region,
    CASE WHEN r_name = 'ASIA' THEN c_name || ', Rep.' ELSE c_name END AS table_name,
    c_mktsegment AS income_group
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
coded AS (SELECT l.country, l.hdi, l.hdi_group, coalesce(w.country_code, o.country_code)
    AS country_code
  FROM leveled l LEFT JOIN wdi w ON l.country = w.table_name
  LEFT JOIN (SELECT c_name, country_code FROM wdi WHERE region = 'ASIA' AND n_name <> 'NATION_2') o
    ON l.country = o.c_name),
rejoined AS (SELECT c.*, region, income_group FROM coded c LEFT JOIN wdi USING (country_code))"""

RANK_PAIRS = """pairs AS (SELECT
    rank() OVER (ORDER BY l_quantity)
      + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2::double AS rx,
    rank() OVER (ORDER BY l_extendedprice)
      + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2::double AS ry
  FROM lineitem)"""
LINE = """line AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope,
    regr_intercept(l_extendedprice, l_quantity) AS intercept,
    min(l_quantity) AS x_min, max(l_quantity) AS x_max FROM lineitem)"""
DOCS = """labelled AS (SELECT d.doc_id, d.lang, d.source, l.quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
MONTHS = listed(f"CAST(date_trunc('month', o_orderdate) + INTERVAL {k} MONTH AS DATE) AS plus_{k}m"
                for k in BACK)

ORACLES = {
    "store_factor_panel": f"WITH {panel(7)} SELECT {panel_columns()} FROM panel",
    "grown_factor_panel": f"WITH {panel(7)} SELECT {panel_columns()} FROM panel",
    "store_country_prices": f"""WITH {PRICE}, {EXCHANGE}
SELECT exchg, isin, datadate, {TIES}, close_price FROM price
WHERE exchg IN (SELECT exchg FROM exchange WHERE country = 'Developing')""",
    "store_series": f"WITH {PRICE} {SERIES}",
    "replace_years_readback": """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey,
  CASE WHEN year(o_orderdate) IN (1996, 1997) THEN o_totalprice + 1::double ELSE o_totalprice END AS o_totalprice
  FROM orders""",
    "propose_repairs": """WITH named AS (SELECT p_partkey AS k, concat_ws(' ', p_name, p_type, p_brand) AS n FROM part),
known AS (SELECT n AS known, min(k) AS code, regexp_replace(lower(n), '[^A-Za-z0-9]', '', 'g') AS b FROM named GROUP BY n),
wanted AS (SELECT DISTINCT CASE WHEN k % 3 = 0 THEN n[1:2] || n[4:] WHEN k % 3 = 1 THEN 'x' || upper(n)
    ELSE n[1:5] || ', the q' || n[6:] END AS country FROM named WHERE k % 20 < 2),
cleaned AS (SELECT country, regexp_replace(lower(country), '[^A-Za-z0-9]', '', 'g') AS a FROM wanted),
compared AS (SELECT country, known, code, CAST(levenshtein(a, b) AS INTEGER) AS distance, greatest(length(a), length(b)) AS n
  FROM cleaned, known),
near_names AS (SELECT *, min(distance) OVER (PARTITION BY country) AS least FROM compared WHERE distance <= n * 0.2::double)
SELECT country, known AS proposed_name, code, distance FROM near_names WHERE distance = least""",
    "export_accepted": f"""WITH {EXPORT} SELECT CAST(rank AS BIGINT) AS rank, country,
  CASE WHEN value IS NOT NULL THEN c_acctbal END AS value FROM judged WHERE reason IS NULL""",
    "export_rejected": f"""WITH {EXPORT} SELECT reason, coalesce(rank, '-') AS rank, country,
  coalesce(value, '-') AS value FROM judged WHERE reason IS NOT NULL""",
    "quartiles_by_exchange_year": f"""WITH {panel(7)}, long AS (SELECT * FROM (UNPIVOT (SELECT exchg, year, {listed(
        f"CAST({c} AS DOUBLE) AS {c}" for c in [*FACTORS, TARGET])} FROM panel)
  ON {listed([*FACTORS, TARGET])} INTO NAME "column" VALUE value))
SELECT exchg, year, "column", count(*) AS n, {listed(
    f"round(quantile_cont(value, {q}) + 0.0000137::double, 3) + 0.0::double AS q{int(100 * q)}"
    for q in (0.25, 0.5, 0.75))} FROM long GROUP BY exchg, year, "column\"""",
    "spearman_by_country": f"""WITH {panel(7)}, {EXCHANGE}, {LONG_PANEL},
pairs AS (SELECT country, "column", value AS x, {TARGET} AS y FROM long JOIN exchange USING (exchg)
  WHERE {TARGET} IS NOT NULL),
ranked AS (SELECT country, "column",
    rank() OVER (PARTITION BY country, "column" ORDER BY x)
      + (count(*) OVER (PARTITION BY country, "column", x) - 1) / 2::double AS rx,
    rank() OVER (PARTITION BY country, "column" ORDER BY y)
      + (count(*) OVER (PARTITION BY country, "column", y) - 1) / 2::double AS ry FROM pairs)
SELECT country, "column", count(*) AS n, {r('corr(rx, ry)', 9, 'spearman')} FROM ranked GROUP BY country, "column\"""",
    "analyze_dual_listed": f"{DUAL} SELECT {FIT_COLUMNS} FROM fit",
    "scan_price_panel": f"""WITH {PRICE}
SELECT isin, datadate, conm, exchg, open_price, high_price, low_price, close_price,
  trading_volume, open_price / ajexdi AS adj_open_price, high_price / ajexdi AS adj_high_price,
  low_price / ajexdi AS adj_low_price, adj_close_price, adj_trading_volume,
  num_of_listed_stocks, market_capitalization, dividend_per_share,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS trs_flag, l_linestatus AS stock_gb,
  p_type AS gic_industry, p_brand AS gic_sub_industry
FROM price JOIN part ON l_partkey = p_partkey
WHERE datadate > DATE '1995-01-02' AND datadate < DATE '2001-11-04'""",
    "scan_fundamentals_first": f"""WITH {LISTING}, {statement(
        "datadate > DATE '1995-01-01' AND datadate <= DATE '2001-12-31'")}
SELECT isin, exchg, fyear, datadate, {listed(r(c) for c in QUALITY)} FROM statement""",
    "statements_by_country": f"""WITH {LISTING}, {STATEMENT_ROWS}, {EXCHANGE}, listed_twice AS (
  SELECT s_suppkey, exchg, 0 AS later FROM listing UNION ALL
  SELECT s_suppkey, CAST((CAST(exchg AS INTEGER) + 1) % 5 AS VARCHAR), 40 FROM listing
  WHERE s_suppkey % 3 = 0),
dated AS (SELECT r.* EXCLUDE (datadate), t.exchg, country, datadate + later AS datadate
  FROM raw_statement r JOIN listed_twice t ON l_suppkey = t.s_suppkey JOIN exchange USING (exchg)
  WHERE popsrc = 'I' AND datafmt = 'HIST_STD')
SELECT CAST(l_suppkey AS VARCHAR) AS isin, exchg, fyear, datadate, {listed(r(c) for c in QUALITY)}
FROM (SELECT *, row_number() OVER (PARTITION BY country, l_suppkey, fyear ORDER BY datadate) AS rn
      FROM dated) WHERE rn = 1""",
    "read_export_file": "SELECT c_custkey AS rank, c_name AS country, c_acctbal AS value "
                        "FROM customer",
    "read_csv_file": "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer",
    "write_panel_readback": """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey,
  o_totalprice FROM orders""",
    "sample_n": """SELECT c_custkey, c_name FROM customer
ORDER BY md5('7|' || CAST(c_custkey AS VARCHAR)) LIMIT 10""",
    "factor_panel_split": f"WITH {panel(7)} SELECT {panel_columns()} FROM panel",
    "ols_grouped_dropped": f"{fitted(10, SHORTER)} SELECT {FIT_COLUMNS} FROM fit",
    "scan_skip_preamble": "SELECT c_custkey AS rank, c_name AS country, c_acctbal AS value "
                          "FROM customer",
    "exchange_map": f"""WITH {EXCHANGE} SELECT n_name, exchg, exchange_name, country, label
FROM nation JOIN exchange ON CAST(n_regionkey AS VARCHAR) = exchg""",
    "preview_first_n": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5",
    "price_semi_country": f"""WITH {PRICE}, {EXCHANGE}
SELECT exchg, isin, datadate, {TIES}, close_price FROM price
WHERE exchg IN (SELECT exchg FROM exchange WHERE country = 'Developing')""",
    "scalar_adjusted_prices": f"""WITH {PRICE} SELECT isin, datadate, {TIES}, adj_close_price,
  adj_trading_volume, market_capitalization FROM price""",
    "scalar_calendar": f"""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(month(o_orderdate) AS INTEGER) AS month,
  CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month_no,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, {MONTHS},
  CAST(date_trunc('month', o_orderdate) - INTERVAL 12 MONTH AS DATE) AS minus_12m,
  CAST(year(o_orderdate) + 2 AS INTEGER) AS reporting_year FROM orders""",
    "january_snapshot": f"WITH {PRICE} " + snapshot("price", ["close_price", "adj_close_price",
                                                             "trading_volume"]),
    "month_anchor": f"WITH {PRICE}, {ANCHOR} SELECT * FROM anchor",
    "horizon_anchor_dates": f"""WITH {PRICE}, {ANCHOR}, {HORIZON} SELECT exchg, isin, anchor_date,
  {listed(f"bf_{k}m" for k in BACK)}, aft_12m FROM horizon""",
    "daily_returns": f"""WITH {PRICE}, {RETURNS} SELECT exchg, isin, datadate, {TIES},
  {r('daily_return', 9)} FROM returns""",
    "rolling_volatility": f"""WITH {LONG}, {RETURNS}, {vol_rolled()}
SELECT exchg, isin, datadate, {TIES}, {listed(r(c) for c in VOL)} FROM vol_rolled""",
    "rolling_liquidity": f"""WITH {LONG}, {liq_rolled()}
SELECT exchg, isin, datadate, {TIES}, {listed(amount(c) for c in LIQ)} FROM liq_rolled""",
    "factor_size": f"WITH {PRICE}, {SIZE} SELECT * FROM size",
    "factor_yield": f"WITH {PRICE}, {YIELD} SELECT * FROM dividend",
    "factor_quality": f"""WITH {LISTING}, {statement()}, {QUALITY_CTE}
SELECT exchg, isin, year, datadate, {listed(r(c) for c in QUALITY)} FROM quality""",
    "factor_value": f"""WITH {PRICE}, {statement()}, {QUALITY_CTE}, {SIZE}, {VALUES}
SELECT exchg, isin, year, datadate, {listed(r(c, 4) for c in VALUE)} FROM value""",
    "factor_momentum": f"""WITH {PRICE}, {ANCHOR}, {HORIZON}, {MOMENTUM}
SELECT exchg, isin, year, datadate, {listed(r(c, 9) for c in [*MOM, TARGET])} FROM momentum""",
    "factor_volatility": f"""WITH {LONG}, {RETURNS}, {vol_rolled()},
volatility AS ({snapshot("vol_rolled", VOL)})
SELECT exchg, isin, year, datadate, {listed(r(c) for c in VOL)} FROM volatility""",
    "factor_liquidity": f"""WITH {LONG}, {liq_rolled()},
liquidity AS ({snapshot("liq_rolled", LIQ)})
SELECT exchg, isin, year, datadate, {listed(amount(c) for c in LIQ)} FROM liquidity""",
    "factor_growth": f"""WITH {LISTING}, {statement()}, {QUALITY_CTE}, {GROWTH}
SELECT exchg, isin, year, datadate, {listed(r(c) for c in YOY)} FROM growth""",
    "merge_factor_panel": f"WITH {panel(7)} SELECT {panel_columns()} FROM panel",
    "factor_panel_one_pass": f"WITH {panel(7)} SELECT {panel_columns()} FROM panel",
    "normalize_cross_section": f"""WITH {panel(7)}, {SCORED}
SELECT exchg, isin, year, {listed(r(c) for c in [*FACTORS, TARGET])} FROM scored""",
    "null_ratio_columns": f"""WITH {panel(21)}, {EXCHANGE}, {SCORED},
ratios AS (SELECT country, {listed(f"avg(CASE WHEN {c} IS NULL THEN 1::double ELSE 0 END) AS {c}"
                                   for c in FACTORS)}
  FROM scored JOIN exchange USING (exchg) GROUP BY country),
long AS (UNPIVOT ratios ON {listed(FACTORS)} INTO NAME factor VALUE null_ratio)
SELECT country, factor, {r('null_ratio')}, null_ratio < 0.2::double AS kept FROM long""",
    "dropna_complete_rows": f"""WITH {PPP} SELECT country_code, country_name, {PPP_ROUNDED}
FROM ppp WHERE {" AND ".join(f'"{y}" IS NOT NULL' for y in YEARS)}""",
    "linear_fit": f"""WITH {LINE} SELECT n, {r('slope', 4)}, {r('intercept', 4)}, {r('x_min')},
  {r('x_max')} FROM line""",
    "fit_line_points": f"""WITH {LINE}, points AS (
  SELECT CAST(p AS INTEGER) AS point, x_min + p * (x_max - x_min) / 49::double AS x,
    slope, intercept FROM line, range(0, 50) t(p))
SELECT point, {r('x', 4)}, {r('slope * x + intercept', 4, 'y')} FROM points""",
    "spearman_rank": f"WITH {RANK_PAIRS} SELECT count(*) AS n, {r('corr(rx, ry)', 9, 'spearman')} "
                     "FROM pairs",
    "gram_sums": f"""WITH {panel(7)}, {EXCHANGE}, {SCORED}, {DESIGN},
names AS (SELECT unnest([{listed(f"'{c}'" for c in [*FACTORS, TARGET])}]) AS name,
  unnest(range(1, {K + 2})) AS i)
SELECT country, n AS n_obs, a.name AS row, b.name AS col,
  {r('list_inner_product(m[a.i], m[b.i])', 6, 'total')}
FROM columns_of, names a, names b WHERE a.i <= b.i""",
    "ols_grouped": f"{FIT} SELECT {FIT_COLUMNS} FROM fit",
    "rowwise_mean": f"WITH {PPP}, {PPP_MEAN} SELECT country_code, {r('average_ppp', 4)} "
                    "FROM averaged",
    "ppp_outer_complete": f"""{DEVELOPMENT} SELECT country_code, country_name, {PPP_ROUNDED},
  {r('average_ppp', 4)}, region, income_group FROM complete""",
    "bucket_quartiles": f"{DEVELOPMENT} SELECT country_code, development_group FROM grouped",
    "bucket_fixed_thresholds": f"""SELECT o_orderkey, CASE
  WHEN o_totalprice < 3975.735294::double THEN '{GROUPS[0]}'
  WHEN o_totalprice < 10340.588235::double THEN '{GROUPS[1]}'
  WHEN o_totalprice < 22743.235294::double THEN '{GROUPS[2]}'
  ELSE '{GROUPS[3]}' END AS development_group FROM orders""",
    "bucket_index_levels": f"WITH {INDEX} SELECT country, hdi_group FROM leveled",
    "group_boundary_member": f"""{DEVELOPMENT}
SELECT development_group, country_name, {r('average_ppp', 4)}, members FROM (
  SELECT *, count(*) OVER (PARTITION BY development_group) AS members,
    row_number() OVER (PARTITION BY development_group ORDER BY average_ppp, country_name) AS rn
  FROM grouped) WHERE rn = 1""",
    "crosstab_groups": f"""{DEVELOPMENT} SELECT development_group, income_group,
  count(*) AS members, CAST(list_position([{listed(f"'{g}'" for g in GROUPS)}], development_group)
    - 1 AS INTEGER) AS group_order
FROM grouped GROUP BY development_group, income_group""",
    "crosstab_groups_wide": f"""{DEVELOPMENT} SELECT development_group, {listed(
        f"nullif(count(*) FILTER (WHERE income_group = '{s}'), 0) AS {s}" for s in
        ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))}
FROM grouped GROUP BY development_group""",
    "ranked_averages": f"""{DEVELOPMENT} SELECT country_name, {r('average_ppp', 4)} FROM complete
ORDER BY complete.average_ppp, country_code""",
    "filter_group_members": f"""{DEVELOPMENT} SELECT country_name FROM grouped
WHERE development_group = 'Low Development'""",
    "left_join_lookup": f"WITH {DOCS} SELECT * FROM labelled",
    "unmatched_keys": """SELECT doc_id, lang, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "repair_keys": f"""WITH {DOCS} SELECT doc_id, lang, source,
  coalesce(quality, CASE WHEN lang = 'fr' THEN 1 END) AS quality FROM labelled""",
    "rejoin_after_repair": f"""WITH {INDEX}, {WDI}
SELECT country, country_code, region, income_group FROM rejoined""",
    "distinct_groups": f"WITH {META} SELECT DISTINCT region, income_group FROM metadata",
    "rank_difference": f"""WITH {INDEX}, {RANKED}
SELECT country, hdi_rank, gni_rank_minus_hdi_rank FROM differed""",
    "group_mean_abs": f"""WITH {INDEX}, {RANKED} SELECT hdi_group,
  {r('avg(abs(gni_rank_minus_hdi_rank))', 6, 'mean_abs')},
  count(gni_rank_minus_hdi_rank) AS members FROM differed GROUP BY hdi_group""",
    "label_countries": """SELECT s_suppkey, 'Nation ' || split_part(n_name, '_', 2) AS country,
  r_name AS label
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "development_groups": f"""{DEVELOPMENT} SELECT country_code, country_name, {PPP_ROUNDED},
  {r('average_ppp', 4)}, region, income_group, development_group FROM grouped""",
    "hdi_groups": f"""WITH {INDEX}, {WDI} SELECT country, {r('hdi', 9)}, hdi_group, country_code,
  region, income_group FROM rejoined""",
    "chart_feed_map": f"""WITH {INDEX}, {WDI} SELECT country_code AS code,
  {r('hdi', 9, 'value')}, country AS name FROM rejoined""",
    "chart_feed_scatter": f"""WITH {INDEX}, {WDI} SELECT region AS "group", gni_per_capita AS x,
  {r('hdi', 9, 'y')} FROM rejoined JOIN (SELECT country, gni_per_capita FROM idx) USING (country)
WHERE region IS NOT NULL""",
    "rows_without_group": f"""WITH {INDEX}, {WDI} SELECT country, country_code FROM rejoined
WHERE income_group IS NULL""",
    "spearman_index_difference": f"""WITH {INDEX}, {RANKED}, complete AS (
  SELECT hdi, gni_rank - hdi_rank AS gap FROM idx JOIN hdi_places USING (c_custkey)
  JOIN gni_places USING (c_custkey)),
pairs AS (SELECT rank() OVER (ORDER BY hdi) + (count(*) OVER (PARTITION BY hdi) - 1) / 2::double
    AS rx,
  rank() OVER (ORDER BY gap) + (count(*) OVER (PARTITION BY gap) - 1) / 2::double AS ry
  FROM complete)
SELECT count(*) AS n, {r('corr(rx, ry)', 9, 'spearman')} FROM pairs""",
    "significant_factors": f"""{FIT}, {significant(0.10)}
SELECT country, factor, {r('beta', 5)}, {r('pvalue')}, label FROM significant""",
    "sig_count_by_label": f"""{FIT}, {significant(0.10)}
SELECT label, count(*) AS significant FROM significant WHERE factor IS NOT NULL GROUP BY label""",
    "sig_avg_by_label": f"""{FIT}, {significant(0.10)}
SELECT label, count(factor) AS significant, count(DISTINCT country) AS countries,
  {r('count(factor) / count(DISTINCT country)::double', 6, 'per_country')}
FROM significant GROUP BY label""",
    "fill_missing_groups": f"""{FIT}, {significant(0.0005)}
SELECT country, coalesce(factor, 'market_capitalization') AS factor,
  {r('CASE WHEN factor IS NULL THEN 0::double ELSE beta END', 5, 'beta')}, {r('pvalue')}, label
FROM significant""",
    "beta_matrix": f"""{FIT}, {significant(0.10)}
SELECT label, factor, {listed(r(f"any_value(beta) FILTER (WHERE country = '{c}')", 5,
                                f'"{c}"') for c in ("Developed", "Developing"))}
FROM significant GROUP BY label, factor""",
    "analyze_one_country": f"{FIT} SELECT {FIT_COLUMNS} FROM fit WHERE country = 'Developed'",
    "analyze_all_countries": f"{FIT} SELECT {FIT_COLUMNS} FROM fit",
}
