"""Line dedup by site-relative frequency.

Pages are grouped by host; the pages that contain a line are divided by the host's page
total, and a line whose ratio exceeds the limit is boilerplate of that host and dropped
from every page of it.  Built-in functions only.

Undefined cases: a page without a host has no site, so its lines are kept; a null text
stays null; an empty text stays empty; blank lines are never boilerplate and are kept.
Lines are compared without surrounding spaces; a page counts once for a line however
often it repeats it.  Repeated rows are pages of their own.  A line is boilerplate only
where it is on ``min_pages`` pages of the host (3), so that sites of a page or two, on which
every ratio is high, lose nothing.

Documents of a source are no pages of a host: what repeats among them is on few of a great
many, and whole documents are copied.  For them (``documents``) ``min_pages`` is 5, and a line goes as well from
``DOCUMENT_RATIO`` on, if it is on ``DOCUMENT_PAGES`` documents that differ elsewhere: the
documents with the line must have at least ``DOCUMENT_SPREAD`` times as many different
marks (the smallest key of their other lines), which copies do not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.frames import fresh, quoted
from factorloom.session import materialize

MAX_RATIO = 0.2
MIN_PAGES = 3
DOCUMENT_RATIO = 0.005
DOCUMENT_PAGES = 20
DOCUMENT_LEAST = 5
DOCUMENT_SPREAD = 0.5

# The parts of a page that show nothing, block tags, common entities.
HIDDEN = (r"(?is)<(?:!--.*?--|script\b[^>]*>.*?</script\s*|style\b[^>]*>.*?</style\s*"
          r"|title\b[^>]*>.*?</title\s*)>")
BLOCK = (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|"
         r"html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul|!doctype)\b[^>]*>")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
BLANKS = r"[\t\n\r\f]+"
GAPS = r"\n[ \n]*"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def url_host(url: Column) -> Column:
    """The lower-cased host of a URL without user and port; NULL where there is none."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(host != "", host)


def html_lines(html: Column) -> Column:
    """The visible text of a page, a line for each block: scripts, styles, titles and
    comments go, line ends of the source become spaces, block tags break lines, other tags
    vanish, common entities are decoded.  The patterns begin with a plain character, so
    that most of a page is passed over quickly."""
    out = F.regexp_replace(html, HIDDEN, " ")
    out = F.regexp_replace(out, BLANKS, " ")
    out = F.regexp_replace(out, BLOCK, "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(out, GAPS, "\n"), F.lit("\n "))


def _keyed(pages: DataFrame, host: str, text: str) -> DataFrame:
    """``host`` and ``keys``, those of a page's different lines that are not blank."""
    keys = F.transform(F.filter(F.transform(lines(F.col(text)), lambda x: F.trim(x)),
                                lambda x: x != ""), lambda x: F.xxhash64(x))
    return pages.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.array_distinct(keys).alias("keys"))


def _each(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each key.  The outer form, as the planner would repeat the cleaning of a page in a
    filter below a plain one."""
    return rows.select(*columns, F.explode_outer("keys").alias("line_key")).where("line_key IS NOT NULL")


def line_ratios(pages: DataFrame, host: str, text: str) -> DataFrame:
    """``host``, ``line_key``, ``line_pages``, ``host_pages`` and ``ratio`` of all lines that
    are not blank.  Only keys travel; counts are combined before the shuffle."""
    rows = _keyed(pages, host, text)
    counted = (_each(rows, "host").groupBy("host", "line_key").agg(F.count("*").alias("line_pages")))
    totals = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    return (counted.join(totals, "host")
            .withColumn("ratio", F.col("line_pages") / F.col("host_pages")))


def scattered(pages: DataFrame, host: str, text: str, ratios: DataFrame) -> DataFrame:
    """``host`` and ``line_key`` of the lines in ``ratios`` whose documents differ elsewhere.

    The mark of a document beside a line is the smallest key of its other lines; copies,
    also slightly edited ones, mostly share it.  Only lines in ``ratios`` are counted.
    """
    least = _keyed(pages, host, text).select("host", "keys", F.array_min("keys").alias("first"))
    least = least.withColumn("second", F.array_min(F.array_remove("keys", F.col("first"))))
    marks = _each(least, "host", "first", "second").select(
        "host", "line_key", F.when(F.col("line_key") == F.col("first"), F.col("second"))
        .otherwise(F.col("first")).alias("mark"))
    counted = marks.join(ratios.select("host", "line_key"), ["host", "line_key"], "left_semi").groupBy(
        "host", "line_key").agg(F.count_distinct("mark").alias("marks"))
    return ratios.join(counted, ["host", "line_key"]).where(
        (F.col("marks") >= DOCUMENT_PAGES) & (F.col("marks") > DOCUMENT_RATIO * F.col("host_pages"))
        & (F.col("marks") >= DOCUMENT_SPREAD * F.col("line_pages"))).select("host", "line_key")


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO,
                min_pages: int | None = None, documents: bool = False) -> DataFrame:
    """``host`` and ``line_keys``: the keys of its boilerplate lines.

    A host has at most (mean lines of a page) / ``max_ratio`` of them, whatever its size,
    so the array is bounded by the length of pages and not by their number; the same holds
    of ``documents`` and ``DOCUMENT_RATIO``.
    """
    ratios = line_ratios(pages, host, text)
    min_pages = min_pages or (DOCUMENT_LEAST if documents else MIN_PAGES)
    common = (F.col("ratio") > max_ratio) & (F.col("line_pages") >= min_pages)
    if documents:
        many = (F.col("ratio") > DOCUMENT_RATIO) & (F.col("line_pages") >= DOCUMENT_PAGES)
        ratios = materialize(ratios.where(common | many), "line_ratios")
        found = ratios.where(common).select("host", "line_key").union(
            scattered(pages, host, text, ratios.where(many)))
    else:
        found = ratios.where(common)
    return found.groupBy("host").agg(F.sort_array(F.collect_set("line_key")).alias("line_keys"))


def drop_boilerplate(pages: DataFrame, host: str | Column, text: str, max_ratio: float = MAX_RATIO,
                     min_pages: int | None = None, removed: str = "lines_removed",
                     documents: bool = False) -> DataFrame:
    """``pages`` with boilerplate lines cut from ``text``, and their number in ``removed``.

    The keys are written first, so the planner broadcasts them only when they are small
    and else joins on the host, where it can split a site that holds many pages.  Pages
    keep all their columns; a column named as ``removed`` gets another name beside it.
    """
    site, keys, removed = fresh(pages, "site"), fresh(pages, "line_keys"), fresh(pages, removed)
    pages = pages.withColumn(site, host if isinstance(host, Column) else F.col(host))
    found = materialize(boilerplate(pages, site, text, max_ratio, min_pages, documents), "boilerplate")
    found = found.select(F.col("host").alias(site), F.col("line_keys").alias(keys))
    joined = pages.join(found, site, "left")
    whole = lines(F.col(text))
    left = F.filter(whole, lambda x: ~F.array_contains(F.col(keys), F.xxhash64(F.trim(x))))
    marked = joined.select(
        *[F.col(quoted(c)) for c in pages.columns if c not in (text, site)],
        F.when(F.col(keys).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(text),
        F.when(F.col(keys).isNull() | F.col(text).isNull(), F.lit(0))
        .otherwise(F.size(whole) - F.size(left)).alias(removed))
    names = [c for c in pages.columns if c != site]
    return marked.select(*map(quoted, names), removed)
