"""Line dedup by site-relative frequency.

For each host the pages that contain a line are counted and divided by the host's
pages. Lines over the boilerplate ratio are dropped from all pages of the host.

A page counts a line once, told apart within the page itself, so counts add up in each
task before they shuffle, by (host, line): no host meets in one task. A page has a
bounded number of lines and each boilerplate line lies on at least ``ratio`` of the
pages, so a host has at most (mean lines a page) / ratio of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import BROADCAST_BYTES, WORD, octets, written

RATIO = 0.1
LEAST_PAGES = 10
# Boilerplate lines that may be broadcast, within BROADCAST_BYTES.
BROADCAST_LINES = 200_000
SALTS = 64
# Tags at which a browser starts a new line, and what it does not show.
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
BLOCK_TAG = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]"
    r"|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
)
HIDDEN = (
    r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"
)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; null if there is none."""
    host = F.regexp_extract(url, AUTHORITY, 1)
    return F.when(host != "", F.lower(host))


def html_lines(html: Column) -> Column:
    """The text of a page, one line per block."""
    shown = F.regexp_replace(html, HIDDEN, "")
    blocks = F.regexp_replace(shown, BLOCK_TAG, "\n")
    return F.regexp_replace(blocks, r"<[^>]*>", "")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\v\f\r"))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), _trimmed)


def boilerplate_lines(
    pages: DataFrame,
    host: Column,
    text: Column,
    ratio: float,
    least_pages: int,
    copies_count: bool = True,
) -> DataFrame:
    """(host, line, n, pages) of the lines over the ratio; ``line`` is trimmed."""
    rows = pages.select(host.alias("host"), text.alias("text")).where("host is not null")
    if not copies_count:
        rows = rows.distinct()
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = F.array_distinct(F.filter(_lines(F.col("text")), lambda x: x != ""))
    counts = (
        rows.select("host", F.explode(lines).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        # A line on fewer pages than this cannot be over the ratio of any host.
        .where(F.col("n") > ratio * least_pages)
    )
    return (
        counts.join(totals, "host")
        .where((F.col("pages") >= least_pages) & (F.col("n") > ratio * F.col("pages")))
        .select("host", "line", "n", "pages")
    )


def drop_boilerplate(
    pages: DataFrame,
    host: Column,
    text: Column,
    ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
    out: tuple[str, str, str] = ("clean_text", "n_lines", "n_dropped"),
    broadcast_lines: int = BROADCAST_LINES,
    copies_count: bool = True,
) -> DataFrame:
    """Every row of ``pages`` with its text without boilerplate lines, its lines and
    how many were dropped. ``host`` and ``text`` are expressions over ``pages``.

    Lines are compared without white space at their ends; lines of white space alone
    are never dropped or counted, the others stay as they were, in order. A null host
    belongs to no site: its lines stay. A null text has no lines and stays null. Hosts
    with fewer than ``least_pages`` pages keep all lines. Repeated rows are pages of
    their own; without ``copies_count``, equal texts of a host are one page. Columns
    named like an output are replaced, others kept whatever their names; an empty table
    gives an empty table.

    The boilerplate is broadcast when its counted lines and bytes are few; beyond that,
    pages are dealt to salts of their host and meet its lines there.
    """
    lines = written(
        boilerplate_lines(pages, host, text, ratio, least_pages, copies_count)
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("line")).alias("known")),
        "boilerplate",
    )
    kept = [F.col(c) for c in pages.columns if c not in out]
    rows = pages.select(
        F.struct(*kept).alias("_row"), host.alias("_host"), text.alias("_text")
    )
    count, size = lines.agg(F.sum(F.size("known")), F.sum(octets(lines))).first()
    lines = lines.withColumnRenamed("host", "_host").withColumnRenamed("known", "_known")
    if (count or 0) <= broadcast_lines and (size or 0) <= BROADCAST_BYTES:
        matched = rows.join(F.broadcast(lines), "_host", "left")
    else:
        salt = F.pmod(F.xxhash64("_text"), F.lit(SALTS))
        first, last = (F.lit(n).cast("bigint") for n in (0, SALTS - 1))
        dealt = F.explode(F.sequence(first, last))
        matched = rows.withColumn("_salt", salt).join(
            lines.withColumn("_salt", dealt), ["_host", "_salt"], "left"
        )
    known = F.coalesce(F.col("_known"), F.array().cast("array<string>"))

    def boiler(line: Column) -> Column:
        bare = _trimmed(line)
        return (bare != "") & F.array_contains(known, bare)

    every = F.split("_text", "\n", -1)
    stay = F.filter(every, lambda x: ~boiler(x))
    clean = F.when(F.size(known) == 0, F.col("_text")).otherwise(F.array_join(stay, "\n"))
    return matched.select("_row", clean.alias("_clean"), "_text").select(
        "_row.*",
        F.col("_clean").alias(out[0]),
        _shown(F.col("_text")).alias(out[1]),
        (_shown(F.col("_text")) - _shown(F.col("_clean"))).alias(out[2]),
    )


def without_boilerplate(docs: DataFrame, host: str, text: str, **options) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the column ``text`` and ``n_chars``
    counted again. Copies do not vote: equal texts of a host are one page, and a document
    that would lose most of its words is left whole, for a search for copies to judge."""
    out = ("_clean", "_lines", "_dropped")
    cleaned = drop_boilerplate(
        docs, F.col(host), F.col(text), out=out, copies_count=False, **options
    )
    words, left = (F.regexp_count(c, F.lit(WORD)) for c in (text, "_clean"))
    cut = F.when(F.col("_dropped") > 0, 2 * left >= words).otherwise(False)
    kept = F.when(cut, F.col("_clean")).otherwise(F.col(text))
    return cleaned.withColumns({text: kept, "n_chars": F.length(kept).cast("bigint")}).select(
        *docs.columns
    )


def _shown(text: Column) -> Column:
    """Lines that are more than white space; none for null."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: _trimmed(x) != "")
    return F.coalesce(F.when(text.isNotNull(), F.size(lines)), F.lit(0)).cast("bigint")
