"""Line dedup against plain Python, by either way of joining."""

import random

import pytest
from pyspark.sql import functions as F
from tidewheel.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, ratio, least):
    pages, seen = {}, {}
    for host, text in rows:
        if host is None:
            continue
        pages[host] = pages.get(host, 0) + 1
        for line in {x.strip(SPACE) for x in (text or "").split("\n")} - {""}:
            seen[host, line] = seen.get((host, line), 0) + 1
    out = []
    for host, text in rows:
        if text is None:
            out.append((host, text, None, 0, 0))
            continue
        lines = text.split("\n")
        shown = [x for x in lines if x.strip(SPACE)]
        gone = [
            x
            for x in shown
            if pages.get(host, 0) >= least
            and seen.get((host, x.strip(SPACE)), 0) > ratio * pages.get(host, 0)
        ]
        clean = "\n".join(x for x in lines if not x.strip(SPACE) or x not in gone)
        out.append((host, text, clean if gone else text, len(shown), len(gone)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(8)
    rows = []
    for host, n in (("hot", 300), ("small", 30), ("tiny", 4), (None, 20)):
        for _ in range(n):
            lines = [f"own {rng.random()}" for _ in range(rng.randint(0, 6))]
            for line, share in (("menu", 0.9), (" \tfooter ", 0.3), ("rare", 0.05), ("", 0.3)):
                if rng.random() < share:
                    lines.insert(rng.randint(0, len(lines)), line)
            rows.append((host, "\n".join(lines)))
    rows += [("hot", None), ("hot", ""), ("hot", "menu"), ("small", "menu\n" * 3000)]
    return rows + rows[:5]


@pytest.mark.parametrize("most", [10**6, 0])
def test_dropped_lines(spark, pages, most):
    schema = "host string, text string"
    df = spark.createDataFrame(pages, schema).withColumn("known", F.lit("z")).withColumn("_row", F.lit(1))
    cleaned = line_dedup.drop_boilerplate(df, F.col("host"), F.col("text"), broadcast_lines=most)
    found = [
        (r["host"], r["text"], r["clean_text"], r["n_lines"], r["n_dropped"])
        for r in cleaned.collect()
    ]
    assert sorted(found, key=repr) == brute(pages, line_dedup.RATIO, line_dedup.LEAST_PAGES)
    assert cleaned.columns == ["host", "text", "known", "_row", "clean_text", "n_lines", "n_dropped"]
    none = line_dedup.drop_boilerplate(df.limit(0), F.col("host"), F.col("text"))
    assert none.count() == 0


def test_hosts_and_lines_of_pages(spark):
    rows = [
        ("HTTP://user:pw@News.Example.com:8080/a?b#c", "<p>One <b>two</b></p><!-- x\n --><br>Three"),
        ("https://x.org", "<style>p{}</style><SCRIPT a>1<2\n</SCRIPT>plain"),
        ("no url", "a"),
        (None, None),
    ]
    df = spark.createDataFrame(rows, "url string, html string")
    found = df.select(
        line_dedup.host_of(F.col("url")).alias("h"), line_dedup.html_lines(F.col("html")).alias("t")
    ).collect()
    assert [r["h"] for r in found] == ["news.example.com", "x.org", None, None]
    assert [r["t"].split("\n") if r["t"] else r["t"] for r in found] == [
        ["", "One two", "", "Three"],
        ["plain"],
        ["a"],
        None,
    ]
