"""Secret spans against plain Python."""

import hashlib
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F
from tidewheel.llm import secret_scan

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A,
)


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for rank, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return found


def windows(run, cls):
    """Maximal spans of windows over the threshold, entropies from scratch."""
    spans = []
    for i in range(len(run) - cls.window + 1):
        own = run[i : i + cls.window]
        missing = sum(
            round(own.count(c) * math.log2(own.count(c)) * secret_scan.MILLION) for c in set(own)
        )
        if missing <= cls.most_missing:
            if spans and spans[-1][1] >= i:
                spans[-1][1] = i + cls.window
            else:
                spans.append([i, i + cls.window])
    return spans


def all_spans(text):
    found = base_spans(text)
    base = list(found)
    for rank, cls in enumerate(secret_scan.CLASSES, 3):
        for m in re.finditer(cls.runs, text):
            if not all(re.search(h, m[0]) for h in cls.having):
                continue
            for a, b in windows(m[0], cls):
                own = m[0][a:b]
                if any(re.fullmatch(p, own) for p in secret_scan.ALLOWED):
                    continue
                a, b = a + m.start(), b + m.start()
                if not any(x <= a and b <= y for x, _, y, _ in base):
                    found.append((a, rank, b, cls.kind))
    return sorted(found)


def made_texts():
    rng = random.Random(4)
    key = lambda n, letters: "".join(rng.choices(letters, k=n))
    mixed = string.ascii_letters + string.digits + "+/"
    texts = [
        "",
        None,
        "token=abc token: abcdef",
        "secret=token: abcdefgh",
        "PassWord = 'hunter22' passwd:\"x\" api_key==zzzzzz apikey: short",
        "ſecret=abcdefg toKen=abcdefg tokEn = 'é' ",
        "AKIA" + key(16, string.ascii_uppercase) + " AKIA123 xAKIAAKIA" + key(20, "ABC123"),
        "é日本 " + key(24, "0123456789abcdef") + "Z" + key(23, "0123456789abcdef"),
        "id " + key(40, mixed) + " end",
        "https://x.org/" + key(60, mixed) + "/" + "a" * 50 + key(30, mixed),
        "abcdefghijklmnopqrstuvwxyz0123456789",
        "EXAMPLE" + key(30, mixed),
        "123e4567-e89b-12d3-a456-426614174000",
        key(30, "0123456789ABCDEF"),
        "thequickbrownfoxjumpsoverthelazydog" * 3,
        " ".join("token=" + key(8, "abcdef") for _ in range(700)),
        ("word " * 4000) + key(44, mixed),
    ]
    texts += [
        "".join(rng.choices([key(25, mixed), " ", "token=", "AKIA", "x", "é", key(21, "abc012")], k=12))
        for _ in range(60)
    ]
    return texts


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(i, t, "r", "t") for i, t in enumerate(made_texts())] + [(None, "token=abcdef", "r", "t")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `_row` string, `_text` string")
    return secret_scan.secret_spans(docs.repartition(3))


def test_every_span(scanned):
    rows = scanned.collect()
    assert len(rows) == len(made_texts()) + 2
    added = 0
    for row in rows:
        found = [(s["start"], s["rank"], s["stop"], s["kind"]) for s in row["secrets"]]
        assert found == all_spans(row["text"] or ""), row["text"]
        added += sum(s["rank"] > 2 for s in row["secrets"])
    assert added > 20
    assert scanned.columns == ["doc_id", "text", "_row", "_text", "secrets"]


def test_list_of_spans(scanned):
    rows = scanned.select(
        "text", F.sha2(secret_scan.span_list(F.col("secrets")), 256).alias("h")
    ).collect()
    for row in rows:
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in all_spans(row["text"] or ""))
        assert row["h"] == hashlib.sha256(joined.encode()).hexdigest()


def test_plan_is_native_and_empty_tables_pass(scanned):
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange RoundRobin" in plan
    assert secret_scan.secret_spans(scanned.drop("secrets").limit(0)).count() == 0


def sliding(run, cls):
    """``windows`` with counts kept up to date."""
    term = [0] + [round(c * math.log2(c) * secret_scan.MILLION) for c in range(1, cls.window + 1)]
    counts, missing, spans = dict.fromkeys(run, 0), 0, []
    for i, char in enumerate(run):
        if i >= cls.window:
            gone = run[i - cls.window]
            counts[gone] -= 1
            missing += term[counts[gone]] - term[counts[gone] + 1]
        counts[char] += 1
        missing += term[counts[char]] - term[counts[char] - 1]
        start = i + 1 - cls.window
        if start >= 0 and missing <= cls.most_missing:
            if spans and spans[-1][1] >= start:
                spans[-1][1] = i + 1
            else:
                spans.append([start, i + 1])
    return spans


def long_runs(spark, runs, cls):
    docs = spark.createDataFrame([(i, r) for i, r in enumerate(runs)], "id int, run string")
    found = docs.select("id", secret_scan.hot_spans(F.col("run"), cls).alias("spans")).collect()
    return {r["id"]: [[s["start"], s["stop"]] for s in r["spans"]] for r in found}


def test_runs_of_any_length(spark):
    cls, rng = secret_scan.CLASSES[1], random.Random(8)
    mixed = string.ascii_letters + string.digits + "+/"
    runs = []
    for n in (20, 21, 492, 493, 494, 511, 512, 513, 986, 1004, 1005, 1006, 3000):
        runs.append("".join(rng.choices(mixed, k=n)))
        # Hot and cold stretches in turn, with edges at all places of a strip.
        parts = ["".join(rng.choices(mixed if i % 2 else "aB3", k=rng.randint(1, 60))) for i in range(n // 30 + 1)]
        runs.append("".join(parts))
    assert all(sliding(r, cls) == windows(r, cls) for r in runs)
    assert long_runs(spark, runs, cls) == {i: sliding(r, cls) for i, r in enumerate(runs)}


def test_a_long_run_within_a_text(spark):
    cls, rng = secret_scan.CLASSES[1], random.Random(9)
    mixed = string.ascii_letters + string.digits + "+/"
    run = "".join(
        "".join(rng.choices(mixed if i % 2 else "aB3", k=rng.randint(1, 60))) for i in range(4_000)
    )
    assert len(run) > 100_000
    assert long_runs(spark, [run], cls) == {0: sliding(run, cls)}
    docs = spark.createDataFrame([(1, f"data:{run} token=abcdef")], "doc_id int, text string")
    (row,) = secret_scan.secret_spans(docs).collect()
    kinds = {s["kind"] for s in row["secrets"]}
    assert {"assign", "entropy_base64"} <= kinds
