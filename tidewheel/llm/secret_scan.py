"""Secret scans: known forms, and sliding-window entropy over candidate strings.

Known forms are found by patterns. For the rest, runs of one character class are
candidates. A window slides along each; the counts of its characters are kept up to
date as one enters and one leaves, and with them the sum that its Shannon entropy
follows from, in whole millionths so that any order of adding gives the same value.
Windows at or over the class's threshold are joined into spans. Spans that an
allow-list pattern explains, or that lie inside a known form, are not reported.

Everything is built-in functions. The counts of a window are a string with one
character per symbol, of which ``overlay`` replaces one at each step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MILLION = 1_000_000
GROUP = 256
# Characters of a long run that are scanned at a time.
STRIP = 512


@dataclass(frozen=True)
class Known:
    """A form told by a pattern; matches whose group ``group`` has fewer than
    ``least`` characters are dropped after matching."""

    kind: str
    pattern: str
    group: int
    least: int


@dataclass(frozen=True)
class CharClass:
    """Runs of ``chars`` of at least ``window`` characters that also match every
    pattern of ``having``; windows count from ``bits`` of entropy a character."""

    kind: str
    chars: str
    window: int
    bits: float
    having: tuple[str, ...] = ()

    @property
    def runs(self) -> str:
        return f"[{self.chars}]{{{self.window},}}"

    @property
    def most_missing(self) -> int:
        """Greatest sum of c * log2(c) over the counts, in millionths."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * MILLION)


# The base forms.
KNOWN = (
    Known(
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]"
        r"|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    # Whole runs: shorter ones fail wherever they are started, so asking for the least
    # size in the pattern drops the same matches as after matching.
    Known("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Known("hex", r"[0-9a-f]{24,}", 0, 24),
)
CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 20, 3.0, ("[0-9]", "[A-Fa-f]")),
    CharClass("entropy_base64", "A-Za-z0-9+/_-", 20, 3.8, ("[0-9]", "[A-Z]", "[a-z]")),
    CharClass("entropy_alnum", "a-z0-9", 20, 3.8, ("[0-9]", "[a-z]")),
)
# Strings that look random and are none: whole spans that match are suppressed.
ALLOWED = (
    r"(?:0123456789|abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ)[A-Za-z0-9+/_-]*",
    r"[A-Za-z0-9+/_-]*(?:EXAMPLE|example|placeholder|PLACEHOLDER|XXXX|xxxx)[A-Za-z0-9+/_-]*",
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs (start, stop, size): code points,
    stop exclusive, size of the group.

    The text between the matches tells where each lies; only texts with a match are
    taken apart."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = (
        found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    )
    gaps = F.split(text, pattern, -1)
    zero = F.lit(0).cast("bigint")
    none = F.array().cast("array<struct<start:bigint,stop:bigint,size:int>>")
    steps = F.zip_with(
        F.slice(gaps, 1, F.size(found)),
        F.arrays_zip(found.alias("found"), sized.alias("sized")),
        lambda gap, own: F.struct(
            F.length(gap).alias("gap"),
            F.length(own["found"]).alias("found"),
            F.length(own["sized"]).alias("size"),
        ),
    )
    # Arrays grow by copying, so places are summed up in groups: first where each
    # group begins, then within the groups.
    groups = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(found) - 1) / GROUP).cast("int")),
        lambda g: F.slice(steps, g * GROUP + 1, F.lit(GROUP)),
    )
    begins = F.aggregate(
        groups,
        F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda state, group: F.struct(
            F.aggregate(group, state["at"], lambda n, x: n + x["gap"] + x["found"]).alias(
                "at"
            ),
            F.concat(state["all"], F.array(state["at"])).alias("all"),
        ),
        lambda state: state["all"],
    )

    def place(state: Column, x: Column) -> Column:
        start, stop = state["at"] + x["gap"], state["at"] + x["gap"] + x["found"]
        span = F.struct(
            start.alias("start"), stop.alias("stop"), x["size"].alias("size")
        )
        return F.struct(
            stop.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans")
        )

    placed = F.flatten(
        F.zip_with(
            groups,
            begins,
            lambda group, at: F.aggregate(
                group,
                F.struct(at.alias("at"), none.alias("spans")),
                place,
                lambda state: state["spans"],
            ),
        )
    )
    return F.when(F.rlike(text, F.lit(pattern)), placed).otherwise(none)


def hot_windows(run: Column, cls: CharClass) -> Column:
    """Spans of ``run`` covered by windows at or over the threshold, as structs
    (start, stop) within the run, in order and apart."""
    w = cls.window
    weight = F.array(*[F.lit(0)] + [_term(c) for c in range(1, w + 1)])
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def place(char: Column) -> Column:
        return F.ascii(char) - 31

    def count(counts: Column, char: Column) -> Column:
        return F.ascii(F.substring(counts, place(char), F.lit(1))) - 48

    def put(counts: Column, char: Column, n: Column) -> Column:
        return F.overlay(counts, F.chr(n + 48), place(char), F.lit(1))

    def term(n: Column) -> Column:
        return F.get(weight, n)

    def enter(state: Column, i: Column) -> Column:
        """One character enters, in a state whose leaver is gone."""
        char = F.substring(run, i, F.lit(1))
        n = count(state["counts"], char)
        return F.struct(
            put(state["counts"], char, n + 1).alias("counts"),
            (state["missing"] + term(n + 1) - term(n)).alias("missing"),
            state["spans"].alias("spans"),
        )

    def leave(state: Column, i: Column) -> Column:
        char = F.substring(run, i - w, F.lit(1))
        n = count(state["counts"], char)
        gone = F.struct(
            put(state["counts"], char, n - 1).alias("counts"),
            (state["missing"] + term(n - 1) - term(n)).alias("missing"),
            state["spans"].alias("spans"),
        )
        return F.when(i > w, gone).otherwise(state)

    def note(state: Column, i: Column) -> Column:
        """The window that ends at character ``i`` joins the last span or opens one."""
        spans = state["spans"]
        last = F.element_at(spans, -1)
        opened = F.struct((i - w).alias("start"), i.alias("stop"))
        touching = (F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["stop"] >= i - w)
        joined = F.concat(
            F.slice(spans, 1, F.size(spans) - 1),
            F.array(F.struct(last["start"].alias("start"), i.alias("stop"))),
        )
        hot = (i >= w) & (state["missing"] <= cls.most_missing)
        return F.struct(
            state["counts"].alias("counts"),
            state["missing"].alias("missing"),
            F.when(
                hot,
                F.when(touching, joined).otherwise(F.concat(spans, F.array(opened))),
            )
            .otherwise(spans)
            .alias("spans"),
        )

    # One function a step, so that each state is worked out once.
    return F.aggregate(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.length(run)),
                lambda i: F.array(
                    F.struct(i.alias("i"), F.lit(0).alias("step")),
                    F.struct(i.alias("i"), F.lit(1).alias("step")),
                    F.struct(i.alias("i"), F.lit(2).alias("step")),
                ),
            )
        ),
        F.struct(
            F.lit("0" * 96).alias("counts"),
            F.lit(0).cast("bigint").alias("missing"),
            none.alias("spans"),
        ),
        lambda state, x: F.when(x["step"] == 0, leave(state, x["i"]))
        .when(x["step"] == 1, enter(state, x["i"]))
        .otherwise(note(state, x["i"])),
        lambda state: state["spans"],
    )


def hot_spans(run: Column, cls: CharClass) -> Column:
    """``hot_windows`` of a run of any length, in time that grows with the length: the run
    is cut into strips, each with the first characters of the next that windows reach
    into, and spans that touch where strips meet are joined."""
    w = cls.window
    step = STRIP - w + 1

    def strips(pieces: Column) -> Column:
        # Whole strips first: a window's steps read theirs again and again.
        whole = F.transform(
            pieces,
            lambda piece, i: F.concat(
                piece, F.coalesce(F.left(F.get(pieces, i + 1), F.lit(w - 1)), F.lit(""))
            ),
        )
        found = F.transform(
            whole,
            lambda strip, i: F.transform(
                hot_windows(strip, cls),
                lambda s: F.struct(
                    (s["start"] + i * step).alias("start"), (s["stop"] + i * step).alias("stop")
                ),
            ),
        )
        return _bound(F.flatten(found), _joined)

    pieces = F.regexp_extract_all(run, F.lit(f".{{1,{step}}}"), F.lit(0))
    return _bound(pieces, strips)


def _joined(spans: Column) -> Column:
    """Spans in order, those that touch as one."""
    first = F.filter(
        spans, lambda s, i: (i == 0) | (s["start"] > F.get(spans, i - 1)["stop"])
    )
    last = F.filter(
        spans,
        lambda s, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["start"] > s["stop"]),
    )
    return F.zip_with(
        first, last, lambda a, b: F.struct(a["start"].alias("start"), b["stop"].alias("stop"))
    )


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _term(count: int) -> Column:
    return F.lit(round(count * math.log2(count) * MILLION)).cast("bigint")


def secret_spans(
    docs: DataFrame,
    text: str = "text",
    known: Sequence[Known] = KNOWN,
    classes: Sequence[CharClass] = CLASSES,
    allowed: Sequence[str] = ALLOWED,
    out: str = "secrets",
) -> DataFrame:
    """Every row of ``docs`` with the array ``out`` of its secrets, structs (start,
    stop, rank, kind) in order of start and then of kind as listed.

    Known forms come first in the list, then the classes. Starts and stops are code
    points of the whole text, stops exclusive. A null or empty text gives an empty
    array; rows are judged one by one; a column of ``docs`` named ``out`` is replaced;
    an empty table gives an empty table.
    """
    kept_columns = [F.col(c) for c in docs.columns if c != out]
    rows = docs.select(
        F.struct(*kept_columns).alias("_row"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    )
    whole = F.col("_text")
    for rank, form in enumerate(known):
        rows = rows.withColumn(
            f"_k{rank}", _labelled(_known_spans(whole, form), rank, form.kind)
        )
    base = F.concat(*[F.col(f"_k{rank}") for rank in range(len(known))])
    rows = rows.withColumn("_base", base)
    for at, cls in enumerate(classes):
        found = _labelled(
            _class_spans(whole, F.col("_base"), cls, allowed), len(known) + at, cls.kind
        )
        some = F.rlike(whole, F.lit(cls.runs))
        none = F.slice(F.col("_base"), 1, 0)
        rows = rows.withColumn(f"_c{at}", F.when(some, found).otherwise(none))
    every = F.concat(F.col("_base"), *[F.col(f"_c{at}") for at in range(len(classes))])
    return rows.select("_row.*", F.array_sort(every).alias(out))


def _known_spans(whole: Column, form: Known) -> Column:
    found = matches(whole, form.pattern, form.group)
    return F.filter(found, lambda m: m["size"] >= form.least)


def _class_spans(
    whole: Column, base: Column, cls: CharClass, allowed: Sequence[str]
) -> Column:
    """Hot spans of the class's runs, without allowed ones and those in ``base``."""

    def suppressed(run: Column, s: Column) -> Column:
        own = F.substring(run, s["start"] + 1, s["stop"] - s["start"])
        return _any(F.rlike(own, F.lit(f"^(?:{a})$")) for a in allowed)

    def of_run(r: Column) -> Column:
        hot = F.filter(
            hot_spans(r["run"], cls), lambda s: ~suppressed(r["run"], s)
        )
        return F.transform(
            hot,
            lambda s: F.struct(
                (r["start"] + s["start"]).alias("start"),
                (r["start"] + s["stop"]).alias("stop"),
            ),
        )

    runs = F.filter(
        F.zip_with(
            matches(whole, cls.runs),
            F.regexp_extract_all(whole, F.lit(cls.runs), F.lit(0)),
            lambda m, run: F.struct(m["start"].alias("start"), run.alias("run")),
        ),
        lambda r: _all(F.rlike(r["run"], F.lit(h)) for h in cls.having),
    )
    return F.filter(
        F.flatten(F.transform(runs, of_run)),
        lambda s: ~F.exists(
            base, lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"])
        ),
    )


def _labelled(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(
        spans,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(rank).alias("rank"),
            m["stop"].alias("stop"),
            F.lit(kind).alias("kind"),
        ),
    )


def _all(conditions) -> Column:
    result = F.lit(True)
    for condition in conditions:
        result = result & condition
    return result


def _any(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def span_list(secrets: Column) -> Column:
    """kind:start:end of each secret, joined by commas."""
    return F.array_join(
        F.transform(
            secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])
        ),
        ",",
    )
