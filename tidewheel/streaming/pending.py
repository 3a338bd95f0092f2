"""Requests that wait for their reply, each with its own time-out.

Waiting requests are an entry of keyed state with a timer for the next time-out. The reply
in time settles a request at once, and the timer goes with the last of a key; else the
time-out comes out when the timer goes off, with no later message of that id. Time is cut
into slots of a few time-outs, so a busy id soon is a new key again, and few replies matter
in two slots. An id has keys of its own, or ids are dealt to packs that share them: a key
costs several calls between Python and the state store, however much it holds.

Two clocks can drive the timers. ``event`` is the watermark: what comes out does not
depend on when the stream runs, so stored streams are replayed with it. ``wall`` is the
machines' clock from a request's arrival on: a live time-out needs no other message.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.clock import epoch_micros
from tidewheel.operators.correlation import correlation_keys
from tidewheel.schemas import REPLY_TIMEOUT_SECONDS
from tidewheel.sources.topics import file_topic
from tidewheel.streaming.correlation import PIECE_ROWS, arrivals
from tidewheel.streaming.runner import run_available

MODES = {"event": "EventTime", "wall": "ProcessingTime"}
# Slots that requests without a usable id are dealt to; no reply meets them there.
LONE_SLOTS = 1 << 20
# Time-outs in a slot.
SLOT = 4
# Replies of a key held in memory; beyond that they go to the state as they come.
HELD = 10_000
# Rows of both sides that share a key where ids are packed, on average.
PACK_ROWS = 1_000


def _pending(
    width: int, clock: str, match_instance: bool, packed: bool, slot: int, kinds: dict[str, str]
):
    """The processor for a time-out of ``width`` microseconds. The class is made here so
    that it travels to the workers by value."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    def rank(result):
        """Of replies at one instant a missing result wins, else the smallest."""
        return (result is not None, result)

    def usable(cid, inst) -> bool:
        return cid not in (None, "", b"") and (not match_instance or inst is not None)

    def earliest(names, replies):
        """The first reply in time of each request that has one."""
        first, replies = {}, iter(replies)
        while part := list(islice(replies, HELD)):
            at_once = {}
            for (cid, inst, at), result in part:
                if (cid, inst) in names:
                    own = at_once.setdefault((cid, inst), {})
                    own[at] = min(own[at], result, key=rank) if at in own else result
            for who, own in at_once.items():
                times = sorted(own)
                for name in names[who]:
                    place = bisect_left(times, name[2])
                    if place < len(times) and times[place] < name[2] + width:
                        new = (times[place], rank(own[times[place]]))
                        first[name] = min(first.get(name, new), new)
        return first

    class Pending(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            # A request, how often it came and until when (ms) it waits; replies that came
            # together, and until when they are kept.
            ids = f"cid array<{kinds['cid']}>, inst array<{kinds['inst']}>"
            self.requests = handle.getValueState(
                "requests", f"{ids}, ts array<bigint>, n array<bigint>, due array<bigint>"
            )
            self.replies = handle.getListState(
                "replies", f"{ids}, at array<bigint>, result array<{kinds['result']}>, due bigint"
            )

        def handleInputRows(self, key, rows, timerValues):
            asked, came, all_held = {}, {}, True
            for row in rows:
                cid, inst, at, is_request, result = row[:5]
                name = (cid, inst, at)
                if is_request:
                    asked[name] = asked.get(name, 0) + 1
                else:
                    came[name] = min(came[name], result, key=rank) if name in came else result
                    if len(came) >= HELD:
                        self.keep(key, came, timerValues)
                        came, all_held = {}, False
            waiting = self.waiting()
            timer = self.next(waiting)
            known = len(waiting)
            for name, n in asked.items():
                if name in waiting:
                    waiting[name] = (waiting[name][0] + n, waiting[name][1])
                else:
                    waiting[name] = (n, self.due(name[2], timerValues))
            names = {}
            for name in waiting:
                cid, inst, _ = name
                if usable(cid, inst):
                    names.setdefault((cid, inst if match_instance else None), []).append(name)
            first = {}
            if names:
                kept = self.replies.get() if known < len(waiting) or not all_held else ()
                first = earliest(names, chain(self.each(kept), came.items()))
            left = {name: own for name, own in waiting.items() if name not in first}
            if asked or first:
                self.wait(left, timer, known > 0)
            self.keep(key, came, timerValues)
            yield from self.outcomes(
                (name, waiting[name][0], True, result, at - name[2])
                for name, (at, (_, result)) in first.items()
            )

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            timer = expiredTimerInfo.getExpiryTimeInMs()
            if clock == "event":
                now = timerValues.getCurrentWatermarkInMs()
                if self.timed(key) and timer == self.end(key):
                    # All requests of the slot are over before, so no reply matters.
                    self.replies.clear()
                    return
            else:
                now = timerValues.getCurrentProcessingTimeInMs()
            waiting = self.waiting()
            left = {name: own for name, own in waiting.items() if own[1] > now}
            if len(left) < len(waiting):
                # The timer that goes off now goes by itself.
                self.wait(left, None, True)
            yield from self.outcomes(
                (name, n, False, None, None)
                for name, (n, _) in waiting.items()
                if name not in left
            )
            if clock == "wall":
                kept = [tuple(r) for r in self.replies.get()]
                stay = [r for r in kept if r[-1] > now]
                if not stay and kept:
                    self.replies.clear()
                elif len(stay) < len(kept):
                    self.replies.put(stay)

        def timed(self, key) -> bool:
            """Whether the key's slot is one of time."""
            return packed or usable(key[0], key[1])

        def waiting(self) -> dict:
            held = self.requests.get()
            if not held:
                return {}
            cids, insts, times, counts, dues = held
            return dict(zip(zip(cids, insts, times), zip(counts, dues)))

        def next(self, waiting) -> int | None:
            return min((due for _, due in waiting.values()), default=None)

        def wait(self, left, timer, stored) -> None:
            """Store what waits; the timer moves from ``timer`` to the next time-out."""
            if left:
                names, own = zip(*left), zip(*left.values())
                self.requests.update(tuple(map(list, chain(names, own))))
            elif stored:
                self.requests.clear()
            if timer != (due := self.next(left)):
                if timer is not None:
                    self.handle.deleteTimer(timer)
                if due is not None:
                    self.handle.registerTimer(due)

        def end(self, key) -> int:
            """The millisecond by which every request of the key's slot has timed out."""
            return ((key[-1] + 1) * slot + 1) * width // 1000 + 2

        def keep(self, key, came, timerValues) -> None:
            """Replies may come before their request; they are kept as long as it can."""
            if not came:
                return
            if clock == "event":
                due = self.end(key)
            else:
                # Odd, and a request's is even: no request takes the replies' timer along.
                due = (timerValues.getCurrentProcessingTimeInMs() + 2 * width // 1000) | 1
            columns = [*map(list, zip(*came)), list(came.values())]
            self.replies.appendValue((*columns, due))
            self.handle.registerTimer(due)

        def each(self, kept):
            for cids, insts, times, results, _ in kept:
                yield from zip(zip(cids, insts, times), results)

        def due(self, ts, timerValues) -> int:
            """The millisecond a request of this time has timed out by."""
            if clock == "event":
                return -(-(ts + width) // 1000)
            due = timerValues.getCurrentProcessingTimeInMs() + -(-width // 1000)
            return due + due % 2

        def outcomes(self, settled):
            """Outcomes as rows of lists; a request that came n times has n."""
            each = (
                (*name, ok, result, wait)
                for name, n, ok, result, wait in settled
                for _ in range(n)
            )
            while part := list(islice(each, HELD)):
                columns = map(list, zip(*part))
                yield Row(**dict(zip(("cid", "inst", "at", "ok", "result", "wait_us"), columns)))

        def close(self) -> None:
            pass

    return Pending()


def reply_outcomes_live(
    requests: DataFrame,
    replies: DataFrame,
    timeout_seconds: float = REPLY_TIMEOUT_SECONDS,
    lateness: str = "10 seconds",
    match_instance: bool = True,
    clock: str = "event",
    packs: int | None = None,
    slot_timeouts: int = SLOT,
) -> DataFrame:
    """Every request (cid, inst, ts) of a stream once, with ``ok``, ``result`` and
    ``wait_us``: as soon as its reply is there, or when its time is out.

    A reply counts as in ``reply_roundtrip``. Of replies in one micro-batch the earliest
    counts; one that comes in a later micro-batch than another is too late, whatever its
    time. A request without a time has no timer and does not come out.

    An id is a key of state for each slot of ``slot_timeouts`` time-outs. Where there are
    many more ids than a micro-batch should make keys, ``packs`` deals them to so many
    keys a slot; what comes out is the same. Both are fixed by a query's first run.
    """
    width = int(timeout_seconds * 1_000_000)
    kinds = {
        "cid": requests.schema["cid"].dataType.simpleString(),
        "inst": requests.schema["inst"].dataType.simpleString(),
        "result": replies.schema["result"].dataType.simpleString(),
    }
    span = slot_timeouts * width

    def marked(rows: DataFrame, at: str) -> DataFrame:
        return rows.where(F.col(at).isNotNull()).withWatermark(at, lateness)

    def slot(rows: DataFrame, at: str):
        return F.floor(epoch_micros(rows, at) / F.lit(span)).cast("bigint")

    def pack(*names: str):
        return F.pmod(F.xxhash64(*names), F.lit(packs or 1))

    keys = correlation_keys(match_instance)
    usable = F.coalesce(F.col("cid").cast("string"), F.lit("")) != ""
    if match_instance:
        usable &= F.col("inst").isNotNull()
    own = slot(requests, "ts")
    if packs is None:
        alone = F.pmod(F.xxhash64("cid", "inst", "ts"), F.lit(LONE_SLOTS))
        own = F.when(usable, own).otherwise(alone)
    asked = marked(requests, "ts").select(
        "cid",
        "inst",
        epoch_micros(requests, "ts").alias("at"),
        F.lit(True).alias("asked"),
        F.lit(None).cast(kinds["result"]).alias("result"),
        own.alias("slot"),
        F.when(usable, pack(*keys)).otherwise(pack("cid", "inst", "ts")).alias("pack"),
        F.col("ts").alias("time"),
    )
    # A reply early in its slot can be one to a request of the slot before.
    own = slot(replies, "reply_ts")
    early = epoch_micros(replies, "reply_ts") - own * span < F.lit(width)
    slots = F.when(early, F.array(own, own - 1)).otherwise(F.array(own))
    inst = F.col("inst") if match_instance else F.lit(None)
    answers = marked(replies.where(usable), "reply_ts").select(
        F.col("cid").cast(kinds["cid"]).alias("cid"),
        inst.cast(kinds["inst"]).alias("inst"),
        epoch_micros(replies, "reply_ts").alias("at"),
        F.lit(False).alias("asked"),
        "result",
        F.explode(slots).alias("slot"),
        F.col("reply_ts").alias("time"),
    )
    answers = answers.withColumn("pack", pack(*keys))
    rows = asked.unionByName(answers)
    rows = rows.drop("pack") if packs is None else rows
    found = rows.groupBy(*(keys if packs is None else ["pack"]), "slot").transformWithState(
        _pending(width, clock, match_instance, packs is not None, slot_timeouts, kinds),
        f"cid array<{kinds['cid']}>, inst array<{kinds['inst']}>, at array<bigint>, "
        f"ok array<boolean>, result array<{kinds['result']}>, wait_us array<bigint>",
        "Append",
        MODES[clock],
    )
    each = found.select(F.inline(F.arrays_zip(*found.columns)))
    return each.select(
        "cid", "inst", F.timestamp_micros("at").alias("ts"), "ok", "result", "wait_us"
    )


def pending_requests(session: SparkSession, checkpoint: str) -> DataFrame:
    """The requests (cid, inst, ts) that wait as of the last micro-batch, read from the
    state itself."""
    entries = (
        session.read.format("statestore").option("stateVarName", "requests").load(checkpoint)
    )
    each = F.arrays_zip(*[F.col(f"value.{c}") for c in ("cid", "inst", "ts", "n")])
    return entries.select(F.inline(each)).select(
        "cid",
        "inst",
        F.timestamp_micros("ts").alias("ts"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("_nth"),
    ).drop("_nth")


def pack_sizes(times: DataFrame, rows: int, pack_rows: int, width: float) -> dict[str, int]:
    """Packs, and time-outs in a slot, by which about ``pack_rows`` of the ``rows`` of
    ``times`` (ts) share a key. Ids and time are cut into equally many parts, so neither a
    busy id nor a busy time is a single key."""
    ways = max(1, math.ceil(math.sqrt(rows / pack_rows)))
    (ends,) = times.agg(F.percentile_approx("ts", [0.01, 0.99], 1000)).first()
    seconds = (ends[1] - ends[0]).total_seconds() if ends else 0
    return {"packs": ways, "slot_timeouts": max(SLOT, math.ceil(seconds / width / ways))}


def replay_outcomes(
    requests: DataFrame,
    replies: DataFrame,
    folder: str,
    piece_rows: int = PIECE_ROWS,
    timeout: float | None = None,
    pack_rows: int | None = None,
    **options,
) -> DataFrame:
    """Replay stored streams through ``reply_outcomes_live`` by the event clock.

    Rows arrive in time order in pieces of about ``piece_rows``. At the end the watermark
    has not passed the last requests; they are what the state still holds, unanswered.
    With ``pack_rows`` ids share keys, each of about so many rows.
    """
    session = requests.sparkSession
    sides = (
        (requests.select("cid", "inst", "ts"), "ts", f"{folder}/requests"),
        (replies.select("cid", "inst", "result", "reply_ts"), "reply_ts", f"{folder}/replies"),
    )
    times = sides[0][0].select("ts").unionByName(
        sides[1][0].select(F.col("reply_ts").alias("ts"))
    )
    rows = times.count()
    if pack_rows:
        width = options.get("timeout_seconds", REPLY_TIMEOUT_SECONDS)
        options |= pack_sizes(times, rows, pack_rows, width)
    for _ in arrivals(sides, times, rows, piece_rows):
        streams = [file_topic(session, path, side.schema) for side, _, path in sides]
        run_available(
            reply_outcomes_live(*streams, **options),
            f"{folder}/checkpoint",
            f"{folder}/out",
            timeout=timeout,
        )
    unanswered = pending_requests(session, f"{folder}/checkpoint").unionByName(
        sides[0][0].where("ts is null")
    )
    kind = replies.schema["result"].dataType
    waiting = unanswered.withColumns(
        {
            "ok": F.lit(False),
            "result": F.lit(None).cast(kind),
            "wait_us": F.lit(None).cast("bigint"),
        }
    )
    return session.read.schema(waiting.schema).parquet(f"{folder}/out").unionByName(waiting)
