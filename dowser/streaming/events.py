"""File events: rename pairing, debouncing in sessions, and the one event that each path keeps. Batch and streaming."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dowser.functions import exprs as X

GAP, RENAME_WINDOW, WATERMARK = "1 second", 0.3, "2 seconds"
#: The less, the stronger; `other` events have no path and vanish.
PRIORITY = {"remove": 0, "rename": 1, "create": 2, "modify": 3}


def normalised(events: DataFrame) -> DataFrame:
    """(event_id, ts, kind, path, to_path, is_file) with the kinds that each path keeps: a rename without a target is a
    removal; a removal without a known kind of entry guesses it from the path; events without a path vanish."""
    kind = F.when((F.col("kind") == "rename") & F.col("to_path").isNull(), "remove").otherwise(F.col("kind"))
    entry = F.coalesce("is_file", X.path_kind("path") == "file")
    return events.where(F.col("path").isNotNull() & F.col("kind").isin(*PRIORITY)).select("event_id", "ts", kind.alias("kind"), "path", "to_path", entry.alias("is_file"))


def _rank() -> F.Column:
    out = F.when(F.lit(False), 0)
    for kind, rank in PRIORITY.items():
        out = out.when(F.col("kind") == kind, rank)
    return out


def strongest(events: DataFrame, *by: str) -> DataFrame:
    """One event for each group and path: the strongest, of equals the first."""
    best = F.min_by(F.struct("event_id", "ts", "kind", "to_path", "is_file"), F.struct(_rank().alias("r"), F.col("ts"), F.col("event_id")))
    return events.groupBy(*by, "path").agg(best.alias("e"), F.count(F.lit(1)).alias("events")).select(*by, "path", "e.*", "events")


def session_starts(events: DataFrame, span: F.Column, *by: str, inclusive: bool = True) -> DataFrame:
    """(by..., ts, session_start) of every distinct time: a session ends when no event came for `span` (or longer than
    it). No window holds more than one hour of a group: times are put in order within their hours, and one row an hour
    carries the edges over."""
    times = events.where(F.col("ts").isNotNull()).select(*by, "ts").distinct().withColumn("h", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    in_hour, hours = Window.partitionBy(*by, "h").orderBy("ts"), Window.partitionBy(*by).orderBy("h")
    prior = times.groupBy(*by, "h").agg(F.max("ts").alias("last")).select(*by, "h", F.lag("last").over(hours).alias("last_before"))
    edged = times.withColumn("before", F.lag("ts").over(in_hour)).join(prior, [*by, "h"]).withColumn("before", F.coalesce("before", "last_before"))
    apart = F.col("ts") >= F.col("before") + span if inclusive else F.col("ts") > F.col("before") + span
    begun = edged.withColumn("start", F.when(F.col("before").isNull() | apart, F.col("ts"))).select(*by, "ts", "h", "start")
    carried = begun.groupBy(*by, "h").agg(F.max("start").alias("last")).select(
        *by, "h", F.last("last", True).over(hours.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return begun.withColumn("own", F.last("start", True).over(in_hour)).join(carried, [*by, "h"]).select(*by, "ts", F.coalesce("own", "carried").alias("session_start"))


def sessions(events: DataFrame, gap: str = GAP) -> DataFrame:
    """(session_start, path, event_id, ts, kind, to_path, is_file, events): the strongest event of each path in each
    session; a session ends when no event at all, of any path, came for `gap`."""
    placed = session_starts(events, F.expr(f"interval {gap}"))
    return strongest(normalised(events).join(placed, "ts"), "session_start")


def split_by_bound(events: DataFrame, before: datetime | None, bound: datetime | None, gap: str = GAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(late, closed, open): events whose session had to be closed by the earlier bound `before`, or that have no time;
    events of sessions that end by `bound`; and the rest. Every event is in one of the three."""
    span = F.expr(f"interval {gap}")
    behind = F.col("ts").isNull() | (F.lit(False) if before is None else F.col("ts") + span <= F.lit(before).cast("timestamp_ntz"))
    live = events.where(~behind)
    placed = session_starts(live, span)
    ends = placed.groupBy("session_start").agg(F.max("ts").alias("last"))
    over = F.lit(False) if bound is None else F.col("last") + span <= F.lit(bound).cast("timestamp_ntz")
    marked = live.join(placed.join(ends, "session_start").select("ts", over.alias("over")), "ts")
    return events.where(behind), marked.where("over").select(*events.columns), marked.where("not over").select(*events.columns)


def thinned(events: DataFrame, gap: str = GAP) -> DataFrame:
    """Fewer events that make the same sessions() with any that come later: of each session and path the strongest, and
    the first and last time within each stretch of `gap`, as an event without a path. So what is kept of a session
    goes with its paths and its length, not with its traffic."""
    span = pd.Timedelta(gap).total_seconds()
    best = strongest(normalised(events).join(session_starts(events, F.expr(f"interval {gap}")), "ts"), "session_start")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    spine = events.groupBy(F.floor(micros / (span * 1_000_000)).alias("b")).agg(F.min_by("event_id", "ts").alias("i"), F.min("ts").alias("a"), F.max_by("event_id", "ts").alias("j"), F.max("ts").alias("z"))
    times = spine.select(F.explode(F.array(F.struct(F.col("i").alias("event_id"), F.col("a").alias("ts")), F.struct(F.col("j").alias("event_id"), F.col("z").alias("ts")))).alias("t")).select("t.*").distinct()
    none = {"kind": F.lit("other"), "path": F.lit(None).cast("string"), "to_path": F.lit(None).cast("string"), "is_file": F.lit(None).cast("boolean")}
    return best.select("event_id", "ts", "kind", "path", "to_path", "is_file").unionByName(times.withColumns(none))


def pair_renames(events: pd.DataFrame, window: float = RENAME_WINDOW, pending: list | None = None) -> tuple[pd.DataFrame, list]:
    """Events in order of time, with half renames ('rename_from', 'rename_to') paired: a `to` goes with the oldest
    waiting `from`; alone it is a creation; a `from` that waited longer than the window, when the next event comes, is
    a removal. Returns the events and the `from` halves still waiting."""
    waiting, out = list(pending or []), []
    for e in events.sort_values(["ts", "event_id"]).itertuples(index=False):
        while waiting and (e.ts - waiting[0][0]).total_seconds() > window:
            at, path, number = waiting.pop(0)
            out.append((number, at, "remove", path, None))
        if e.kind == "rename_from":
            waiting.append((e.ts, e.path, e.event_id))
        elif e.kind == "rename_to":
            if waiting:
                _, path, _ = waiting.pop(0)
                out.append((e.event_id, e.ts, "rename", path, e.path))
            else:
                out.append((e.event_id, e.ts, "create", e.path, None))
        else:
            out.append((e.event_id, e.ts, e.kind, e.path, e.to_path))
    return pd.DataFrame(out, columns=["event_id", "ts", "kind", "path", "to_path"]), waiting


PAIRED = "event_id bigint, ts timestamp_ntz, kind string, path string, to_path string"


def paired(events: DataFrame, source: str, window: float = RENAME_WINDOW) -> DataFrame:
    """pair_renames over every source's events (a watched root): halves of one rename come from one source.

    Nothing waits longer than the window, so a source's events are independent where they lie further apart, and each
    such stretch is a group of its own: a busy source is many small groups. Null sources and times pair with nothing
    and come out as they are.
    """
    span = F.expr(f"interval {round(window * 1e6)} microseconds")
    known = events.where(F.col(source).isNotNull() & F.col("ts").isNotNull())
    placed = session_starts(known, span, source, inclusive=False)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, waiting = pair_renames(pdf, window)
        rest = pd.DataFrame([(n, at, "remove", path, None) for at, path, n in waiting], columns=out.columns)
        return pd.concat([out, rest]) if len(rest) else out

    names = ["event_id", "ts", "kind", "path", "to_path"]
    found = known.join(placed, [source, "ts"]).select(*names, source, "session_start").groupBy(source, "session_start").applyInPandas(run, PAIRED)
    return found.unionByName(events.where(F.col(source).isNull() | F.col("ts").isNull()).select(*names))


def paired_stream(stream: DataFrame, source: str, window: float = RENAME_WINDOW) -> DataFrame:
    """The same over a stream, with the waiting halves of each source as state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = [(pd.Timestamp(at), path, n) for at, path, n in zip(*state.get, strict=True)] if state.exists else []
        got = [b for b in batches if len(b)]
        if got:
            out, waiting = pair_renames(pd.concat(got), window, waiting)
            yield out
        if waiting:
            at, path, number = zip(*waiting, strict=True)
            state.update(([str(t) for t in at], list(path), list(number)))
        elif state.exists:
            state.remove()

    return stream.groupBy(source).applyInPandasWithState(run, PAIRED, "at array<string>, path array<string>, number array<bigint>", "append", GroupStateTimeout.NoTimeout)
