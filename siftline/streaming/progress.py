"""Progress of downloads and silence in a stream of events, for batch and streaming frames alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import parallelism

#: Growth of a share from which it is told again, and the share from which it is always told.
STEP, NEARLY = 0.002, 0.99
#: Seconds of silence that count as slow, and that after the weights have arrived mean the model is being set up.
IDLE_SECONDS, INIT_SECONDS = 45.0, 4.0
#: Bytes from which a file's progress is reported, and seconds between two reports.
LARGE, PAUSE = 1 << 20, 1.0


def per_file(events: DataFrame, file: str = "file", loaded: str = "loaded", total: str = "total", attempt: str | None = None) -> DataFrame:
    """(file, loaded, total): the furthest state of every file, of every attempt if there are such; runs in update mode
    on a stream."""
    return events.groupBy(*([attempt] if attempt else []), file).agg(F.max(loaded).alias("loaded"), F.max(total).alias("total"))


def latest_attempt(events: DataFrame, attempt: str) -> DataFrame:
    """The events of the last attempt: a new one starts its own byte count."""
    return events.join(events.agg(F.max(attempt).alias(attempt)), attempt, "left_semi")


def planned_bytes(expected: DataFrame | None, base: float = 0.0) -> Column | float:
    """Bytes of a plan: what is always needed, and the files (file, size) of the plan."""
    return base if expected is None else expected.agg(F.coalesce(F.sum("size"), F.lit(0.0)) + F.lit(float(base))).scalar()


def share(files: DataFrame, expected: DataFrame | None = None, base: float = 0.0) -> DataFrame:
    """One row: bytes loaded, bytes in all, share of at most 0.99.

    Bytes in all are the plan's, and by how much each file turned out larger than the plan says (a file that isn't in
    the plan, as a whole). files: (file, loaded, total), a null total says nothing; expected: (file, size).
    """
    rows = files.select("file", "loaded", "total")
    rows = rows.withColumn("size", F.lit(0.0)) if expected is None else rows.join(expected.select("file", "size"), "file", "left")
    beyond = F.greatest(F.coalesce("total", F.lit(0.0)) - F.coalesce("size", F.lit(0.0)), F.lit(0.0))
    sums = rows.agg(F.coalesce(F.sum("loaded"), F.lit(0.0)).alias("loaded"), F.coalesce(F.sum(beyond), F.lit(0.0)).alias("beyond"))
    total = F.lit(planned_bytes(expected, base)) + F.col("beyond")
    return sums.select("loaded", total.alias("total")).withColumn("share", F.when(F.col("total") > 0, F.least(F.lit(NEARLY), F.col("loaded") / F.col("total"))).otherwise(0.0))


def _one_by_one(rows: DataFrame, keys: list[str], at: list[str], keep: Callable[[], Callable[[tuple], object]], columns: list[str], schema: str) -> DataFrame:
    """Rows in order, key by key, through a rule with a state of its own per key: sorted within tasks and streamed, so a
    key of any size is never held. keep() makes a rule that says of a row (columns) what to hand on, or None."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rule = None, None
        for batch in batches:
            out = []
            for row in batch[[*keys, *columns]].itertuples(index=False, name=None):
                if row[: len(keys)] != key:
                    key, rule = row[: len(keys)], keep()
                got = rule(row[len(keys) :])
                if got is not None:
                    out.append((*key, *got))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    ordered = rows.repartition(parallelism(rows.sparkSession), *keys).sortWithinPartitions(*keys, *at)
    return ordered.mapInPandas(run, schema)


def _teller() -> Callable[[float], bool]:
    """Says of every share whether it is to be told: one that has grown by STEP since the last one told, or nearly all."""
    last = -1.0

    def tell(value: float) -> bool:
        nonlocal last
        if value - last < STEP and value < NEARLY:
            return False
        last = value
        return True

    return tell


def throttled(progress: DataFrame, key: str, at: str, value: str, attempt: str | None = None) -> DataFrame:
    """(key, attempt, at, value) of the shares to be told: each is compared with the last one told, not with the one
    before it, and the first one of a key is always told. A new attempt starts anew."""
    keys = [key, *([attempt] if attempt else [])]
    kinds = {c: progress.schema[c].dataType.simpleString() for c in [*keys, at, value]}

    def keep():
        tell = _teller()
        return lambda row: row if row[1] is not None and tell(row[1]) else None

    return _one_by_one(progress, keys, [at], keep, [at, value], ", ".join(f"{c} {k}" for c, k in kinds.items()))


def reported(events: DataFrame, session: str = "session", at: str = "at") -> DataFrame:
    """(session, at, line): what a download tells of (session, at, status, file, loaded, total): every file's start, and
    then of large files that have started at most one line a second, the last one always, and no line twice in a row."""
    kind, when = (events.schema[c].dataType.simpleString() for c in (session, at))
    seconds = F.col(at).cast("timestamp").cast("double").alias("_s")

    def keep():
        started: set[str] = set()
        state = {"last": 0.0, "line": ""}

        def rule(row: tuple):
            time, now, status, file, loaded, total = row
            if not file:
                return None
            if status == "download":
                started.add(file)
                state["line"] = ""
                return time, f"{file} is coming"
            if status != "progress" or not total or total != total or file not in started or total < LARGE:
                return None
            if loaded < total and now - state["last"] < PAUSE:
                return None
            state["last"] = now
            line = f"{file}: {loaded / LARGE:.1f} of {total / LARGE:.1f} MB"
            if line == state["line"]:
                return None
            state["line"] = line
            return time, line

        return rule

    rows = events.select(session, at, seconds, "status", "file", F.col("loaded").cast("double"), F.col("total").cast("double"))
    return _one_by_one(rows, [session], [at, "status", "file", "loaded"], keep, [at, "_s", "status", "file", "loaded", "total"], f"{session} {kind}, {at} {when}, line string")


def gaps(events: DataFrame, key: str, at: str, seconds: float = IDLE_SECONDS) -> DataFrame:
    """(key, since, until, idle): silences of at least so many seconds between two events of a key."""
    along = Window.partitionBy(key).orderBy(at)
    rows = events.select(key, F.lag(at).over(along).alias("since"), F.col(at).alias("until"))
    idle = F.expr("timestampdiff(MICROSECOND, since, until)") / 1_000_000
    return rows.withColumn("idle", idle).where(F.col("idle") >= seconds)


def stages(events: DataFrame, key: str, at: str, done: Column) -> DataFrame:
    """(key, at, stage): `slow` after every IDLE_SECONDS of a silence, and once `init`, INIT_SECONDS into the first
    silence after all weights have arrived (done says of an event whether they have by then)."""
    along = Window.partitionBy(key).orderBy(at)
    rows = events.select(key, F.col(at).alias("since"), F.lead(at).over(along).alias("until"), F.max(F.coalesce(done, F.lit(False))).over(along).alias("_done"))
    rows = rows.withColumn("_idle", F.expr("timestampdiff(MICROSECOND, since, until)") / 1_000_000)
    after = lambda seconds: F.timestamp_seconds(F.unix_micros(F.col("since").cast("timestamp")) / 1_000_000 + seconds)
    slow = rows.where(F.col("_idle") >= IDLE_SECONDS).select(key, "since", F.explode(F.sequence(F.lit(1), F.floor(F.col("_idle") / IDLE_SECONDS).cast("int"))).alias("_n"))
    slow = slow.select(key, after(F.col("_n") * IDLE_SECONDS).alias("at"), F.lit("slow").alias("stage"))
    init = rows.where(F.col("_done") & (F.col("_idle") >= INIT_SECONDS)).groupBy(key).agg(F.min("since").alias("since"))
    return slow.unionByName(init.select(key, after(F.lit(INIT_SECONDS)).alias("at"), F.lit("init").alias("stage")))


def told(events: DataFrame, watermark: str = "10 minutes", forget: int = 3_600_000) -> DataFrame:
    """A stream of (file, at, share) with the shares to be told (see throttled): the last one told is a file's state, which
    is forgotten when the watermark is forget milliseconds beyond the file's last event."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, newest = state.get if state.exists else (-1.0, 0)
        rows = pd.concat(list(batches)).sort_values("at")  # one file's events of one micro-batch
        out = []
        for at, share in zip(rows["at"], rows["share"].tolist()):
            if share - last >= STEP or share >= NEARLY:
                last = share
                out.append((key[0], at, share))
            newest = max(newest, int(at.timestamp() * 1000))
        state.update((last, newest))
        state.setTimeoutTimestamp(max(newest + forget, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["file", "at", "share"])

    return (
        events.withWatermark("at", watermark)
        .groupBy("file")
        .applyInPandasWithState(step, "file string, at timestamp, share double", "last double, newest bigint", "append", "EventTimeTimeout")
    )
