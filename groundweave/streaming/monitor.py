"""The run monitor: latest status of each rank, log lines, crash alerts and changes, on streams and as batch twins."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from groundweave.operators.sampling import dealt_by_range
from groundweave.sources.shared import discard, written

# The fields of a status, and what is shown of ranks that haven't reported.
STATUS = "event_id long, ts timestamp, rank long, current_task string, progress string, level string, current_step string, error string"
LOG = "timestamp double, msg string"
#: A change of these is always written; of the others at most every so often.
FORCED = ("current_task", "progress", "level", "error")
FIELDS = (*FORCED, "current_step")
UNSEEN = {"current_task": "Waiting...", "progress": "-", "level": "-", "current_step": "-"}
SHOWN = ("current_task", "progress", "level", "current_step", "error")


def latest_status(stream: DataFrame) -> DataFrame:
    """rank, ts and the fields of the last row of each rank by time and event; for streams in complete or update mode."""
    last = F.max_by(F.struct("ts", *SHOWN), F.struct("ts", "event_id"))
    return stream.groupBy("rank").agg(last.alias("s")).select("rank", "s.*")


def with_waiting(latest: DataFrame, world_size: int) -> DataFrame:
    """latest for all ranks under world_size; ranks never seen show Waiting... and - (used on each batch of a stream)."""
    ranks = latest.sparkSession.range(world_size).withColumnRenamed("id", "rank")
    return ranks.join(latest, "rank", "left").withColumns({c: F.when(F.col("ts").isNull(), v).otherwise(F.col(c)) for c, v in UNSEEN.items()})


def log_tail(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """timestamp, msg of non-empty, well-formed JSON lines under path; the stream's checkpoint is its place in the files."""
    reader = (spark.readStream if stream else spark.read).schema(LOG + ", _bad string")
    lines = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return lines.where(F.col("_bad").isNull() & (F.length(F.trim("msg")) > 0)).select(F.timestamp_seconds("timestamp").alias("at"), "msg")


def crash_alerts(stream: DataFrame) -> DataFrame:
    """Rows with an error; stop_on_crash ends a run on the first."""
    return stream.where(F.length("error") > 0)


def first_crash(statuses: DataFrame) -> DataFrame:
    """The first row with an error, by time and event."""
    return crash_alerts(statuses).orderBy("ts", "event_id").limit(1)


def _changes(rows: pd.DataFrame, last: tuple | None, at: float, gap: float) -> tuple[list[bool], tuple | None, float]:
    """Which rows, in order, are emitted after the state (last fields, time of the last emission)."""
    out = []
    for ts, *fields in rows[["ts", *FIELDS]].itertuples(index=False):
        now, own = ts.timestamp(), tuple(None if pd.isna(f) else f for f in fields)
        changed = last is None or own != last
        forced = last is None or own[: len(FORCED)] != last[: len(FORCED)]
        emit = changed and (forced or now - at > gap)
        if emit:
            at = now
        if changed:
            last = own
        out.append(emit)
    return out, last, at


def status_changes(stream: DataFrame, min_gap_s: float = 0.1) -> DataFrame:
    """Rows of a stream of STATUS in which a field changed: always if one of FORCED did, else at most every min_gap_s.
    The state of a rank is its last fields and the time of its last emission."""
    n = len(FIELDS)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last, at = (tuple(state.get[:n]), state.get[n]) if state.exists else (None, 0.0)
        emit, last, at = _changes(rows, last, at, min_gap_s)
        state.update((*last, at))
        yield rows[emit]

    return stream.groupBy("rank").applyInPandasWithState(step, STATUS, ", ".join(f"{c} string" for c in FIELDS) + ", at double", "append", GroupStateTimeout.NoTimeout)


#: Rows of a task of the batch fold.
FOLDED = 200_000
_STATE = ", ".join(f"{c} string" for c in FIELDS) + ", at double"


def _walk(rows: pd.DataFrame, entry: tuple | None, gap: float) -> tuple[list[bool], list[tuple]]:
    """Which rows of a range are emitted, in order, and (rank, *fields, at) of each rank at its end. Rows with _state bring the state that their
    rank had before; entry is (rank, *fields, at) of the rank that the range before ended with."""
    emitted: list[bool] = []
    ends = []
    for rank, own in rows.groupby("rank", sort=False):
        last, at = (tuple(entry[1:-1]), entry[-1]) if entry is not None and entry[0] == rank else (None, 0.0)
        if own["_state"].iloc[0]:
            first, own = own.iloc[0], own.iloc[1:]
            last, at = tuple(None if pd.isna(first[c]) else first[c] for c in FIELDS), float(first["_at"])
            emitted.append(False)
        flags, last, at = _changes(own, last, at, gap)
        emitted += flags
        if last is not None:
            ends.append((int(rank), *last, at))
    return emitted, ends


def changes_by_ranges(statuses: DataFrame, min_gap_s: float = 0.1, state: DataFrame | None = None, per_task: int = FOLDED) -> tuple[DataFrame, DataFrame]:
    """(changes, state): the rows of STATUS in which a field changed, always if one of FORCED did, else at most every min_gap_s, and rank, the last fields and
    the time of the last emission of every rank. state: that of the rows before these.

    Rows are folded by ranges of (rank, ts, event_id), so that a rank with most rows is no single task. A range needs what the one before
    it ends with: all are folded with a guess first, then those again whose guess was wrong, until none is; as a forced change or a
    pause makes the end independent of the beginning, that takes a round or two, and it ends after as many rounds as there are ranges in any case.
    The driver gets a row for each range. Rows without a rank or a time are left out.
    """
    names = [f.split()[0] for f in STATUS.split(", ")]
    rows = statuses.where("rank is not null and ts is not null").select(*names, F.lit(False).alias("_state"), F.lit(None).cast("double").alias("_at"))
    if state is not None:
        before = state.select(*(F.col(c) if c in (*FIELDS, "rank") else F.lit(None).alias(c) for c in names), F.lit(True).alias("_state"), F.col("at").alias("_at"))
        rows = rows.unionByName(before.withColumns({"event_id": F.lit(None).cast("long"), "ts": F.lit(None).cast("timestamp")}).select(*rows.columns))
    dealt = dealt_by_range(rows, per_task, F.col("rank"), F.col("_state").desc(), F.col("ts"), F.col("event_id"))

    def ordered(d: pd.DataFrame) -> pd.DataFrame:
        return d.sort_values(["rank", "_state", "ts", "event_id"], ascending=[True, False, True, True])

    def ends(entries: dict[int, tuple]):
        def run(d: pd.DataFrame) -> pd.DataFrame:
            b, d = int(d["_b"].iloc[0]), ordered(d)
            _, found = _walk(d, entries.get(b), min_gap_s)
            return pd.DataFrame([(b, int(d["rank"].iloc[0]), *(found[-1] if found else (int(d["rank"].iloc[-1]), *[None] * len(FIELDS), None)))], columns=["b", "first", "rank", *FIELDS, "at"])

        return run

    entries: dict[int, tuple] = {}
    known: dict[int, tuple] = {}
    again = dealt
    while True:
        for r in again.groupBy("_b").applyInPandas(ends(entries), f"b int, first long, rank long, {_STATE}").collect():
            known[r["b"]] = tuple(r)[1:]
        wrong = {}
        order = sorted(known)
        for b, after in zip(order, order[1:]):
            _, rank, *own = known[b]
            entry = (rank, *own) if rank == known[after][0] and own[-1] is not None else None
            if entry is not None and entries.get(after) != entry:
                wrong[after] = entry
        if not wrong:
            break
        entries |= wrong
        again = dealt.where(F.col("_b").isin(*wrong))

    def emit(d: pd.DataFrame) -> pd.DataFrame:
        d = ordered(d)
        flags, found = _walk(d, entries.get(int(d["_b"].iloc[0])), min_gap_s)
        out = d[flags].assign(_end=False, at=float("nan"))
        last = pd.DataFrame(found, columns=["rank", *FIELDS, "at"]).assign(_end=True, event_id=None, ts=pd.NaT)
        return pd.concat([out, last])[[*names, "at", "_end", "_b"]] if len(out) and len(last) else (out if len(out) else last.assign(_b=0))[[*names, "at", "_end", "_b"]].assign(_b=int(d["_b"].iloc[0]))

    folded = written(dealt.groupBy("_b").applyInPandas(emit, f"{STATUS}, at double, _end boolean, _b int"), "folded")
    discard(dealt)
    changes = folded.where("not _end").select(*names)
    last = folded.where("_end").groupBy("rank").agg(F.max_by(F.struct(*FIELDS, "at"), "_b").alias("s")).select("rank", "s.*")
    return changes, last


def status_changes_batch(statuses: DataFrame, min_gap_s: float = 0.1) -> DataFrame:
    """The batch twin of status_changes, by ranges. With a negative gap every change is emitted."""
    return changes_by_ranges(statuses, min_gap_s)[0]


def follow_changes(stream: DataFrame, path: str, checkpoint: str, min_gap_s: float = 0.1):
    """A running query that appends the changes of a stream of STATUS under path/changes, by batch, and keeps each rank's state under path/state.

    A batch reads the state that the one before it wrote and writes its own folders as a whole, so one that is run again after a failure gives the
    same; its rows are folded by ranges, however many of them one rank has.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = None if number == 0 else spark.read.parquet(f"{path}/state/batch={number - 1}")
        changes, last = changes_by_ranges(batch, min_gap_s, state)
        changes.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        last.write.mode("overwrite").parquet(f"{path}/state/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stop_on_crash(stream: DataFrame, path: str, checkpoint: str, wait: float = 0.2, **trigger) -> DataFrame:
    """Follows a stream of STATUS up to its first error, stops the query then, and returns that row (none if the stream ends without one).

    Written under path/statuses are the rows of every batch, of the batch with the error those up to it by time and event, and of no later
    one; the row itself under path/crash. Both are whole or not there: a batch that is run again writes the same, and
    one that starts while the query is being stopped sees the crash and writes nothing.
    """
    crash = f"{path}/crash"
    stopped = threading.Event()

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = recorded(spark, crash)
        if found is not None and found["batch"] < number:
            stopped.set()
            return
        held = written(batch, "statuses")
        first = first_crash(held).collect()
        up_to = held
        if first:
            ts, event = F.lit(first[0]["ts"]), F.lit(first[0]["event_id"])
            up_to = held.where((F.col("ts") < ts) | (F.col("ts") == ts) & (F.col("event_id") <= event))
        up_to.write.mode("overwrite").parquet(f"{path}/statuses/batch={number}")
        if first:
            first_crash(held).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(crash)
            stopped.set()
        discard(held)

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    while not stopped.is_set() and not query.awaitTermination(wait):
        pass
    query.stop()
    if query.exception() is not None and not stopped.is_set():
        raise query.exception()
    spark = stream.sparkSession
    return spark.createDataFrame([], STATUS) if recorded(spark, crash) is None else spark.read.parquet(crash).drop("batch")


def recorded(spark: SparkSession, crash: str) -> Row | None:
    """The crash that is written down, if one is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{crash}/_SUCCESS")
    return spark.read.parquet(crash).first() if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None
