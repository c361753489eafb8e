"""Structured Streaming jobs. The transform is the batch one; only sources and sinks differ."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventlake.functions import regexes, timefmt
from eventlake.operators.framing import MAX_EVENT_BYTES, compiles
from eventlake.plans.process import Context, process, stream_rows
from eventlake.sources import commits
from eventlake.sources.writers import Sink, fan_out, write_dead_letters, write_lake

WATERMARK = "30 minutes"


def checkpoint_root(spark: SparkSession) -> str | None:
    """The shared folder of the cluster, when it names one."""
    return spark.conf.get("spark.checkpoint.dir", None)


def dedupe(df: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Drop redelivered events by id. State is bounded by the watermark on arrival time."""
    timed = df.withColumn("event_ts", timefmt.from_ns(F.col("received_at")))
    return timed.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["event_id"]).drop("event_ts")


# a live row carries the batch it came with; the newest of a key is the visible one
_LIVE = "key string, value string, batch long"
LEGS = ("lake", "dlq", "live")


def write_legs(rows: DataFrame, root: str, batch_id: int, extra: dict[str, Sink] | None = None) -> None:
    """Lake, dead letters and live rows of a batch, visible together once the batch is committed.

    Each leg lies in a folder of the batch, so a batch that is written again after a failure replaces itself. Extra sinks
    get the rows before the commit and are repeated with it.
    """
    write_lake(rows, f"{root}/lake/batch={batch_id}", mode="overwrite", cluster=False)
    write_dead_letters(rows, f"{root}/dlq/batch={batch_id}", mode="overwrite")
    live = stream_rows(rows).withColumn("batch", F.lit(batch_id).cast("long"))
    live.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/live/batch_id={batch_id}")
    if extra:
        fan_out(rows, lambda _: None, extra)
    commits.commit(rows.sparkSession, root, batch_id, {"legs": LEGS})


def committed(spark: SparkSession, root: str, leg: str) -> DataFrame | None:
    """Rows of a leg of all committed batches, none where nothing is committed. Left-overs of failed batches stay hidden."""
    name = "batch_id" if leg == "live" else "batch"
    paths = [f"{root}/{leg}/{name}={v}" for v in commits.versions(spark, root)]
    if not paths:
        return None
    reader = spark.read.schema(_LIVE) if leg == "live" else spark.read.option("basePath", f"{root}/{leg}")
    return reader.parquet(*paths)


def live_table(spark: SparkSession, root: str) -> DataFrame | None:
    """One row per event: the value of the newest batch that carried its key."""
    rows = committed(spark, root, "live")
    return rows and rows.groupBy("key").agg(F.max_by("value", "batch").alias("value"))


def run_events(
    lines: DataFrame,
    context: Callable[[], Context],
    root: str,
    checkpoint: str,
    extra: dict[str, Sink] | None = None,
    trigger: dict | None = None,
    processed: Callable[[DataFrame], None] | None = None,
) -> DataStreamWriter:
    """Lines to lake, dead letters and live rows under `root` (plus extra sinks). `context()` is asked per batch, which
    reloads packs.

    Late events are never dropped: they go to the partition of their own time. Read with `committed` and `live_table`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = process(batch, context()).persist()
        try:
            write_legs(rows, root, batch_id, extra)
            if processed:
                processed(rows)
        finally:
            rows.unpersist()

    stream = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True}))


# --- multi-line events -------------------------------------------------------------

_LINE_STATE = "buffer string, opened boolean, truncated boolean"


def multiline(
    lines: DataFrame, start: str, source: str = "source", text: str = "line", order: str = "line_no",
    max_bytes: int = MAX_EVENT_BYTES, idle_ms: int = 30_000,
) -> DataFrame:
    """Streaming form of join_lines: the open event of a source is state, flushed when the source idles.

    Start lines are found by Spark in the same pattern dialect as in batches; a missing or invalid pattern makes every
    line an event. The buffer never grows past `max_bytes`; what exceeds it only sets the flag. A run that ends
    (availableNow) keeps the last open event of each source in its checkpoint, for the next run.
    """
    if not compiles(start):
        size = F.octet_length(text)
        cut = F.substring(F.col(text).cast("binary"), 1, max_bytes).cast("string")
        return lines.select(source, F.when(size > max_bytes, cut).otherwise(F.col(text)).alias("payload"), (size > max_bytes).alias("truncated"))
    schema = f"{source} string, payload string, truncated boolean"

    class Open:
        """The event being gathered: its lines and their size in bytes."""

        def __init__(self, buffer: str | None, opened: bool, cut: bool):
            self.parts = [] if buffer is None else [buffer]
            self.size = 0 if buffer is None else len(buffer.encode())
            self.opened, self.cut = opened, cut

        def add(self, line: str) -> None:
            between = 1 if self.opened else 0
            self.opened = True
            room = max_bytes - self.size - between
            data = line.encode()
            if self.cut or len(data) > room:
                self.cut, data = True, data[: max(0, room)] if not self.cut else b""
                line = data.decode("utf-8", "ignore")
                if not line:
                    return
            self.parts.append(line)
            self.size += between + len(data)

        def text(self) -> str:
            return "\n".join(self.parts)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        event = Open(*(state.get if state.exists else (None, False, False)))
        if state.hasTimedOut:
            if event.opened:
                yield pd.DataFrame({source: [key[0]], "payload": [event.text()], "truncated": [event.cut]})
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(order)
        done: list[Open] = []
        for line, begins in zip(rows[text], rows["__begins"]):
            if event.opened and begins:
                done.append(event)
                event = Open(None, False, False)
            event.add(line)
        state.update((event.text(), event.opened, event.cut))
        state.setTimeoutDuration(idle_ms)
        if done:
            yield pd.DataFrame({source: key[0], "payload": [e.text() for e in done], "truncated": [e.cut for e in done]})

    lines = lines.withColumn("__begins", F.coalesce(regexes.matches(F.col(text), start), F.lit(False)))
    return lines.groupBy(source).applyInPandasWithState(
        step, schema, _LINE_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


# --- windows -----------------------------------------------------------------------


def throughput(df: DataFrame, ts: str = "event_ts", size: str = "3 seconds", slide: str | None = None, label: str | None = None) -> DataFrame:
    """Events per window, for streams (with a watermark on `ts`) and tables alike."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    keys = [w.alias("w")] + ([F.col(label)] if label else [])
    counts = df.groupBy(*keys).agg(F.count("*").alias("events"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *([label] if label else []), "events")


def quality_drops(events: DataFrame, minutes: int = 15, drop: float = 0.1) -> DataFrame:
    """Parsers whose mean quality fell by more than `drop` from one window to the next."""
    order = Window.partitionBy("lineage_parser_id").orderBy("start")
    rows = _means(events.withColumn("event_ts", timefmt.from_ns(F.col("event_observed_at"))), minutes, "event_ts")
    rows = rows.withColumn("previous", F.lag("quality").over(order))
    return rows.filter(F.col("quality") < F.col("previous") * F.lit(1 - drop))


def _means(events: DataFrame, minutes: int, ts: str) -> DataFrame:
    w = F.window(ts, f"{minutes} minutes")
    means = events.groupBy("lineage_parser_id", w.alias("w")).agg(F.avg("quality_score").alias("quality"))
    return means.select("lineage_parser_id", F.col("w.start").alias("start"), "quality")


_ALERT = "lineage_parser_id string, start timestamp, quality double, previous double"


def watch_quality(
    events: DataFrame, root: str, checkpoint: str, minutes: int = 15, drop: float = 0.1, delay: str = WATERMARK, trigger: dict | None = None
) -> DataStreamWriter:
    """Streaming form of quality_drops: a window is judged once, when the watermark has passed its end.

    The mean of each parser's last closed window is kept, one row per parser, so a window is compared with the one before
    it also where they close in different batches. Read the alerts with `quality_alerts`; a repeated batch replaces its own.
    """
    timed = events.withColumn("event_ts", timefmt.from_ns(F.col("event_observed_at"))).withWatermark("event_ts", delay)

    def write(closed: DataFrame, batch_id: int) -> None:
        spark = closed.sparkSession
        found = commits.latest(spark, root, batch_id)
        last = spark.read.schema(_ALERT).parquet(f"{root}/last/v={found[0]}") if found else spark.createDataFrame([], _ALERT)
        fresh = closed.select("lineage_parser_id", "start", "quality", F.lit(True).alias("__new"))
        order = Window.partitionBy("lineage_parser_id").orderBy("start")
        rows = fresh.unionByName(last.select("lineage_parser_id", "start", "quality", F.lit(False).alias("__new")))
        rows = rows.withColumn("previous", F.lag("quality").over(order)).persist()
        try:
            alerts = rows.filter(F.col("__new") & (F.col("quality") < F.col("previous") * F.lit(1 - drop)))
            alerts.select("lineage_parser_id", "start", "quality", "previous").write.mode("overwrite").parquet(f"{root}/alerts/v={batch_id}")
            newest = rows.groupBy("lineage_parser_id").agg(F.max_by(F.struct("start", "quality", "previous"), "start").alias("r"))
            newest.select("lineage_parser_id", "r.*").write.mode("overwrite").parquet(f"{root}/last/v={batch_id}")
            commits.commit(spark, root, batch_id, {})
        finally:
            rows.unpersist()

    stream = _means(timed, minutes, "event_ts").writeStream.outputMode("append").foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))


def quality_alerts(spark: SparkSession, root: str) -> DataFrame:
    paths = [f"{root}/alerts/v={v}" for v in commits.versions(spark, root)]
    return spark.read.schema(_ALERT).parquet(*paths) if paths else spark.createDataFrame([], _ALERT)


# --- raw references that cannot be read yet -----------------------------------------


REF = "event_id string, raw_segment_id string, raw_offset long, raw_length long, raw_sha256 string, received_at long"


def resolve_refs(refs: DataFrame, stored: DataFrame, now_ns, deadline_ns: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Join references with stored payloads: (readable, to retry, given up).

    Unreadable references wait in a retry table until their deadline; a segment with one reference
    past the deadline is given up as a whole. Nothing is dropped.
    """
    from eventlake.operators.integrity import read_by_ref

    read = read_by_ref(refs, stored)
    ok = read.filter(F.col("status") == "ok")
    rest = read.filter(F.col("status") != "ok").drop("payload", "status")
    expired = F.col("received_at") + F.lit(deadline_ns) < now_ns
    dead = rest.filter(expired).select("raw_segment_id").distinct()
    return (
        ok,
        rest.join(dead, "raw_segment_id", "left_anti"),
        rest.join(dead, "raw_segment_id", "left_semi"),
    )


def _step_refs(refs: DataFrame | None, stored: DataFrame, root: str, version: int, now_ns: int, deadline_ns: int, deliver: Callable[[DataFrame, int], None]) -> None:
    """One turn: new and waiting references are read; what is readable is delivered, what is too old is given up."""
    spark = stored.sparkSession
    found = commits.latest(spark, root, version)
    at = found and found[0]
    waiting = spark.read.schema(REF).parquet(f"{root}/waiting/v={at}") if found else spark.createDataFrame([], REF)
    lost = spark.read.schema(REF).parquet(*[f"{root}/gone/v={v}" for v in found[1]["gone"]]) if found and found[1]["gone"] else spark.createDataFrame([], REF)
    fields = [f.split()[0] for f in REF.split(", ")]
    todo = (refs.select(*fields).unionByName(waiting) if refs is not None else waiting).persist()
    try:
        # a segment that was given up once stays so: its references do not wait again
        hopeless = lost.select("raw_segment_id").distinct()
        ready, retry, gone = resolve_refs(todo.join(hopeless, "raw_segment_id", "left_anti").select(*fields), stored, F.lit(now_ns), deadline_ns)
        gone = gone.select(*fields).unionByName(todo.join(hopeless, "raw_segment_id", "left_semi").select(*fields))
        deliver(ready.drop("status"), version)
        retry.select(*fields).write.mode("overwrite").parquet(f"{root}/waiting/v={version}")
        gone.write.mode("overwrite").parquet(f"{root}/gone/v={version}")
        commits.commit(spark, root, version, {"gone": [*(found[1]["gone"] if found else []), version]})
    finally:
        todo.unpersist()


# references of a stream leave room for turns in between that only re-drive what waits
TURNS = 1_000


def run_refs(
    refs: DataFrame,
    stored: Callable[[], DataFrame],
    root: str,
    checkpoint: str,
    deliver: Callable[[DataFrame, int], None],
    now_ns: Callable[[], int],
    deadline_ns: int,
    trigger: dict | None = None,
) -> DataStreamWriter:
    """References to payloads; those that cannot be read yet wait in a table and are tried again with every batch.

    stored() gives the payloads as they are at that time. deliver(rows with payload, version) must replace what it wrote
    for the same version. A batch that is repeated starts from the state before it, so nothing is delivered or lost twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _step_refs(batch, stored(), root, batch_id * TURNS, now_ns(), deadline_ns, deliver)

    stream = refs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"availableNow": True}))


def redrive_refs(stored: DataFrame, root: str, deliver: Callable[[DataFrame, int], None], now_ns: int, deadline_ns: int) -> bool:
    """Try the waiting references without new ones, between the batches of run_refs; False where there was no batch yet."""
    found = commits.latest(stored.sparkSession, root)
    if found is None:
        return False
    if (found[0] + 1) % TURNS == 0:
        raise ValueError(f"{TURNS - 1} turns since the last batch: run the stream")
    _step_refs(None, stored, root, found[0] + 1, now_ns, deadline_ns, deliver)
    return True


def waiting_refs(spark: SparkSession, root: str) -> DataFrame:
    """References that still wait."""
    found = commits.latest(spark, root)
    return spark.read.schema(REF).parquet(f"{root}/waiting/v={found[0]}") if found else spark.createDataFrame([], REF)


def given_up_refs(spark: SparkSession, root: str) -> DataFrame:
    found = commits.latest(spark, root)
    return spark.read.schema(REF).parquet(*[f"{root}/gone/v={v}" for v in found[1]["gone"]]) if found else spark.createDataFrame([], REF)


def sync_index(spark: SparkSession, ledger_path: str, out_path: str, dt_from: str, dt_to: str) -> None:
    """Mirror the ledger of a day range into the segments table; run it on a schedule."""
    from eventlake.sources.readers import ledger, segments_by_day
    from eventlake.sources.writers import write_segments

    write_segments(segments_by_day(ledger(spark, ledger_path), dt_from, dt_to), out_path)
