"""Structured Streaming jobs over frames, reads and gate events; each equals its batch form over the same rows.

``streamed`` is a view over a table's files read as a stream, so the table is not copied. ``gathered`` takes such a stream, or writes rows of a
batch view out as the files of a feed, applies a job and writes every batch to its own folder of the checkpoint folder, so a batch
that runs again replaces its own rows. Votes and averages put rows that come late in order within ``delay`` (``stateful.Reordered``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.folds import GATE_ROWS, STATES, Gate, gate_rows, gate_slices
from ..sources.shared import folder, written
from ..sources.views import view
from .stateful import STORE, Periods, Reordered


#: Keys of the state of lanes: a processor is called once a batch for each that has rows, and holds its lanes' rows of the batch.
BUCKETS = 2048


def bucketed(rows: DataFrame) -> GroupedData:
    """The rows by the bucket of their lane."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("lane"), F.lit(BUCKETS))).groupBy("bucket")


def streamed(spark: SparkSession, sf_dir: str, name: str, files: int | None = None) -> DataFrame:
    """The view as a stream of the folder's ``events`` files, its other tables as they are; ``files``: so many at a time at most."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    reader = spark.readStream.schema(schema)
    feed = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/events.parq*")
    return view(spark, sf_dir, name, {"events": feed})


def gathered(spark: SparkSession, source: DataFrame, job: Callable[[DataFrame], DataFrame], mode: str, name: str, files: int | None = None, at: str | None = None) -> DataFrame:
    """The rows that the job gave over all batches, with the number of their batch. The source's rows are written as a
    stream's input: one after the other in ``files`` files by time, each a batch, or as they are, all in one batch at any size:
    files of several batches would not follow time, and rows behind the watermark would be lost. A stream is taken as it comes."""
    at = at or folder(spark, name)
    return batches_of(job(source if source.isStreaming else fed(source, at, files)), mode, at)


def fed(source: DataFrame, at: str, files: int | None) -> DataFrame:
    """The rows as a stream, as ``gathered`` says."""
    if files:
        source = written(source, f"{at}/feed")  # cut from there, so the view is computed once
        time = F.col("ts") if dict(source.dtypes)["ts"] == "bigint" else F.unix_micros(F.col("ts").cast("timestamp"))
        cuts = source.agg(F.percentile_approx(time, [i / files for i in range(1, files)])).first()[0] or [0]
        for i in range(len(cuts) + 1):
            part = (F.lit(True) if i == 0 else time > cuts[i - 1]) & (F.lit(True) if i == len(cuts) else time <= cuts[i])
            source.where(part).coalesce(1).write.mode("append").parquet(f"{at}/input")
    else:
        source.write.parquet(f"{at}/input")
    reader = source.sparkSession.readStream.schema(source.schema)
    return (reader.option("maxFilesPerTrigger", 1) if files else reader).parquet(f"{at}/input")


def batches_of(rows: DataFrame, mode: str, at: str) -> DataFrame:
    """The rows of a stream until its input ends, each batch in its own folder, with the number of the batch."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    conf, store = rows.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(store)
    conf.set(store, STORE)  # a stream takes the settings of its start
    try:
        stream = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(keep).trigger(availableNow=True).start()
    finally:
        conf.set(store, before)
    stream.awaitTermination()
    try:
        return rows.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, batch int").parquet(f"{at}/rows")
    except Exception as e:  # an empty input makes no batch and no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return rows.sparkSession.createDataFrame([], rows.schema.add("batch", "int"))


def timed(df: DataFrame) -> DataFrame:
    """Event time as an instant, as watermarks need it."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_gate_source(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """event_id, lot, lane, source, ts, kind: every gate event of the folder's ``events`` files, read as a stream by an explicit schema,
    each once. What ``stream_latest`` does with them drops the old frames of a lane. files: read at most so many at a time."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
    reader = spark.readStream.schema(schema)
    events = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{sf_dir}/events.parq*").where("event_type <> 'error'")
    kind = F.when(F.col("event_type").isin("signup", "view"), "entry").otherwise("exit").alias("kind")
    rows = events.select("event_id", (F.col("user_id") % 5).alias("lot"), F.col("user_id").alias("lane"), (F.col("user_id") % 3).alias("source"), "ts", kind)
    return batches_of(rows, "append", folder(spark, "source")).drop("batch")


def stream_latest(frames: DataFrame, files: int | None = None) -> DataFrame:
    """lane, event_id of the newest frame of each lane; older ones are dropped."""
    job = lambda s: s.groupBy("lane").agg(F.max(F.struct("ts", "event_id")).alias("top"))
    found = gathered(frames.sparkSession, frames.select("lane", "ts", "event_id"), job, "update", "latest", files)
    return found.groupBy("lane").agg(F.max("top").alias("top")).select("lane", "top.event_id")


def stream_fps(frames: DataFrame, files: int | None = None) -> DataFrame:
    """lane, second, frames."""
    job = lambda s: timed(s).withWatermark("ts", "1 day").groupBy("lane", F.window("ts", "1 second")).agg(F.count("*").alias("frames"))
    found = gathered(frames.sparkSession, frames.select("lane", "ts"), job, "update", "fps", files)
    return found.groupBy("lane", F.col("window.start").cast("timestamp_ntz").alias("second")).agg(F.max("frames").alias("frames"))


def camera_periods(frames: DataFrame, gap: int, delay: str, files: int | None) -> DataFrame:
    """lane, up_from, up_to, frames, down_from (the end of the lane's period before). Periods that the watermark has closed are rows of the
    stream; those that are open where the input ends are read from the stream's state."""
    spark, at = frames.sparkSession, folder(frames.sparkSession, "health")
    names = ["up_from", "up_to", "frames", "down_from"]

    def job(rows: DataFrame) -> DataFrame:
        rows = timed(rows).dropna(subset=["lane", "ts"]).withWatermark("ts", delay)
        rows = rows.select(F.col("lane").cast("long").alias("lane"), "ts", F.unix_micros("ts").alias("at"))
        periods = Periods(gap * 1_000_000)
        return bucketed(rows).transformWithStateInPandas(periods, Periods.FIELDS, "Append", "EventTime")

    closed = gathered(spark, frames.select("lane", "ts"), job, "append", "health", files, at).select("lane", *names)
    state = spark.read.format("statestore").option("stateVarName", "open").load(f"{at}/state")
    still = state.select(*[F.col(f"list_element.{n}").alias(n) for n in ("lane", *names)])
    instant = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return closed.unionByName(still).select("lane", *[F.col(n) if n == "frames" else instant(n) for n in names])


def stream_camera_health(frames: DataFrame, gap: int = 21_600, delay: str = "1 hour", files: int | None = None) -> DataFrame:
    """lane, up_from, up_to, frames for each period in which frames follow each other within ``gap`` seconds."""
    return camera_periods(frames, gap, delay, files).drop("down_from")


def stream_camera_outages(frames: DataFrame, gap: int = 21_600, delay: str = "1 hour", files: int | None = None) -> DataFrame:
    """lane, down_from (the last frame before), down_to (the first after) for each time without a frame for ``gap`` seconds or more."""
    outages = camera_periods(frames, gap, delay, files).where("down_from IS NOT NULL")
    return outages.select("lane", "down_from", F.col("up_from").alias("down_to"))


def stream_occupancy(events: DataFrame, files: int | None = None, capacity: int = 500) -> DataFrame:
    """lot, current, capacity, pct (one decimal): plates whose newest event is an entry, kept for each plate as events come."""
    job = lambda s: s.groupBy("lot", "plate").agg(F.max(F.struct("ts", "event_id", "kind")).alias("top"))
    found = gathered(events.sparkSession, events.select("lot", "plate", "ts", "event_id", "kind"), job, "update", "occupancy", files)
    now = found.groupBy("lot", "plate").agg(F.max("top").alias("top"))
    lots = now.groupBy("lot").agg(F.count_if(F.col("top.kind") == "entry").alias("current"))
    return lots.select("lot", "current", F.lit(capacity).cast("long").alias("capacity"), F.round(100.0 * F.col("current") / max(capacity, 1), 1).alias("pct"))


def reordered(rows: DataFrame, processor: Reordered, schema: str, delay: str, name: str, files: int | None) -> DataFrame:
    """The last answer of each id. rows: lane, ts, then the processor's row."""

    def job(stream: DataFrame) -> DataFrame:
        stream = timed(stream).dropna(subset=["lane", "ts"]).withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
        return bucketed(stream).transformWithStateInPandas(processor, schema, "Update", "EventTime")

    found = gathered(rows.sparkSession, rows, job, "update", name, files)
    first, *others = processor.answer
    last = found.groupBy(first).agg(F.max_by(F.struct(*others), "batch").alias("last"))
    return last.select(first, "last.*")


def stream_vote(reads: DataFrame, width: int = 5, least: int = 3, files: int | None = None, delay: str = "1 day") -> DataFrame:
    """event_id, lane, stable for every read that isn't empty; a row whose ``control`` is 'clear' empties the lane's votes. Reads come
    in any order within ``delay``; event_id tells them apart."""

    def vote(held: list[tuple], row: tuple) -> tuple[list[tuple], tuple | None]:
        raw, control = row[2:]
        if control == "clear":
            return [], None
        if not raw:
            return held, None
        held = [*held, (raw,)][-width:]
        top = max(held, key=lambda v: (held.count(v), -held.index(v)))
        return held, (top[0] if len(held) >= least and 2 * held.count(top) >= len(held) else None,)

    if "control" not in reads.columns:
        reads = reads.withColumn("control", F.lit(None).cast("string"))
    processor = Reordered(vote, "at long, event_id long, raw string, control string", "raw string", ["event_id", "lane", "stable"])
    rows = reads.select("event_id", F.col("lane").cast("long").alias("lane"), "ts", "raw", "control")
    return reordered(rows, processor, "event_id long, lane long, stable string", delay, "vote", files)


def stream_mode_reset(reads: DataFrame, files: int | None = None) -> DataFrame:
    """event_id, lane, stable: the votes of ``stream_vote`` where switching between entry and exit, a row whose ``control`` is 'clear',
    makes a lane start anew."""
    return stream_vote(reads, files=files)


def stream_embedding_avg(faces: DataFrame, width: int = 3, files: int | None = None, delay: str = "1 day") -> DataFrame:
    """image_id, lane, avg for every face with a quality; a row whose ``control`` is 'clear' forgets the lane's faces. Faces come
    in any order within ``delay``; image_id tells them apart."""

    def average(held: list[tuple], row: tuple) -> tuple[list[tuple], tuple | None]:
        quality, face, control = row[2:]
        if control == "clear":
            return [], None
        if quality is None or quality != quality or face is None:
            return held, None
        held = [*held, (float(quality), [float(x) for x in face])][-width:]
        return held, (Gate.mean(held),)

    if "control" not in faces.columns:
        faces = faces.withColumn("control", F.lit(None).cast("string"))
    fields = "at long, image_id long, quality double, embedding array<double>, control string"
    processor = Reordered(average, fields, "quality double, embedding array<double>", ["image_id", "lane", "avg"])
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    rows = faces.select("image_id", F.col("lane").cast("long").alias("lane"), "ts", F.col("quality").cast("double").alias("quality"), vector, "control")
    return reordered(rows, processor, "image_id long, lane long, avg array<double>", delay, "average", files)


def stream_gate(frames: DataFrame, capacity: int = 500, files: int | None = None) -> DataFrame:
    """event_id, lot, plate, code of entries and exits; one state for each lot, since success clears what was voted. A row of the
    kind 'clear' switches the lot's mode: reads and faces of all its lanes are forgotten, vehicles stay inside."""
    spark, at = frames.sparkSession, folder(frames.sparkSession, "gate")
    rows = gate_rows(frames)
    if not rows.isStreaming:
        rows = fed(rows, at, files)
    answers = StructType.fromDDL(GATE_ROWS)

    def keep(batch: DataFrame, number: int) -> None:
        """A batch goes on from the states of the one before; run again, it finds the same states and replaces its own rows."""
        before = f"{at}/done/batch={number - 1}"
        held = spark.read.schema(STATES).parquet(f"{before}/states") if number else None
        found, states = gate_slices(batch, folder(spark, f"gate-{number}"), capacity, held)
        found.write.mode("overwrite").parquet(f"{at}/done/batch={number}/answers")
        states.write.mode("overwrite").parquet(f"{at}/done/batch={number}/states")
        numbers.append(number)

    numbers: list[int] = []
    rows.writeStream.option("checkpointLocation", f"{at}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    if not numbers:  # an empty input makes no batch
        return spark.createDataFrame([], answers)
    return spark.read.schema(answers).parquet(*[f"{at}/done/batch={n}/answers" for n in numbers])
