"""Label and truth files as tables, and sinks of sessions, events and mismatches.

Lines are read with ``spark.read.text``; a line that doesn't parse is left out of the result (``label_line_counts`` and
``truth_line_counts`` tell how many and why). Empty folders give empty tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """stem, line_no (within the file), line of all label files of a folder. A file is one small row, so its lines keep their order."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    return files.select("stem", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def _label_parts(lines: DataFrame, classes: int) -> DataFrame:
    """stem, line_no, the parsed fields, and status: what keeps a line out ('blank', 'short' of five fields, 'unparsable', 'class' out of range), or 'kept'."""
    parts = lines.select("stem", "line_no", "line", F.split(F.trim("line"), r"\s+").alias("f"))
    number = lambda i: F.get("f", F.lit(i)).try_cast("double")
    rows = parts.select("*", F.get("f", F.lit(0)).try_cast("int").alias("cls_id"), *[number(i + 1).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))])
    odd = F.col("cls_id").isNull() | F.col("cx").isNull() | F.col("cy").isNull() | F.col("w").isNull() | F.col("h").isNull()
    status = (
        F.when(F.coalesce(F.col("line").rlike(r"^\s*$"), F.lit(True)), "blank").when(F.size("f") < 5, "short").when(odd, "unparsable")
        .when(~F.col("cls_id").between(0, classes - 1), "class").otherwise("kept")
    )
    return rows.withColumn("status", status)


def _labels(parts: DataFrame) -> DataFrame:
    kept = parts.where("status = 'kept'")
    return kept.select("stem", "line_no", "cls_id", F.substring(F.lit(ALPHABET), F.col("cls_id") + 1, F.lit(1)).alias("ch"), "cx", "cy", "w", "h")


def box_labels(lines: DataFrame, classes: int = 36) -> DataFrame:
    """stem, line_no, cls_id, ch, cx, cy, w, h of the lines with five numbers and a known class."""
    return _labels(_label_parts(lines, classes))


def observed_labels(lines: DataFrame, classes: int = 36) -> tuple[DataFrame, Observation]:
    """The rows of ``box_labels``, and a count of the lines of every status, taken in the same pass: it can be read once the rows have been
    written or counted. A sort of the rows reads lines twice and counts them twice: write them first."""
    counts = Observation("label lines")
    by_status = [F.count_if(F.col("status") == s).alias(s) for s in ("kept", "blank", "short", "unparsable", "class")]
    return _labels(_label_parts(lines, classes).observe(counts, *by_status)), counts


def label_line_counts(lines: DataFrame, classes: int = 36) -> DataFrame:
    """status, n: lines that are kept, and lines left out by what is wrong with them; a status without lines has no row."""
    return _label_parts(lines, classes).groupBy("status").agg(F.count("*").alias("n"))


def label_audit(labels: DataFrame, classes: int = 36) -> DataFrame:
    """cls_id, n, flag ('no data') for every class."""
    every = labels.sparkSession.range(classes).select(F.col("id").alias("cls_id"))
    counts = labels.groupBy(F.col("cls_id").cast("long").alias("cls_id")).agg(F.count("*").alias("n"))  # at most one row a class
    rows = every.join(F.broadcast(counts), "cls_id", "left").select("cls_id", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.withColumn("flag", F.when(F.col("n") == 0, "no data"))


def _truth_parts(lines: DataFrame) -> DataFrame:
    """line_no, name, text, status: 'blank', 'header' (in line 1), 'unsplit' (neither tab nor comma), 'nameless', or 'read'."""
    line = F.coalesce(F.trim("line"), F.lit(""))
    tab = F.instr(line, "\t")
    at = F.when(tab > 0, tab).otherwise(F.instr(line, ","))
    header = F.coalesce((F.col("line_no") == 1) & (tab == 0) & F.lower(line).contains("image") & F.lower(line).contains("text"), F.lit(False))
    rows = lines.select("line_no", line.alias("line"), at.alias("at"), header.alias("header"))
    rows = rows.select("*", F.trim(F.expr("substring(line, 1, at - 1)")).alias("name"), F.expr("substring(line, at + 1)").alias("text"))
    status = F.when(F.col("line") == "", "blank").when(F.col("header"), "header").when(F.col("at") == 0, "unsplit").when(F.col("name") == "", "nameless").otherwise("read")
    return rows.select("line_no", "name", "text", status.alias("status"))


def text_truth(lines: DataFrame) -> DataFrame:
    """name, stem, text (normalised) of lines 'name<TAB>text' or 'name,text'; the last line of a name counts, a header in line 1 doesn't."""
    last = _truth_parts(lines).where("status = 'read'").groupBy("name").agg(F.max_by("text", "line_no").alias("text"))
    return last.select("name", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), F.translate(F.upper(F.trim("text")), " -._", "").alias("text"))


def truth_line_counts(lines: DataFrame) -> DataFrame:
    """status, n: lines that are read, and lines left out by what is wrong with them."""
    return _truth_parts(lines).groupBy("status").agg(F.count("*").alias("n"))


def pair_samples(images: DataFrame, labels: DataFrame) -> DataFrame:
    """The images' stems that have a label of the same stem."""
    stems = images.select(F.col("line_no").cast("string").alias("stem")).distinct()
    return stems.join(labels.select("stem"), "stem", "left_semi")


def event_json(events: DataFrame) -> DataFrame:
    """event_id, json: one object of type and data for subscribers; null fields are left out."""
    return events.select("event_id", F.to_json(F.struct(F.col("kind").alias("type"), F.struct("plate", "lot").alias("data"))).alias("json"))


def committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all batches that the ledger names; those of a batch that was begun and not committed are passed over."""
    try:
        ledger = spark.read.schema("batch bigint").parquet(f"{path}/ledger").distinct()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(f"{path}/data")
    return rows.join(ledger, "batch", "left_semi").select(*schema.names)


def commit(rows: DataFrame, path: str, batch: int) -> None:
    """Writes the rows of a batch under its number, then its number into the ledger. A batch that the ledger names already is left alone,
    one that was begun is written anew, so a job that is killed and run again leaves each row once. Fits ``foreachBatch``."""
    spark = rows.sparkSession
    try:
        if not spark.read.schema("batch bigint").parquet(f"{path}/ledger").where(F.col("batch") == batch).isEmpty():
            return
    except AnalysisException as missing:  # the first batch
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    rows.write.mode("overwrite").parquet(f"{path}/data/batch={batch}")
    spark.createDataFrame([(batch,)], "batch bigint").coalesce(1).write.mode("append").parquet(f"{path}/ledger")


def sink_sessions(sessions: DataFrame, path: str, batch: int = 0) -> None:
    """Commits the finished sessions of a batch."""
    done = sessions.where("exit_ts IS NOT NULL")
    commit(done.repartition(F.to_date("exit_ts"), F.pmod(F.xxhash64("plate"), F.lit(16))), path, batch)


def sink_events(events: DataFrame, path: str, batch: int = 0) -> None:
    """Commits the events of a batch as JSON for subscribers."""
    commit(event_json(events), path, batch)


def sink_csv(rows: DataFrame, fields: list[str], path: str) -> None:
    """Writes the fields as CSV with a header."""
    rows.select(*fields).write.mode("overwrite").csv(path, header=True)


def sessions_read_back(sessions: DataFrame, path: str) -> DataFrame:
    """Commits finished sessions, twice as a job that is run again does, and reads what is committed."""
    for _ in range(2):
        sink_sessions(sessions, path)
    return committed(sessions.sparkSession, path, sessions.schema)


def csv_read_back(rows: DataFrame, path: str) -> DataFrame:
    """Writes all columns as CSV and reads the folder again."""
    sink_csv(rows, rows.columns, path)
    return rows.sparkSession.read.schema(rows.schema).csv(path, header=True)
