"""Session transcripts as their hosts write them, line by line, and the turns they hold.

Five formats are told apart by the first line that decides: four kinds of JSON lines and marked plain text. Formats
are found and lines read by JVM expressions, so transcripts of any length are split over tasks; only in plain text
does a turn go on over several lines, and there the lines' turn numbers come from running sums.

Lines are (transcript, line_no, line). Defined results: blank lines are nothing; lines of a JSON format that are no
JSON, hold no user's or assistant's text, or are the host's own (other channels, synthetic reminders) are left out;
texts are trimmed and empty ones left out; plain text before the first marker is left out, and a text without any
marker is one turn of the assistant; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import stripped
from palimpsest.operators.running import placed

# The formats' names and the markers of plain text.
FORMATS = ("claude-jsonl", "codex-jsonl", "grok-jsonl", "role-jsonl", "text")
MARKER = r"^\[(user|assistant)\] "


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines of transcript files below `path`; a transcript is named by its file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("transcript"), F.col("value").alias("line"))
    return lines.withColumn("line_no", F.monotonically_increasing_id())


def _at(path: str) -> Column:
    return F.get_json_object("line", path)


def formats(lines: DataFrame) -> DataFrame:
    """transcript, format: by its first line that decides; undecided transcripts are text."""
    full = lines.where(stripped(F.col("line")) != "")
    decided = (
        F.when(_at("$").isNull() | ~F.ltrim("line").rlike(r"^[\[{]"), "text")
        .when(_at("$.message").startswith("{"), "claude-jsonl")
        .when((_at("$.type") == "response_item") & (_at("$.payload.type") == "message"), "codex-jsonl")
        .when(_at("$.type").isin("user", "assistant") & _at("$.content").isNotNull(), "grok-jsonl")
        .when(_at("$.role").isNotNull() & _at("$.text").isNotNull(), "role-jsonl")
    )
    marked = full.withColumn("_f", decided)
    first = F.min(F.when(F.col("_f").isNotNull(), F.struct("line_no", "_f")))["_f"]
    return marked.groupBy("transcript").agg(F.coalesce(first, F.lit("text")).alias("format"))


def _blocks(path: str) -> Column:
    """A content's text: itself, or that of its text blocks, one below the other."""
    listed = F.from_json(_at(path), "array<struct<type:string,text:string>>")
    texts = F.transform(
        F.filter(listed, lambda b: b["type"].isin("text", "input_text", "output_text") & b["text"].isNotNull()), lambda b: b["text"]
    )
    return F.when(_at(path + "[*]").isNotNull(), F.array_join(texts, "\n")).otherwise(_at(path))


def turns(lines: DataFrame) -> DataFrame:
    """transcript, format, line_no, role, text: the turns of transcripts of all formats."""
    known = lines.join(formats(lines).withColumnRenamed("transcript", "_t"), F.col("transcript").eqNullSafe(F.col("_t"))).drop("_t")
    f = F.col("format")
    other = (F.coalesce(_at("$.payload.channel"), F.lit("final")).isin("final", "commentary")) & (
        F.coalesce(_at("$.payload.recipient"), F.lit("all")) == "all"
    )
    codex = (_at("$.type") == "response_item") & (_at("$.payload.type") == "message")
    role = (
        F.when(f == "claude-jsonl", _at("$.message.role"))
        .when((f == "codex-jsonl") & codex, F.when((_at("$.payload.role") != "assistant") | other, _at("$.payload.role")))
        .when((f == "grok-jsonl") & _at("$.synthetic_reason").isNull(), _at("$.type"))
        .when(f == "role-jsonl", _at("$.role"))
    )
    text = (
        F.when(f == "claude-jsonl", _blocks("$.message.content"))
        .when(f == "codex-jsonl", _blocks("$.payload.content"))
        .when(f == "grok-jsonl", _blocks("$.content"))
        .otherwise(_at("$.text"))
    )
    json = known.where(f != "text").select("transcript", "format", "line_no", role.alias("role"), text.alias("text"))
    plain = known.where(f == "text").withColumn("_m", F.regexp_extract("line", MARKER, 1))
    numbered = placed(plain, ["transcript"], [F.col("line_no")], F.when(F.col("_m") != "", 1).otherwise(0))
    turn = F.col("before") + F.when(F.col("_m") != "", 1).otherwise(0)
    spoken = F.struct("line_no", F.regexp_replace("line", MARKER, "").alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(spoken)), lambda s: s["x"]), "\n")
    texts = (
        numbered.withColumn("_turn", turn)
        .groupBy("transcript", "format", "_turn")
        .agg(F.min("line_no").alias("line_no"), F.max("_m").alias("role"), joined.alias("text"))
    )
    unmarked = texts.groupBy("transcript").agg((F.max("_turn") == 0).alias("_only")).withColumnRenamed("transcript", "_t")
    texts = texts.join(unmarked, F.col("transcript").eqNullSafe(F.col("_t"))).where(F.col("_only") | (F.col("_turn") > 0))
    texts = texts.withColumn("role", F.when(F.col("_only"), "assistant").otherwise(F.col("role")))
    both = json.unionByName(texts.select(*json.columns)).where(F.col("role").isin("user", "assistant"))
    trimmed = stripped(F.col("text"))
    return both.withColumn("text", F.when(f == "text", F.col("text")).otherwise(trimmed)).where(trimmed != "")


def encode(rows: DataFrame, format_: Column) -> Column:
    """The line of a turn (role, text) in a format; text takes line ends as they are."""
    block = lambda kind: F.array(F.struct(F.lit(kind).alias("type"), F.col("text").alias("text")))
    message = lambda kind: F.struct(F.col("role").alias("role"), block(kind).alias("content"))
    payload = F.struct(F.lit("message").alias("type"), F.col("role").alias("role"), block("output_text").alias("content"))
    return (
        F.when(format_ == "claude-jsonl", F.to_json(F.struct(message("text").alias("message"))))
        .when(format_ == "codex-jsonl", F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload"))))
        .when(format_ == "grok-jsonl", F.to_json(F.struct(F.col("role").alias("type"), F.col("text").alias("content"))))
        .when(format_ == "role-jsonl", F.to_json(F.struct(F.col("role").alias("role"), F.col("text").alias("text"))))
        .otherwise(F.concat(F.lit("["), F.col("role"), F.lit("] "), F.regexp_replace("text", r"[\r\n]+", " ")))
    )
