"""Records as Markdown files: a header of `key: value` lines between `---` lines, then the body.

Encoding is one JVM expression; decoding splits header and body in the JVM and reads the header's lines as a
map, so both run inside scans and writes of any size. Values are JSON, so every string survives a round trip.

Defined results: null fields are left out of the header and come back as null; a text without a header is
all body; unknown keys go to `extra`; lines that are no `key: value` are ignored; a null text gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header keys in the order they are written, with their types.
FIELDS = (
    ("id", "string"), ("type", "string"), ("source", "string"), ("strength", "bigint"), ("created", "string"),
    ("last_accessed", "string"), ("access_count", "bigint"), ("tags", "array<string>"), ("links", "array<struct<id:string,rel:string>>"),
    ("canonical_summary", "string"), ("injection_summary", "string"), ("status", "string"), ("expires", "string"),
)


def encode(df: DataFrame) -> Column:
    """The record's file content."""
    lines = []
    for name, kind in FIELDS:
        value = F.to_json(F.struct(F.col(name).alias("v")))
        # {"v":...} without its shell; a null field makes an empty object.
        lines.append(F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}: "), F.expr(f"substring(to_json(struct(`{name}` as v)), 6, length(to_json(struct(`{name}` as v))) - 6)"))))
    if "extra" in df.columns:
        extra = F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat(F.lit("x-"), e["key"], F.lit(": "), F.to_json(F.array(e["value"]))))
        rest = F.when(F.size("extra") > 0, F.array_join(extra, "\n"))
        lines.append(rest)
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.coalesce("body", F.lit("")))


def decode(files: DataFrame, content: str = "content") -> DataFrame:
    """The columns of `files` but `content`, and the record's fields, `extra` and `body`."""
    c = F.col(content)
    headed = c.startswith("---\n") & (F.instr(c, "\n---\n") > 0)
    end = F.instr(c, "\n---\n")
    header = F.when(headed, F.substr(c, F.lit(5), end - 5))
    body = F.when(headed, F.substr(c, end + 5)).otherwise(c)
    kept = F.filter(F.split(header, "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+: "))
    pairs = F.map_from_entries(
        F.array_distinct(F.transform(kept, lambda x: F.struct(F.substring_index(x, ": ", 1), F.substr(x, F.instr(x, ": ") + 2))))
    )
    keep = [F.col(x) for x in files.columns if x != content]
    df = files.select(*keep, pairs.alias("_h"), body.alias("body"))
    fields = [
        F.from_json(F.concat(F.lit('{"v":'), F.try_element_at("_h", F.lit(n)), F.lit("}")), f"v {t}")["v"].alias(n) for n, t in FIELDS
    ]
    own = F.map_filter("_h", lambda k, v: k.startswith("x-"))
    extra = F.transform_values(
        F.transform_keys(own, lambda k, v: F.substring(k, 3, 1_000)), lambda k, v: F.from_json(v, "array<string>")[0]
    )
    return df.select(*keep, *fields, extra.alias("extra"), "body")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files below `path`: path, size and the record's fields; archived by the folder's name."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
    )
    return decode(files).withColumn("archived", F.col("path").contains("/archive/"))
