"""Findings as models hand them in: a JSON list, or an object that holds one, somewhere in a text; or a Markdown block.

Defined results: a text without a readable list has no findings; findings of other types than the ones asked for, or
without a title or content, are left out; titles are cut to 80 characters, evidence to 200; importance is a whole
number from 0 to 100, also where it is written as a string, and 50 where it is none; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import stripped

# The lines that open a block of findings.
HEADERS = ("**Findings:**", "**Findings：**", "**新发现:**", "**新发现：**")
_FIELDS = ("type", "title", "content", "importance", "evidence")

_LIST = "array<struct<type:string,title:string,content:string,importance:string,evidence:string>>"


def payload(text: Column) -> Column:
    """What lies between the first opening and the last closing bracket of a list, both included."""
    begin = F.instr(text, "[")
    end = F.length(text) - F.instr(F.reverse(text), "]") + 1
    return F.when((begin > 0) & (F.instr(text, "]") > 0) & (end > begin), F.substr(text, begin, end - begin + 1))


def parsed(rows: DataFrame, text: str, types: Sequence[str]) -> DataFrame:
    """The columns of `rows` but `text`, and position, type, title, content, importance, evidence of each finding."""
    keep = [c for c in rows.columns if c != text]
    found = rows.select(*keep, F.posexplode(F.from_json(payload(F.col(text)), _LIST)).alias("position", "_f"))
    return _checked(found, keep, types)


def _checked(found: DataFrame, keep: list[str], types: Sequence[str]) -> DataFrame:
    clip = lambda c, n: F.substring(stripped(F.col(f"_f.{c}")), 1, n)
    number = F.when(F.col("_f.importance").rlike(r"^[+-]?\d{1,18}$"), F.col("_f.importance").try_cast("bigint"))
    out = found.select(
        *keep,
        "position",
        stripped(F.col("_f.type")).alias("type"),
        clip("title", 80).alias("title"),
        stripped(F.col("_f.content")).alias("content"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(number, F.lit(50)))).alias("importance"),
        F.coalesce(clip("evidence", 200), F.lit("")).alias("evidence"),
    )
    return out.where(F.col("type").isin(list(types)) & (F.col("title") != "") & (F.col("content") != ""))


def block(text: str) -> list[dict]:
    """The findings of one text's blocks, as written: `- key: value` lines below a header, each finding from its `type`
    on, `content: |` with the more indented lines that follow; the next bold line ends a block."""
    out: list[dict] = []
    now: dict = {}
    inside = content = False
    margin = 0

    def close() -> None:
        nonlocal now
        if now:
            lines = now.pop("lines", None)
            out.append({**now, **({"content": "\n".join(lines).rstrip()} if lines else {})})
        now = {}

    for line in text.lstrip("\ufeff").split("\n"):
        bare = line.strip()
        if bare in HEADERS:
            close()
            inside, content = True, False
            continue
        if not inside:
            continue
        if content:
            indent = len(line) - len(line.lstrip(" "))
            margin = margin or (indent if bare else 0)
            if not bare or (margin and indent >= margin):
                now.setdefault("lines", []).append(line.rstrip("\r")[margin:] if bare else "")
                continue
            content = False
        if bare.startswith("**"):
            close()
            inside = False
            break
        key, colon, value = bare[1:].partition(":")
        key, value = key.strip(), value.strip()
        if not bare.startswith("-") or not colon:
            continue
        if key == "type":
            close()
        if key == "content" and value == "|":
            content, margin = True, 0
        elif key in _FIELDS and key != "content":
            now[key] = value.strip("'\"")
    close()
    return out


def parsed_blocks(rows: DataFrame, text: str, types: Sequence[str]) -> DataFrame:
    """As `parsed`, from Markdown blocks."""
    keep = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(i, k, f) for i, t in enumerate(pdf["_text"]) if isinstance(t, str) for k, f in enumerate(block(t))]
            out = {c: [pdf[c].iat[i] for i, _, _ in found] for c in keep}
            out["position"] = [k for _, k, _ in found]
            out |= {f"_{c}": [f.get(c) for _, _, f in found] for c in _FIELDS}
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()})

    kept = rows.select(*keep, F.col(text).cast("string").alias("_text"))
    types_ = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    read = kept.mapInPandas(run, f"{types_}, position int, " + ", ".join(f"_{c} string" for c in _FIELDS))
    return _checked(read.withColumn("_f", F.struct(*[F.col(f"_{c}").alias(c) for c in _FIELDS])), keep, types)
