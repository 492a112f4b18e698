"""Text expressions: tokens, phrases, token estimates, search text, titles, credentials. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes of tokens.
DENSE = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}"
WORD = r"_0-9a-z\x{c0}-\x{24f}"
# Fixed value: the narrower class of characters that count 0.6 tokens in the estimate.
COSTLY = r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7a3}"
BLANK = r"[ \t\n\x{0b}\f\r]+"


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"([{DENSE}]+|[{WORD}]+)"), 1)


def _windows(run: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.substr(run, i, F.lit(n)))


def tokens(text: Column) -> Column:
    """Words whole, runs of dense scripts as overlapping pairs (a single character stays); null gives null."""
    return F.flatten(
        F.transform(
            _runs(text),
            lambda r: F.when(r.rlike(f"^[{DENSE}]") & (F.length(r) > 1), _windows(r, 2)).otherwise(F.array(r)),
        )
    )


def phrases(text: Column) -> Column:
    """Phrases of a full-text query: words whole; dense runs of 3 and more as triples, and whole above 3."""
    dense = lambda r: r.rlike(f"^[{DENSE}]")
    none = F.array().cast("array<string>")
    each = F.transform(
        _runs(text),
        lambda r: F.when(~dense(r), F.array(r))
        .when(F.length(r) < 3, none)
        .when(F.length(r) == 3, F.array(r))
        .otherwise(F.concat(_windows(r, 3), F.array(r))),
    )
    return F.array_sort(F.array_distinct(F.flatten(each)))


def token_estimate(text: Column) -> Column:
    """Tokens a text will take, by character class; 0 for the empty text, else at least 1."""
    costly = F.length(F.regexp_replace(text, f"[^{COSTLY}]", ""))
    cost = F.round((costly * 12 + (F.length(text) - costly) * 5) / 20.0, 0).cast("bigint")
    return F.when(text == "", F.lit(0).cast("bigint")).otherwise(F.greatest(cost, F.lit(1).cast("bigint")))


#: White space of any script.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def one_line(text: Column) -> Column:
    """White space made single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def search_text(
    canonical: Column, injection: Column, body: Column, tags: Column, kind: Column, ident: Column
) -> Column:
    """What a record is searched by: its non-empty parts, one below the other."""
    parts = F.array(canonical, injection, body, F.array_join(F.coalesce(tags, F.array()), " "), kind, ident)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


def title(body: Column, injection: Column, canonical: Column, ident: Column) -> Column:
    """The first heading of the body, else the first non-empty of the summaries and the id."""
    heading = F.trim(F.regexp_extract(body, r"(?m)^[ \t]*#+[ \t]*(.*?)[ \t\r]*$", 1))
    full = lambda c: F.when(c != "", c)
    return F.coalesce(full(heading), full(injection), full(canonical), ident)


def expired(value: Column, day: Column) -> Column:
    """Whether an exact `YYYY-MM-DD` lies before `day`; anything else never expires."""
    exact = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))
    return F.coalesce(exact < day, F.lit(False))


def credential(text: Column) -> Column:
    """Whether a line looks like a credential: a key with a value, a bearer header, a private key's banner."""
    line = r"(?m)^[ \t]*(?:api_key|access_token|client_secret|password)[ \t]*[=:]"
    low = F.lower(text)
    return low.rlike(line) | low.rlike(r"authorization: bearer ") | low.rlike(r"-----begin[^\n]*private key")
