"""Splitting texts above a token limit into overlapping pieces, cut at natural boundaries.

A text is a sequence of tokens. A piece is a run of at most `limit` tokens, and the next one starts
`overlap` tokens before the end of the last. Every position where a character begins may end a piece; it
has a grade: end of a paragraph, line, sentence, clause, word, or none of these.

Pointer doubling: each end position is joined to its farthest legal successor, the end of the piece that
starts `overlap` tokens before it. Squaring that table gives the successors 2, 4, 8, ... pieces ahead, so
the cuts of all texts of a batch come out in as many steps as the longest text's piece count has binary
digits, instead of one step per piece.

The work is partitioned by rows; a text is one row, its tables are a few arrays of its token count.

Defined results: a null or empty text, or one within the limit, gives no rows (or one piece with
`keep_small`); a text without any break is cut between characters; where `overlap` tokens before a cut
lie inside a character, the next piece starts at the character's first token (up to three more shared
tokens); repeated ids give repeated rows; extra columns are ignored; an empty table gives an empty one.
Pieces whose own tokenization, cut loose from their neighbours, would exceed the limit are cut shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from palimpsest.llm.tokens import VOCABULARY, encoding, token_bytes

GRADES = ("character", "word", "clause", "sentence", "line", "paragraph")
#: A cut of a better grade is preferred if it leaves the piece at least this part of the limit.
LEAST_FILL = 0.5
#: Tokens that a cut inside a word can add at most to a piece tokenized on its own; such pieces are counted.
_SLACK = 16
_CHARS = 2_000_000  # characters whose tables are in memory at once

_SPACE, _NL = 32, 10


def boundaries(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte offset of `at` begins a character, and the grade of a cut there.

    `buf` is UTF-8 with at least four bytes of padding before offset 0 of the text.
    """
    cur, p1, p2, p3 = buf[at], buf[at - 1], buf[at - 2], buf[at - 3]
    whole = (cur & 0xC0) != 0x80
    grade = np.zeros(len(at), dtype=np.int8)
    blank = (cur == _SPACE) | (cur == _NL) | (cur == 9) | (cur == 13)
    before_blank = (p1 == _SPACE) | (p1 == _NL) | (p1 == 9) | (p1 == 13)
    grade[blank & ~before_blank] = 1
    wide = (p3 == 0xE3) & (p2 == 0x80) | (p3 == 0xEF) & (p2 == 0xBC)
    grade[(blank & ~before_blank & ((p1 == 44) | (p1 == 59) | (p1 == 58))) | (wide & ((p1 == 0x81) | (p1 == 0x8C) | (p1 == 0x9B) | (p1 == 0x9A)))] = 2
    ends = (p1 == 46) | (p1 == 33) | (p1 == 63)
    ends |= ((p1 == 34) | (p1 == 41) | (p1 == 39)) & ((p2 == 46) | (p2 == 33) | (p2 == 63))
    grade[(blank & ends) | ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x82)) | ((p3 == 0xEF) & (p2 == 0xBC) & ((p1 == 0x81) | (p1 == 0x9F)))] = 3
    grade[(p1 == _NL) & (cur != _NL) & (cur != 13)] = 4
    grade[(p1 == _NL) & (cur != _NL) & (cur != 13) & ((p2 == _NL) | ((p2 == 13) & (p3 == _NL)))] = 5
    return whole, np.where(whole, grade, -1).astype(np.int8)


def _last(ok: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For each position the last position up to it where `ok` holds, or the first of its text."""
    idx = np.where(ok, np.arange(len(ok)), -1)
    return np.maximum(np.maximum.accumulate(idx), base)


def cut(sizes: np.ndarray, whole: np.ndarray, grade: np.ndarray, limit: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """All cuts of several texts at once.

    `sizes`: positions (tokens + 1) of each text; `whole`, `grade`, `limit`: by position, texts one after
    the other. Returns the position of each cut and the position where the piece it ends starts.
    """
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    base = np.repeat(first, sizes)
    end = np.repeat(first + sizes - 1, sizes)
    pos = np.arange(len(base))
    aligned = _last(whole, base)
    begin = np.where(pos == base, base, aligned[np.maximum(pos - overlap, base)])  # where the piece after a cut starts
    reach = np.minimum(begin + limit, end)
    exact = whole & (pos - overlap > base) & whole[np.maximum(pos - overlap, base)]
    # Past this the next piece begins later than this one, even if it must go back within a character.
    onward = begin + overlap + 4
    succ = np.full(len(pos), -1, dtype=np.int64)
    least = np.maximum((limit * LEAST_FILL).astype(np.int64) + begin, onward)
    # The next piece should begin at a word as well.
    worded = exact & (grade[np.maximum(pos - overlap, base)] >= 1)
    for g in range(len(GRADES) - 1, 0, -1):
        for fit in (worded, exact):
            cand = _last(fit & (grade >= g), base)[reach]
            succ = np.where((succ < 0) & (cand >= least), cand, succ)
    for ok in (exact & (grade >= 1), exact, whole):
        cand = _last(ok, base)[reach]
        succ = np.where((succ < 0) & (cand >= onward), cand, succ)
    succ = np.where(succ < 0, reach, succ)
    succ = np.where(reach == end, end, succ)
    reached, table = first.copy(), succ
    while True:
        ahead = table[reached]
        new = np.unique(ahead[ahead > reached])
        new = new[~np.isin(new, reached)]
        if not len(new):
            break
        reached = np.concatenate((reached, new))
        table = table[table]
    cuts = np.sort(succ[reached[reached < end[reached]]])
    from_cut = np.sort(reached[reached < end[reached]])
    return cuts, begin[from_cut]


def _pieces(ids: list, texts: list[str], path: str, limit: int, overlap: int, keep_small: bool) -> list[tuple]:
    enc, width = encoding(path), token_bytes(path)
    out: list[tuple] = []
    work = []
    for i, t in zip(ids, texts):
        if not t or (not keep_small and len(t.encode("utf-8", "replace")) <= limit):
            continue
        toks = enc.encode_ordinary(t)
        if len(toks) > limit:
            work.append((i, t, np.asarray(toks, dtype=np.int64), limit))
        elif keep_small:
            out.append((i, 0, 0, len(t), len(toks), 0, "end", t))
    while work:
        raw = [t.encode("utf-8") for _, t, _, _ in work]
        buf = np.frombuffer(b"\x00\x00\x00\x00" + b"\x00\x00\x00\x00".join(raw) + b"\x00\x00\x00\x00", dtype=np.uint8)
        chars = np.cumsum((buf & 0xC0) != 0x80)
        sizes = np.array([len(x[2]) + 1 for x in work])
        start = 4 + np.concatenate(([0], np.cumsum([len(r) + 4 for r in raw])[:-1])).astype(np.int64)
        at = np.concatenate([s + np.concatenate(([0], np.cumsum(width[x[2]]))) for s, x in zip(start, work)])
        whole, grade = boundaries(buf, at)
        lim = np.repeat([x[3] for x in work], sizes)
        cuts, begins = cut(sizes, whole, grade, lim, overlap)
        edge = np.cumsum(sizes)
        doc = np.searchsorted(edge, cuts, side="right")
        first_char = chars[start]
        again: dict[int, int] = {}
        rows: dict[int, list[tuple]] = {}
        for d, a, b in zip(doc.tolist(), begins.tolist(), cuts.tolist()):
            i, t, toks, own = work[d]
            ca, cb = int(chars[at[a]] - first_char[d]), int(chars[at[b]] - first_char[d])
            piece, n = t[ca:cb], b - a
            last = b == edge[d] - 1
            if n > limit - (_SLACK if grade[a] < 1 or grade[b] < 1 else 2):
                loose = len(enc.encode_ordinary(piece))
                if loose > limit:
                    again[d] = max(again.get(d, 0), loose - limit)
            prev = rows.setdefault(d, [])
            shared = prev[-1][-1] - a if prev else 0
            prev.append((i, len(prev), ca, cb, n, shared, "end" if last else GRADES[max(grade[b], 0)], piece, b))
        out += [r[:-1] for d, rs in rows.items() if d not in again for r in rs]
        # A text with a piece that grew when cut loose is done again with that much less room.
        work = [(i, t, toks, max(own - again[d], overlap + 8)) for d, (i, t, toks, own) in enumerate(work) if d in again]
    return out


def split(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    limit: int = 512,
    overlap: int = 64,
    vocabulary: str = VOCABULARY,
    keep_small: bool = False,
) -> DataFrame:
    """Pieces of the texts above `limit` tokens.

    Returns key, piece_no, char_start, char_end, n_tokens, shared_tokens, cut_at, piece. char positions
    count Unicode characters from 0, the end is exclusive; shared_tokens are those shared with the piece
    before; cut_at is the grade of the piece's end.
    """
    if overlap < 0 or limit <= overlap + 4:
        raise ValueError("the limit must exceed the overlap by more than one character's tokens")
    names = ["key", "piece_no", "char_start", "char_end", "n_tokens", "shared_tokens", "cut_at", "piece"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lo, size = 0, 0
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            keys = pdf["key"].tolist()
            for hi in range(1, len(texts) + 1):
                size += len(texts[hi - 1])
                if size >= _CHARS or hi == len(texts):
                    yield pd.DataFrame(_pieces(keys[lo:hi], texts[lo:hi], vocabulary, limit, overlap, keep_small), columns=names)
                    lo, size = hi, 0

    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text"))
    out = rows.mapInPandas(
        run,
        f"key {key_type}, piece_no int, char_start int, char_end int, n_tokens int, shared_tokens int, cut_at string, piece string",
    )
    return out.withColumnRenamed("key", key)
