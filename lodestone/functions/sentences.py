"""Sentences of a text by a finite-state pass over its tokens.

States: at the start of a sentence, within it, and after a mark that may end it. Tokens: a blank line, white space, a
number with its stop, an abbreviation or initial with its stop, a word, a run of end marks, closing and opening marks,
citation marks, anything else. What decides:

- a blank line ends a sentence anywhere
- end marks with the closing marks and citation marks behind them end one before white space or the end of the text, but
  not within brackets, and single stops and ellipses not if a small letter follows
- the stop after an abbreviation or initial, and after a number at the start (1. like this), never does
- brackets that a blank line cuts off are closed by it

Spans are code points, half open, without white space at either end; together they hold all that is not white space.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from lodestone.functions.text import ABBREVIATIONS

START, WITHIN, ENDED = range(3)
_TOKEN = re.compile(
    r"(?P<para>\s*\n\s*\n\s*)|(?P<space>\s+)|(?P<list>\d+[.)](?=\s))|(?P<short>(?:" + "|".join(re.escape(a) for a in sorted(ABBREVIATIONS, key=len, reverse=True)) + r"|[^\W\d_])\.(?!\w))|(?P<cite>\[\d+(?:\s*,\s*\d+)*\])|(?P<end>[.!?…]+)"
    r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<quote>[\"'”’»])|(?P<word>\w+)|(?P<other>.)",
    re.S,
)


def spans(text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    state, begin, last, depth, mark, inner, spaced = START, 0, 0, 0, "", False, False
    at, size = 0, len(text)

    def close() -> None:
        nonlocal state, depth
        if state != START:
            out.append((begin, last))
        state, depth = START, 0

    while at < size:
        m = _TOKEN.match(text, at)
        kind, stop = m.lastgroup, m.end()
        if kind == "para":
            close()
            at, spaced = stop, False
            continue
        if kind == "space":
            spaced, at = True, stop
            continue
        if state == ENDED and spaced and kind != "cite":
            small = text[at].islower()
            if depth == 0 and not (small and (inner or mark in (".", "...") or mark[0] == "…")):
                close()
            else:
                state = WITHIN
        if state == START:
            begin, state = at, WITHIN
            if kind == "list":
                last, at, spaced = stop, stop, False
                continue
        if kind == "list":  # a number in the text: its stop counts, its bracket closes
            stop -= 1
        elif kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
        if kind == "end":
            state, mark, inner = ENDED, m[0], depth > 0
        elif not (state == ENDED and kind in ("close", "quote", "cite")):
            state = WITHIN
        last, at, spaced = stop, stop, False
    close()
    return out


@pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def sentence_spans(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in spans(t)])


def segmented(c: Column) -> Column:
    """The sentences of a text, in order; null for null."""
    return F.transform(sentence_spans(c), lambda x: F.substring(c, x["start"] + 1, x["end"] - x["start"]))
