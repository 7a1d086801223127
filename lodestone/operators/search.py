"""Which texts contain which passages: by each passage's rarest gram, with the texts joined last.

A gram is the hash of GRAM bytes, or of a whole passage that is shorter. Of a passage some grams at even distances are
looked at. One scan over the texts notes where any of them stands: a bitmap of bounded size, sent to all tasks, passes
over nearly all other places, and what it lets through is joined by the hash. Counts of these places tell each passage's
rarest gram, so an opening that many texts share costs no more than any other, and a passage with a gram that no text
has is gone. Only (text, passage) numbers go on from there; texts and passages come in at the end, to be verified.

Rows are known by a hash of all their columns, which is the same in every scan. Rows that are alike share it, and so
would rows whose hashes collide: both only mean that more pairs are verified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.work import Scratch

GRAM, LOOKED_AT, MOST_BITS = 16, 8, 1 << 27


def window_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n bytes from each place on."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    h, x = np.full(size, np.uint64(n)), data.astype(np.uint64)
    for k in range(n):
        h = (h ^ x[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _grams(quotes: DataFrame, quote: str, looked_at: int) -> DataFrame:
    """_q, n (bytes of the gram), off, _h."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ([], [], [], [])
            for q, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = np.frombuffer(v.encode(), np.uint8)
                n = min(len(data), GRAM)
                h = window_hashes(data, n)
                for at in sorted({int(x) for x in np.linspace(0, len(h) - 1, looked_at)}):
                    for c, x in zip(out, (q, n, at, int(h[at])), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["_q", "n", "off", "_h"])

    return quotes.select("_q", quote).mapInArrow(run, "_q long, n int, off long, _h long")


def _bitmap(hashes: DataFrame, most: int) -> np.ndarray:
    """A bit for each hash by its last bits; about 32 bits a hash, `most` at most."""
    bits = min(most, max(1 << 16, 1 << (32 * hashes.count()).bit_length()))
    at = F.col("_h").bitwiseAND(bits - 1)
    words = hashes.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_h & 63 as int))")).alias("b")).toArrow()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def quotes_in(docs: DataFrame, quotes: DataFrame, text: str, quote: str, *, looked_at: int = LOOKED_AT, most_bits: int = MOST_BITS) -> DataFrame:
    """Pairs (columns of both) whose text contains the quote; null and empty quotes stand in none."""
    spark = docs.sparkSession
    ws = Scratch(spark, "quotes")
    d = docs.withColumn("_d", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    q = quotes.filter(F.octet_length(quote) > 0).withColumn("_q", F.xxhash64(*(F.col(f"`{c}`") for c in quotes.columns)))
    grams = ws.keep("grams", _grams(q, quote, looked_at).distinct())
    sizes = [r.n for r in grams.select("n").distinct().collect()]  # GRAM numbers at most
    wanted = grams.select("_h").distinct()
    sent = spark.sparkContext.broadcast(_bitmap(wanted, most_bits))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, mask = sent.value, np.int64(len(sent.value) * 64 - 1)
        for b in batches:
            for row, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = np.frombuffer((v or "").encode(), np.uint8)
                found = [np.zeros(0, np.int64)]
                for n in sizes:
                    for k in range(0, len(data), 1 << 20):  # long texts in overlapping pieces
                        h = window_hashes(data[k : k + (1 << 20) + n - 1], n)
                        at = h & mask
                        found.append(h[(words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)) > 0])
                # how often a gram stands in one text doesn't matter
                h = np.unique(np.concatenate(found))
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), row, np.int64)), pa.array(h)], ["_d", "_h"])

    places = ws.keep("places", d.select("_d", text).mapInArrow(cut, "_d long, _h long").join(wanted, "_h", "left_semi"))
    often = places.groupBy("_h").agg(F.count("*").alias("often"))
    rarest = grams.join(often, "_h", "left").withColumn("often", F.coalesce("often", F.lit(0))).groupBy("_q").agg(F.min(F.struct("often", "off", "_h")).alias("g")).filter("g.often > 0").select("_q", "g._h")
    met = ws.keep("met", rarest.join(places, "_h").select("_d", "_q").distinct())
    return met.join(d, "_d").join(q, "_q").filter(F.contains(F.col(text), F.col(quote))).drop("_d", "_q")
