"""Operator 4: removal of repeated substrings by growing ranks over anchored positions.

A window is a LENGTH-byte string at its start position; a window is a repeat if an equal one starts earlier (smaller id, or
same document and smaller position). Bytes in repeats are removed.

Plain prefix doubling sorts all position rank pairs at each offset and so moves every byte's position several times.
This is the same scheme of ranks that grow from round to round until unique or past the threshold, but in three fixed
lengths (36, 93, 100 bytes) instead of doublings, and positions are grouped first (README has the reason and figures).
The window's anchor is the place of the smallest hash among its first SPAN 16-byte strings; it depends on the window's
content alone. Consecutive windows with one anchor form a run. Ranks then grow in three Spark rounds, each a sort or an
aggregation of (position, rank pair), and what is unique after a round leaves:

1. runs, by the pair (36 bytes from the anchor, all 100 to 163 bytes of the run). Runs whose 36 bytes are unique leave;
   of equal runs all but the first are repeats as a whole.
2. of firsts whose 36 bytes stand in different runs: pieces of up to 8 windows, by the pair (the 93 bytes that all 8 share,
   the up to 14 bytes around). Unique or repeated as in round 1.
3. of pieces whose 93 bytes stand in different pieces: single windows, by (93 bytes, the 7 bytes around that belong to the
   window): all 100 bytes, the threshold.

Ranks are 64-bit hashes of the strings. Equal strings fall together before they are shuffled, so a passage that is in a
third of all documents is one row per task.

Null text is empty: 0 bytes, nothing removed. Documents shorter than LENGTH keep all; texts of any length are read whole.
A null id orders before all others; rows that repeat an id order as they were scanned. An empty table gives no rows.
Other columns are not read; carried ones keep their names, and the operator's columns get the first free name.
Strings are equal by 64-bit hashes (runs by two of them); the bytes are not compared again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from lodestone.llm._common import Workspace, free_name, packed, slices, small_batches, table, utf8_of

LENGTH, GRAM, SPAN = 100, 16, 64
SHARED = LENGTH - SPAN  # bytes from the anchor that all windows of a run hold
PIECE = 8
CORE = LENGTH - PIECE + 1
CHUNK, HELD = 1 << 18, 200_000  # bytes hashed at once, runs sorted at once
_NONE = -(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_LETTER = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)
_POW = np.ones(0, np.uint64)
_INV = np.ones(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Hashes of substrings of a buffer from one prefix sum of a polynomial mod 2^64."""

    def __init__(self, data: np.ndarray):
        global _POW, _INV
        if len(_POW) < len(data) + 1:
            n = 2 * len(data) + 1024
            _POW = np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]).cumprod(dtype=np.uint64)
            _INV = np.concatenate([[np.uint64(1)], np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)]).cumprod(dtype=np.uint64)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTER[data] * _POW[: len(data)], out=self.sums[1:])

    def at(self, start: np.ndarray, size) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * _INV[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * _INV[:n])


def runs_of(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple:
    """For texts laid end to end with `count` windows from `start` on: text, first window, windows, anchor less first window, and the rank pair of each run."""
    h = Hashed(data)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    v = h.grams(GRAM) >> bits << bits
    v |= np.arange(len(v), dtype=np.uint64)
    size = 1
    while size < SPAN:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    own = np.repeat(np.arange(len(start)), count)
    p = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + start[own]
    anchor = (v[p] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.nonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])]))[0]
    n = np.diff(np.append(first, len(p)))
    s, a = p[first], anchor[first]
    key = h.at(a, SHARED)
    rank = _mix(h.at(s, n + LENGTH - 1) + (n << 8 | a - s).astype(np.uint64))
    return own[first], s, n, a - s, key, rank


_RUN = ["key", "rank", "doc", "copy", "s", "na"]
_RUNS = "key long, rank long, doc long, copy long, s long, na int"


def _emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(cols[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in cols], _RUN)


def _first_of(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Sorts runs and marks (na < 0) those that an equal earlier run of the same task precedes; marked ones are dealt out by place."""
    key, rank, doc, copy, s, na = cols
    o = np.lexsort((s, copy, doc, na < 0, rank, key))
    key, rank, doc, copy, s, na = (c[o] for c in cols)
    again = np.concatenate([[False], (key[1:] == key[:-1]) & (rank[1:] == rank[:-1])]) & (na > 0)
    key = np.where(again, _mix(_mix(doc.view(np.uint64)) + s.view(np.uint64)).view(np.int64), key)
    return [key, rank, doc, copy, s, np.where(again, -na, na).astype(np.int32)]


def _map_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n_held = [], 0
    for b in slices(batches, "text", CHUNK):
        docs, copies = b.column(0).to_numpy(), b.column(1).to_numpy()
        parts, at, which, base, count = [], [], [], [], []
        total = 0

        def flush() -> None:
            nonlocal total, n_held
            if parts:
                w = np.array(which)
                own, s, n, a, key, rank = runs_of(np.concatenate(parts), np.array(at), np.array(count))
                held.append([key.view(np.int64), rank.view(np.int64), docs[w[own]], copies[w[own]], s - np.array(at)[own] + np.array(base)[own], (n << 8 | a).astype(np.int32)])
                n_held += len(s)
            parts.clear(), at.clear(), which.clear(), base.clear(), count.clear()
            total = 0

        for i, t in enumerate(utf8_of(b.column(2))):
            data = np.frombuffer(t, np.uint8)
            for k in range(0, len(t) - LENGTH + 1, CHUNK):
                part = data[k : k + CHUNK + LENGTH - 1]
                at.append(total)
                parts.append(part)
                which.append(i)
                base.append(k)
                count.append(len(part) - LENGTH + 1)
                total += len(part)
                if total > CHUNK:
                    flush()
        flush()
        if n_held > HELD:
            yield from _emit(_first_of([np.concatenate(c) for c in zip(*held, strict=True)]))
            held, n_held = [], 0
    if held:
        yield from _emit(_first_of([np.concatenate(c) for c in zip(*held, strict=True)]))


def _rank_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by key. Out come repeats (kind 1) and runs to be cut in pieces (kind 2)."""

    def out(parts: list) -> pa.RecordBatch:
        key, rank, doc, copy, s, na = _first_of([np.concatenate(c) for c in zip(*parts, strict=True)]) if len(parts) > 1 or len(parts[0][0]) else parts[0]
        again = na < 0
        live = np.nonzero(~again)[0]
        k = key[live]
        group = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        sizes = np.diff(np.append(np.nonzero(group)[0], len(k)))
        several = np.repeat(sizes > 1, sizes)  # equal runs are marked by now, so these are different ones
        pick = np.concatenate([np.nonzero(again)[0], live[several]])
        kind = np.repeat([1, 2], [again.sum(), several.sum()]).astype(np.int32)
        size = np.abs(na[pick])
        return pa.RecordBatch.from_arrays([pa.array(doc[pick]), pa.array(copy[pick]), pa.array(s[pick]), pa.array((size >> 8).astype(np.int32)), pa.array((size & 255).astype(np.int32)), pa.array(kind)], ["doc", "copy", "s", "n", "a", "kind"])

    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy() for c in b.columns]
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if held and held[-1][0][-1] != cols[0][0]:
            yield out(held)
            held = []
        if last:
            yield out([*held, [c[:last] for c in cols]])
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield out(held)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (doc, copy, text, runs): pieces of up to PIECE windows with core hash and the bytes left and right of the core, nearest first."""
    for b in slices(batches, "text", CHUNK):
        out = []
        for i, t in enumerate(utf8_of(b.column(2))):
            data = np.frombuffer(t, np.uint8)
            runs = b.column(3)[i].values
            s, n, a = (runs.field(k).to_numpy().astype(np.int64) for k in ("s", "n", "a"))
            a = a + s
            low, high = (a - s - n + 1) // PIECE, (a - s) // PIECE
            per = high - low + 1
            r = np.repeat(np.arange(len(s)), per)
            q = np.arange(len(r)) - np.repeat(np.cumsum(per) - per, per) + low[r]
            core = a[r] - PIECE * q
            far = np.minimum(PIECE - 1, core - s[r])  # the farthest and the nearest window of the piece, left of the core
            near = np.maximum(0, core - (s + n - 1)[r])
            left, right = np.zeros(len(r), np.uint64), np.zeros(len(r), np.uint64)
            for k in range(PIECE - 1):
                x = np.where(k < far, data[np.maximum(core - 1 - k, 0)], 0).astype(np.uint64)
                y = np.where(k < PIECE - 1 - near, data[np.minimum(core + CORE + k, len(data) - 1)], 0).astype(np.uint64)
                left |= x << np.uint64(8 * k)
                right |= y << np.uint64(8 * k)
            left |= far.astype(np.uint64) << np.uint64(56)
            right |= near.astype(np.uint64) << np.uint64(56)
            rank = _mix(Hashed(data).at(core, CORE) + q.astype(np.uint64))
            doc, copy = b.column(0)[i].as_py(), b.column(1)[i].as_py()
            out.append((rank.view(np.int64), left.view(np.int64), right.view(np.int64), np.full(len(r), doc), np.full(len(r), copy), core))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["core", "left", "right", "doc", "copy", "p"])


def spans(ws: Workspace, rows: DataFrame) -> DataFrame:
    """rows: doc, copy, text. The repeats as (doc, copy, s, n): n windows from s on."""
    n = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    runs = ws.keep("runs", rows.select("doc", "copy", "text").mapInArrow(_map_runs, _RUNS).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_rank_runs, "doc long, copy long, s long, n int, a int, kind int"))
    todo = runs.filter("kind = 2").groupBy("doc", "copy").agg(F.collect_list(F.struct("s", "n", "a")).alias("runs"))
    pieces = ws.keep("pieces", rows.join(todo, ["doc", "copy"]).select("doc", "copy", "text", "runs").mapInArrow(_pieces, "core long, left long, right long, doc long, copy long, p long"))
    place = F.struct("doc", "copy", "p")
    far, near = F.shiftrightunsigned("left", 56).cast("int"), F.shiftrightunsigned("right", 56).cast("int")
    kinds = ws.keep("kinds", pieces.groupBy("core", "left", "right").agg(F.min(place).alias("first"), F.count("*").alias("many")))
    same = ["core", "left", "right"]
    again = pieces.join(kinds.filter("many > 1").select(*same, "first"), same).filter(place != F.col("first")).select("doc", "copy", (F.col("p") - far).alias("s"), (far - near + 1).alias("n"))
    again = ws.keep("again", again)
    ws.free("pieces")
    several = ws.keep("several", kinds.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1").select("core"))
    first = kinds.join(several, "core").select("core", "left", "right", "first.*", F.explode(F.sequence(near, far)).alias("j"))
    single = first.select("core", "j", F.expr("`left` & (shiftleft(1L, 8 * j) - 1)").alias("l"), F.expr("`right` & (shiftleft(1L, 8 * (7 - j)) - 1)").alias("r"), "doc", "copy", (F.col("p") - F.col("j")).alias("p"))
    single = ws.keep("single", single)
    ws.free("kinds", "several")
    same = ["core", "j", "l", "r"]
    twice = ws.keep("twice", single.groupBy(*same).agg(F.min(place).alias("first"), F.count("*").alias("many")).filter("many > 1").drop("many"))
    last = single.join(twice, same).filter(place != F.col("first")).select("doc", "copy", F.col("p").alias("s"), F.lit(1).alias("n"))
    return runs.filter("kind = 1").select("doc", "copy", "s", "n").unionByName(again).unionByName(last)


def numbered(ws: Workspace, docs: DataFrame, id_col: str, text_col: str, more: list[str]) -> DataFrame:
    """doc, copy, text and row (a struct of more columns); copy tells rows of one id apart: their place in the scan, which is written, so that it stays."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("doc"), F.col(text_col).cast("string").alias("text"), packed(docs, more).alias("row"))
    if rows.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    return ws.keep("numbered", rows.withColumn("copy", F.monotonically_increasing_id()))


def _cut(batches: Iterable[pa.RecordBatch], with_kept: bool) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 4 << 20):
        out = []
        for i, t in enumerate(utf8_of(b.column(1))):
            found, removed, k = b.column(2)[i], 0, 0
            if found.is_valid and len(found.values):
                s, n = (found.values.field(c).to_numpy().astype(np.int64) for c in ("s", "n"))
                o = np.argsort(s, kind="stable")
                s, e = s[o], np.maximum.accumulate((s + n + LENGTH - 1)[o])
                new = np.concatenate([[True], s[1:] > e[:-1]])
                s, e = s[new], e[np.append(np.nonzero(new)[0][1:] - 1, len(e) - 1)]
                removed, k = int((e - s).sum()), len(s)
                ends = [0, *e.tolist()]
                kept = b"".join([t[x:y] for x, y in zip(ends, [*s.tolist(), len(t)], strict=True)])
            else:
                kept = t
            out.append((len(t), removed, k, hashlib.sha256(kept).hexdigest(), *([kept] if with_kept else [])))
        cols = list(zip(*out, strict=True))
        kept_col = [pa.array(cols[4], pa.binary())] if with_kept else []
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3]), *kept_col, b.column(3)], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept, "row"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", more: list[str] | None = None, with_kept: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, with_kept: kept (binary), and the columns in `more`."""
    return _removed(docs, id_col, text_col, more or [], with_kept)


def _removed(docs: DataFrame, id_col: str, text_col: str, more: list[str], with_kept: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "substrings")
    rows = numbered(ws, docs, id_col, text_col, more)
    found = ws.keep("found", spans(ws, rows).groupBy("doc", "copy").agg(F.collect_list(F.struct("s", "n")).alias("spans")))
    joined = rows.join(found, ["doc", "copy"], "left").select("doc", "text", "spans", "row")
    numbers = [StructField(c, LongType()) for c in ("doc", "n_bytes", "n_removed", "n_spans")]
    schema = StructType([*numbers, StructField("kept_sha256", StringType()), *[StructField("kept", BinaryType())] * with_kept, joined.schema["row"]])
    cut = joined.mapInArrow(lambda bs: _cut(bs, with_kept), schema)
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept]
    carried = ["row.*"] if more else []
    return cut.select(F.when(F.col("doc") != _NONE, F.col("doc")).alias(free_name(id_col, more)), *(F.col(c).alias(free_name(c, [id_col, *more])) for c in own), *carried)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with all their columns, repeated passages cut from the text; a character that loses some of its bytes goes as a whole. n_chars_col, if there, holds the new length."""
    more = [c for c in docs.columns if c != text_col]  # the text itself goes through the workers once
    done = _removed(docs, id_col, text_col, more, True)
    kept = free_name("kept", [id_col, *more])
    text = F.col(kept).cast("string")
    clean = F.coalesce(F.try_validate_utf8(text), F.regexp_replace(F.make_valid_utf8(text), "\ufffd", ""))
    out = done.withColumn(text_col, clean)
    if n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
