"""Operator 5: sum-of-squares online packing of tokenized documents into fixed windows.

A level array counts the partially filled windows at each fill. A document (beyond its full windows, which stand alone)
goes to the fill whose use leaves the smallest sum of squared counts; ties go to the fuller window. A full window is
closed and its pieces are emitted. Where more than MOST_OPEN ids wait in open windows, these are laid end to end and cut
into full ones, so a task's memory is bounded whatever the lengths, and nothing is padded for it. Each task packs its own input partition and numbers its windows within it, so no
token moves between executors. At the end of a partition the windows still open are laid end to end and cut at the
window length; the rest, shorter than a window, is cut into sequences whose lengths are powers of two, which need no
padding.

Tokens of a text come from the vocabulary file; runs of white space with the word that follows are looked up in a
bounded table, because the split pattern never joins a word to the white space after it.

Null counts as the empty text: one token, the end mark. Repeated rows are packed each; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import slices, table, utf8_of

WINDOW = 2048
MOST_OPEN = 1 << 22  # ids that wait in a task's open windows, 4 bytes each
MOST_CACHED = 50_000  # words in a worker's table; the first ones met stay, and common words come early
LONGEST_CACHED = 24
SLICE = 4 << 20  # longer texts are cut before white space about here
_UNIT = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_BORDER = re.compile(rb"[^\t-\r ](?=[\t-\r ])")
_WIDE_LEAD = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Encoder:
    """Byte-level BPE ids as the library gives them for the .json file; ranks: the same vocabulary for the faster library."""

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(vocabulary)
        self.specials = [t.content.encode() for t in self.full.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.width = np.zeros(max(table_.values()) + 2, np.int32)
            for token, n in table_.items():
                self.width[n] = len(token)
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table_, special_tokens={})
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: bytes) -> bytes:
        t = text.decode("utf-8", "replace")
        plain = self.fast is not None and not any(s in text for s in self.specials)
        return np.asarray(self.fast.encode_ordinary(t) if plain else self.full.encode(t, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, units: list[bytes], got: list) -> None:
        """Units not in the table are encoded in one call; each starts with white space or stands first, so they stay apart."""
        new = [i for i, x in enumerate(got) if x is None]
        missed = [units[i] for i in new]
        text = b"".join(missed)
        if self.fast is None or any(s in text for s in self.specials):
            found = [self._whole(x) for x in missed]
        else:
            ids = np.asarray(self.fast._core_bpe.encode_ordinary(text.decode("utf-8", "replace")), "<u4")
            ends = np.searchsorted(np.cumsum(self.width.take(ids)), np.cumsum(np.fromiter(map(len, missed), np.int64, len(missed))), "left") * 4 + 4
            buf, ends = ids.tobytes(), ends.tolist()
            found = [buf[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for i, x in zip(new, found, strict=True):
            got[i] = x
        if len(self.known) < MOST_CACHED:
            self.known.update(x for x in zip(missed, found, strict=True) if len(x[0]) <= LONGEST_CACHED)

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _WIDE_LEAD.search(text):
            return self._whole(text)
        out, at = [], 0
        while at < len(text):
            cut = _BORDER.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = cut.end() if cut else len(text)
            units = _UNIT.findall(text[at:end] if at or cut else text)
            got = list(map(self.known.get, units))
            if None in got:
                self._learn(units, got)
            out.append(b"".join(got))
            at = end
        return b"".join(out)


_encoders: dict[tuple, Encoder] = {}


def encoder(*key) -> Encoder:
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


class SumOfSquares:
    """Windows of one partition. put() gives back the pieces of windows that are full: (item, start, length, window, offset).

    cut makes of an item and a start what is held for the piece from there on. Windows in which more than most_open ids
    wait are laid end to end and cut into full ones; what is left, less than a window, stays open.
    """

    def __init__(self, window: int, *, most_open: int = MOST_OPEN, cut: Callable = lambda item, start: item):
        self.window, self.most, self.cut = window, max(most_open, window), cut
        self.made = self.held = 0
        self._clear()

    def _clear(self) -> None:
        self.levels, self.open, self.held = np.zeros(self.window + 1, np.int64), [[] for _ in range(self.window)], 0

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def _wait(self, number: int, pieces: list, fill: int) -> None:
        self.open[fill].append((number, pieces))
        self.levels[fill] += 1
        self.held += fill

    def put(self, item, n: int) -> Iterator[tuple]:
        start = 0
        while n - start >= self.window:
            yield item, start, self.window, self._new(), 0
            start += self.window
        size = n - start
        if not size:
            return
        fills = self.levels[: self.window - size + 1]
        change = 2 * (self.levels[size : self.window + 1] - fills) + 2
        change[fills == 0] = np.iinfo(np.int64).max
        change[0] = 2 * self.levels[size] + 1
        if fills[-1]:
            change[-1] = 1 - 2 * fills[-1]
        at = len(change) - 1 - int(change[::-1].argmin())
        if at:
            number, pieces = self.open[at].pop()
            self.levels[at] -= 1
            self.held -= at
        else:
            number, pieces = self._new(), []
        pieces.append((self.cut(item, start), start, size, number, at))
        if at + size == self.window:
            yield from pieces
            return
        self._wait(number, pieces, at + size)
        if self.held > self.most:
            yield from self._laid_out(whole=False)

    def flush(self) -> Iterator[tuple]:
        """The windows still open, end to end: full windows, then powers of two."""
        yield from self._laid_out(whole=True)

    def _laid_out(self, *, whole: bool) -> Iterator[tuple]:
        left = [p for level in reversed(self.open) for _, pieces in level for p in pieces]
        full, rest = divmod(sum(p[2] for p in left), self.window)
        self._clear()
        tail = [1 << k for k in range(self.window.bit_length() - 1, -1, -1) if rest >> k & 1] if whole else [rest] * bool(rest)
        room = iter([self.window] * full + tail)
        number, at, size, kept = self._new(), 0, next(room, 0), []
        for item, start, length, _, _ in left:
            while length:
                if at == size:
                    number, at, size = self._new(), 0, next(room)
                n = min(length, size - at)
                if whole or size == self.window:
                    yield item, start, n, number, at
                else:
                    kept.append((item, start, n, number, at))
                start, length, at = start + n, length - n, at + n
        if kept:
            self._wait(number, kept, rest)


COLUMNS = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str, *, ranks: str | None = None, pattern: str = "", window: int = WINDOW, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if with_ids. Paths are there on every executor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, bins, rows = encoder(vocabulary, ranks, pattern), SumOfSquares(window, cut=lambda item, start: (item[0], item[1][4 * (start - item[2]) :], start, item[3])), []
        high = TaskContext.get().partitionId() << 32

        def batch() -> pa.RecordBatch:
            cols = [[] for _ in range(7 + with_ids)]
            for (doc, buf, base, total), start, n, number, at in rows:
                part = buf[4 * (start - base) : 4 * (start - base + n)]
                for c, v in zip(cols, (doc, start, n, zlib.crc32(part), total, high | number, at, *([np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else [])), strict=True):
                    c.append(v)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:7]), *(pa.array(c, pa.list_(pa.int64())) for c in cols[7:])], [*names])

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
        id_type = None
        for b in slices(batches, "text"):
            id_type = b.schema.field("doc_id").type
            for doc, text in zip(b.column(0).to_pylist(), utf8_of(b.column(1)), strict=True):
                buf = enc.ids(text) + int(end_id).to_bytes(4, "little")
                n = len(buf) // 4
                rows += bins.put((doc, buf, 0, n), n)
                if len(rows) >= 4096:
                    yield batch()
        rows += bins.flush()
        if rows:
            yield batch()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = COLUMNS.format(rows.schema["doc_id"].dataType.simpleString()) + ", ids array<long>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack_documents(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN)
