"""Operator 12: conversation structure repair by lazy weighted determinisation.

A conversation is right if the initials of its roles read `(s?(ua)+)?`. Its rows are edited at least cost: Keep 0, Rerole
to user or assistant 2, Delete 3 (a must for blank rows and repeats), Insert an empty user or assistant row anywhere 2;
a truncated row that is not deleted adds 1. What matters of a row is one of twelve symbols: role initial (s, u, a, other)
by fault (none, truncated, must go).

The weighted automaton has four states: nothing yet, after s, after u, after a. Read from the last row to the first, its
costs to go from each state, less their minimum, are a vector of which only few exist; each is a state of the
deterministic automaton, made when first met, with its successor, the cost taken out and the cheapest arcs per symbol
cached in tables. The scan over a conversation's symbols is a table lookup per row and gives the cost; the trace back over
the vectors met, from the first row on, takes of the tight arcs the one of least letter (D, I, K, R), which gives the
audit that is least in ASCII among all of least cost. An audit fixes the roles, so the repaired rows follow from it.

How the work is spread: rows alike in conversation, turn, role and text are counted first, then the earliest turn of each
text is joined to its rows. Symbols, a byte a row, are made from rows without their texts in a range partition by
conversation and place, so that one long conversation is spread over many tasks; its pieces then meet, as bytes: as many
as its audit has letters, which is one value of the result by contract. Texts are read in order, row by row, beside the
audit, and never gathered; the SHA-256 of a repaired conversation is one stream by nature.

Order in a conversation: turn (nulls first), role, the first HEAD characters of the text, its MD5; rows alike in all are
adjacent. Null roles and texts are one space, as are a null id or turn in the hash that damages; a null conversation id
is a conversation like any other. A role's initial is its first character, none for an empty one. Texts of any length are
read whole. No rows give no conversations; a conversation all of whose rows are dropped has zeros, an empty audit and the
hash of the empty string. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import Workspace, slices, table

HEAD = 64
SPACE = "\t\n\x0b\x0c\r "
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
_FAR = 1 << 40
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Initial classes s, u, a, other; by fault none, truncated, must go: symbol = class + 4 * fault.
_KEEPS = [{START: AFTER_S}, {START: AFTER_U, AFTER_S: AFTER_U, AFTER_A: AFTER_U}, {AFTER_U: AFTER_A}, {}]
#: The next state where a user or assistant row is written, whichever may stand there.
_NEXT = [AFTER_U, AFTER_U, AFTER_A, AFTER_U]


class Determinised:
    """States are normalised vectors of costs to go; made when met. One per worker: vectors don't depend on the data."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.vectors: list[tuple] = []
        self.after: dict[int, int] = {}  # state << 4 | symbol: the state before the row
        self.taken: dict[int, int] = {}  # and the cost taken out
        self.moves: dict[int, list[tuple[str, int]]] = {}  # and per state of the weighted automaton: letters up to the row's own, next state
        self.end = self._state((0, 4, 2, 0))

    def _state(self, vector: tuple) -> int:
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector]

    def step(self, state: int, symbol: int) -> int:
        """Makes the table's entry; its key is given back."""
        key = state << 4 | symbol
        if key in self.after:
            return key
        to_go, (fault, kind) = self.vectors[state], divmod(symbol, 4)
        own: list[dict[str, tuple[int, int]]] = []  # per state: letter -> cost, next
        for q in range(4):
            arcs = {"D": (DELETE + to_go[q], q)}
            if fault < 2:
                extra = CUT_OFF * fault
                if q in _KEEPS[kind]:
                    arcs["K"] = (extra + to_go[_KEEPS[kind][q]], _KEEPS[kind][q])
                arcs["R"] = (REROLE + extra + to_go[_NEXT[q]], _NEXT[q])
            own.append(arcs)
        best = [min(c for c, _ in arcs.values()) for arcs in own]
        for _ in range(4):  # insertions before the row
            best = [min(best[q], INSERT + best[_NEXT[q]]) for q in range(4)]
        moves = []
        for q in range(4):
            letters, at = "", q
            while True:
                tight = {a: n for a, (c, n) in own[at].items() if c == best[at]}
                if INSERT + best[_NEXT[at]] == best[at]:
                    tight["I"] = _NEXT[at]
                letter = min(tight)
                letters, at = letters + letter, tight[letter]
                if letter != "I":
                    break
            moves.append((letters, at))
        low = min(best)
        self.taken[key], self.moves[key] = low, moves
        self.after[key] = self._state(tuple(b - low for b in best))
        return key

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """Cost and audit of a conversation."""
        after, taken, step = self.after, self.taken, self.step
        state, cost, keys = self.end, 0, []
        for s in reversed(symbols):
            key = state << 4 | s
            if key not in after:
                step(state, s)
            keys.append(key)
            cost += taken[key]
            state = after[key]
        cost += self.vectors[state][START]
        q, out, moves = START, [], self.moves
        for key in reversed(keys):
            letters, q = moves[key][q]
            out.append(letters)
        return cost, "".join(out) + "I" * (0, 2, 1, 0)[q]


_shared = Determinised()


def _illegal(symbols: bytes) -> int:
    """Neighbours whose initials aren't su, ua or au."""
    kinds = bytes(s & 3 for s in symbols)
    good = {b"\x00\x01", b"\x01\x02", b"\x02\x01"}
    return sum(kinds[i : i + 2] not in good for i in range(len(kinds) - 1))


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (adjacent copies): one row in twenty is dropped, emptied, stripped of its stops, repeated, or given to the user."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spoken("text"), "[.!?]", "")).otherwise(spoken("text"))
    return turns.filter(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spoken("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).cast("long").alias("n"))


def _placed(turns: DataFrame, ws: Workspace) -> DataFrame:
    """One row per conversation, turn, role and text, with n, head, digest, and fault (blank, duplicate, truncated, null) of its first copy. Written."""
    n = F.col("n") if "n" in turns.columns else F.lit(1).cast("long")
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), n.alias("n")).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    shown = ws.keep("rows", rows.withColumn("head", F.substring("text", 1, HEAD)).withColumn("digest", F.md5(F.col("text").cast("binary"))))
    when = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    first = shown.groupBy("conv_id", "role", "digest").agg(F.min(when).alias("first"), F.count("*").alias("times")).filter("times > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    met = shown.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    ends = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(ends == "", "blank").when(F.col("first") < when, "duplicate").when(~F.right(ends, F.lit(1)).isin(".", "!", "?"), "truncated")
    return ws.keep("placed", met.select("conv_id", "turn", "role", "head", "digest", "text", "n", fault.alias("fault")))


_ORDER = ["turn", "role", "head", "digest"]


def _symbols(placed: DataFrame, ws: Workspace) -> DataFrame:
    """conv_id, part, at, symbols: the pieces of each conversation, in order of (part, at)."""
    kind = F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)) - 1
    light = placed.select("conv_id", *_ORDER, "n", F.when(kind < 0, 3).otherwise(kind).cast("int").alias("kind"), F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0).alias("fault"))
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("conv_id"), *map(F.asc_nulls_first, _ORDER)]
    dealt = light.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", F.spark_partition_id().alias("part"), "n", "kind", "fault")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, at, out = None, bytearray(), 0, ([], [], [], [])
        part = 0

        def close() -> None:
            nonlocal at
            if held:
                for column, value in zip(out, (conv, part, at, bytes(held)), strict=True):
                    column.append(value)
                at += 1
                held.clear()

        for b in batches:
            kind_of = b.column(0).type
            for c, p, n, k, f in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != conv:
                    close()
                    conv = c
                part = p
                held.append(k + 4 * f)
                if n > 1:
                    held += bytes([k + 8]) * (n - 1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind_of), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["conv_id", "part", "at", "symbols"])
            out = ([], [], [], [])
        close()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind_of), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["conv_id", "part", "at", "symbols"])

    return dealt.mapInArrow(run, f"conv_id {light.schema['conv_id'].dataType.simpleString()}, part int, at int, symbols binary")


def _audits(pieces: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit."""
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "at", "symbols"))).alias("p")).select("conv_id", F.array_join(F.transform("p", lambda x: F.decode(x["symbols"], "ISO-8859-1")), "").alias("symbols"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s in b.column(1).to_pylist():
                symbols = s.encode("latin-1")
                out.append((_illegal(symbols), *_shared.repair(symbols)))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["conv_id", "illegal", "cost", "audit"])

    return whole.mapInArrow(run, f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, illegal long, cost long, audit string")


class _Walk:
    """One conversation's rows along its audit: (letter, role, text) of what is written, letters I, K and R."""

    def __init__(self, audit: str):
        self.audit, self.p, self.q = audit, 0, START

    def _write(self) -> str:
        self.q = _NEXT[self.q]
        return "assistant" if self.q == AFTER_A else "user"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.p : self.p + 1] == "I":
            self.p += 1
            yield "I", self._write(), ""

    def row(self, role: str, text: str, n: int) -> Iterator[tuple[str, str, str]]:
        for _ in range(n):
            yield from self.inserted()
            letter = self.audit[self.p]
            self.p += 1
            if letter == "K":
                self.q = _KEEPS["sua".index(role[0])][self.q]
                yield "K", role, text
            elif letter == "R":
                yield "R", self._write(), text


def _walked(placed: DataFrame, audits: DataFrame) -> tuple[DataFrame, list[str]]:
    """Audits and rows of each conversation side by side, the audit first, then its rows in order."""
    kind = placed.schema
    none = lambda c: F.lit(None).cast(kind[c].dataType).alias(c)
    heads = audits.select("conv_id", F.lit(0).alias("row"), *(none(c) for c in ("turn", "role", "head", "digest", "text", "n")), "illegal", "cost", "audit")
    rows = placed.select("conv_id", F.lit(1).alias("row"), "turn", "role", "head", "digest", "text", "n", F.lit(None).cast("long").alias("illegal"), F.lit(None).cast("long").alias("cost"), F.lit(None).cast("string").alias("audit"))
    order = ["conv_id", "row", *_ORDER]
    both = heads.unionByName(rows).repartition(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id").sortWithinPartitions(*map(F.asc_nulls_first, order))
    columns = ["conv_id", "row", "turn", "role", "text", "n", "illegal", "cost", "audit"]
    return both.select(*columns), columns


def _hashed(placed: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit, repaired_sha256."""
    both, columns = _walked(placed, audits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = walk = digest = kind = None
        out: list[tuple] = []

        def add(lines: Iterable[tuple]) -> None:
            nonlocal first
            for _, role, text in lines:
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False

        def close() -> None:
            if walk is not None:
                add(walk.inserted())
                out.append((*head, digest.hexdigest()))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "illegal", "cost", "audit", "repaired_sha256"])

        first = True
        for b in slices(batches, "text"):
            kind = b.column(0).type
            for c, row, _, role, text, n, illegal, cost, audit in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if row == 0:
                    close()
                    head, walk, digest, first = (c, illegal, cost, audit), _Walk(audit), hashlib.sha256(), True
                else:
                    add(walk.row(role, text, n))
            if out:
                yield batch()
        close()
        if out:
            yield batch()

    return both.mapInArrow(run, f"conv_id {placed.schema['conv_id'].dataType.simpleString()}, illegal long, cost long, audit string, repaired_sha256 string")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """turns: conv_id, turn, role, text (n: copies, if there). The repaired rows: conv_id, position (from 0), turn (null if inserted), role, text, edit (K, R, I)."""
    ws = Workspace(turns.sparkSession, "dialogue")
    placed = _placed(turns, ws)
    both, _ = _walked(placed, _audits(ws.keep("pieces", _symbols(placed, ws))))
    kinds = {c: placed.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = walk = types = None
        position, out = 0, []

        def add(turn, lines: Iterable[tuple]) -> None:
            nonlocal position
            for letter, role, text in lines:
                out.append((conv, position, None if letter == "I" else turn, role, text, letter))
                position += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "position", "turn", "role", "text", "edit"])

        for b in slices(batches, "text"):
            types = (b.column(0).type, pa.int64(), b.column(2).type, pa.string(), pa.string(), pa.string())
            for c, row, turn, role, text, n, _, _, audit in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if row == 0:
                    if walk is not None:
                        add(None, walk.inserted())
                    conv, walk, position = c, _Walk(audit), 0
                else:
                    add(turn, walk.row(role, text, n))
            if out:
                yield batch()
        if walk is not None:
            add(None, walk.inserted())
        if out:
            yield batch()

    return both.mapInArrow(run, f"conv_id {kinds['conv_id']}, position long, turn {kinds['turn']}, role string, text string, edit string")


def repair(turns: DataFrame, *, every: DataFrame | None = None) -> DataFrame:
    """turns: conv_id, turn, role, text (n: copies, if there). A row per conversation, those of `every` (conv_id) without rows too: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    ws = Workspace(turns.sparkSession, "dialogue")
    placed = _placed(turns, ws)
    done = _hashed(placed, _audits(ws.keep("pieces", _symbols(placed, ws))))
    n, is_ = F.col("n"), lambda f: F.col("fault").eqNullSafe(f)
    by_turn = placed.groupBy("conv_id", "turn").agg(F.sum(F.when(is_("blank"), n)).alias("b"), F.sum(F.when(is_("duplicate"), n).when(~is_("blank"), n - 1)).alias("d"), F.count_if(is_("truncated")).alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    facts = by_turn.groupBy("conv_id").agg(zero(F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), zero(F.sum("b")).alias("blank"), zero(F.sum("d")).alias("duplicate"), zero(F.sum("t")).alias("truncated"))
    ids = (turns if every is None else every).select("conv_id").distinct()
    same = lambda c: F.col("conv_id").eqNullSafe(F.col(c))
    met = ids.join(facts.withColumnRenamed("conv_id", "f"), same("f"), "left").join(done.withColumnRenamed("conv_id", "g"), same("g"), "left")
    return met.select("conv_id", *(zero(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair(damage(turns), every=turns)
