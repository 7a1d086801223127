"""Operator 3: SimHash near-duplicates by anchor-point covering.

Fingerprints are taken per document and equal ones collapse. Anchors are the codewords of covering codes of parts of the
64 bits, and the threshold is shared out among the parts. 23 bits are covered by the perfect binary Golay code: every
pattern lies within RADIUS = 3 of exactly one codeword. The other 41 bits are cut into five blocks, each covered by all
its patterns, with radius 0. Of two fingerprints that differ in at most THRESHOLD = 4 bits, either

* at most one difference lies in the 23 bits, and then one of the five blocks has none (four differences, five blocks):
  anchors are (codeword, block), five tables; a fingerprint is at home at its own codeword and replicated to every
  codeword within the covering radius plus the table's share of the threshold, 3 + 1; or
* at least two lie there, at most two elsewhere, and three of the five blocks have none: anchors are three blocks, ten
  tables, covering radius 0 and share 0: a fingerprint has one anchor in each.

So every linked pair meets at an anchor. There they are compared bit by bit, and only a spanning forest of the links
found is passed on. An anchor with more than HOT rows is dealt out as a grid of cells (home part x replica part).
Components follow from the forests.

`similar` links texts by the similarity of their word shingles, 0.8 unless told otherwise. A single fingerprint can't
carry that (two texts of similarity 0.8 differ in about 9 of 64 bits), so every shingle set gets PRINTS independent
fingerprints, each dealt to the same anchors. Sets that meet at an anchor of any of them and differ there in at most
NEAR bits are candidates, and every candidate is verified by the sets themselves: no pair below the similarity is
linked. Pairs right at the similarity are found with a probability that grows with PRINTS; README has measured recalls. Large groups, whose pairs grow
with the square, leave anchors as spanning forests of candidates; the crowds that these connect are compared in tasks.

Null, empty and wordless texts have fingerprint zero and are linked like any other (in `similar`: with each other);
repeated ids share a row's fate each; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import Workspace, slices, small_batches, table, utf8_of
from lodestone.llm.components import components

THRESHOLD, RADIUS, WORDS, HOT = 4, 3, 4, 20_000
SIMILAR_WORDS, PRINTS, NEAR, FEW, SMALL = 5, 8, 14, 2, 64
CELL_ROWS, CELL_WORDS = 8192, 1 << 19  # of each of the two parts of a crowd that are compared in one task
MOST_SENT = 1 << 20  # row numbers that are sent to all tasks, 8 bytes each
PAIR, CROWD = 0, 1
GOLAY = 0xC75  # generator polynomial of the binary Golay code of length 23
BLOCKS = [(23, 8), (31, 8), (39, 8), (47, 8), (55, 9)]  # first bit, width
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the rows of h (n x k, 64-bit) have each bit set: 64 k counts. Bytes add up 255 rows at a time."""
    ones = np.zeros(64 * h.shape[1], np.int64)
    for i in range(0, len(h), 255):
        bits = np.unpackbits(np.ascontiguousarray(h[i : i + 255]).view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return ones


def fingerprint(text: bytes, width: int = WORDS) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(width, len(words))
    ones, n = np.zeros(64, np.int64), len(words) - k + 1
    starts, ends = (ends - size)[:n].tolist(), ends[k - 1 :].tolist()
    for i in range(0, n, 1 << 16):
        ones += _ones(np.fromiter((_hash(joined[a:b]) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=True)), np.uint64)[:, None])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """id, fp (64 bits as a signed long)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = np.array([fingerprint(t, width) for t in utf8_of(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


@cache
def _code() -> tuple:
    """Syndromes of the high and low bits, and the error patterns of weight up to RADIUS + 1 by syndrome."""

    def remainder(v: int) -> int:
        for k in range(22, 10, -1):
            if v >> k & 1:
                v ^= GOLAY << (k - 11)
        return v

    low = np.array([remainder(v) for v in range(1 << 12)])
    high = np.array([remainder(v << 12) for v in range(1 << 11)])
    errors = np.array([sum(1 << b for b in bits) for w in range(RADIUS + 2) for bits in combinations(range(23), w)])
    syndrome = low[errors & 0xFFF] ^ high[errors >> 12]
    order = np.lexsort((np.bitwise_count(errors), syndrome))
    return low, high, errors[order], np.searchsorted(syndrome[order], np.arange((1 << 11) + 1))


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, place in fp, home) for all anchors that fingerprints (uint64) go to. Anchors stay below 2^44."""
    low, high, errors, first = _code()
    v = (fp & np.uint64((1 << 23) - 1)).astype(np.int64)
    s = low[v & 0xFFF] ^ high[v >> 12]
    n = first[s + 1] - first[s]
    row = np.repeat(np.arange(len(fp)), n)
    e = errors[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[s][row]]
    word, home = (v[row] ^ e) >> 11, np.bitwise_count(e) <= RADIUS
    parts = [(fp >> np.uint64(b)).astype(np.int64) & ((1 << w) - 1) for b, w in BLOCKS]
    key, at, own = [], [], []
    for k in range(len(BLOCKS)):
        key.append(k << 40 | parts[k][row] << 12 | word)
        at.append(row)
        own.append(home)
    for k, (a, b, c) in enumerate(combinations(range(len(BLOCKS)), 3), len(BLOCKS)):
        key.append(k << 40 | parts[a] << 18 | parts[b] << 9 | parts[c])
        at.append(np.arange(len(fp)))
        own.append(np.ones(len(fp), bool))
    return np.concatenate(key), np.concatenate(at), np.concatenate(own)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between values: each linked value but the smallest of its part, and that smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def compare(key: np.ndarray, fp: np.ndarray, role: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links within anchors; rows are sorted by anchor. role: 1 home, 2 replica, 3 both."""
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    size = np.diff(np.append(first, len(key)))
    left, right = [], []
    small = size <= 64
    rows = np.nonzero(np.repeat(small & (size > 1), size))[0]
    room = (np.repeat(first + size, size)[rows] - 1 - rows) if len(rows) else rows
    for d in range(1, 64):
        rows, room = rows[room >= d], room[room >= d]
        if not rows.size:
            break
        near = np.bitwise_count(fp[rows] ^ fp[rows + d]) <= threshold
        left.append(fp[rows[near]])
        right.append(fp[rows[near] + d])
    for i in np.nonzero(~small)[0]:
        x, r = fp[first[i] : first[i] + size[i]], role[first[i] : first[i] + size[i]]
        home, every = x[r & 1 > 0], x[r & 2 > 0]
        for k in range(0, len(home), 256):
            p, q = np.nonzero(np.bitwise_count(home[k : k + 256, None] ^ every) <= threshold)
            u, v = forest(home[k + p], every[q])
            left.append(u)
            right.append(v)
    if not left:
        return fp[:0], fp[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    return forest(a[a != b], b[a != b])


def links(ws: Workspace, prints: DataFrame, *, hot: int = HOT) -> DataFrame:
    """prints: distinct fp. Rows (u, v): a spanning forest of all pairs within the threshold."""

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 8192):
                fp = b.column(0).slice(i, 8192).to_numpy().view(np.uint64)
                k, at, own = anchors(fp)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[at].view(np.int64)), pa.array(np.where(own, 3, 2).astype(np.int32))], ["key", "fp", "role"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(parts: list[tuple]) -> pa.RecordBatch:
            u, v = compare(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for b in batches:
            k, f, r = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            cut = int(np.searchsorted(k, k[-1])) if b.num_rows else 0  # the last anchor may go on
            if cut and held and held[0][0][0] != k[0]:
                yield out(held)
                held = []
            if cut:
                yield out([*held, (k[:cut], f[:cut], r[:cut])])
                held = []
            elif held and held[0][0][0] != k[0]:
                yield out(held)
                held = []
            if b.num_rows:
                held.append((k[cut:], f[cut:], r[cut:]))
        if held:
            yield out(held)

    rows = prints.select("fp").mapInArrow(spread, "key long, fp long, role int").withColumn("cell", F.lit(0))
    busy = ws.keep("busy", rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > hot))
    if not busy.isEmpty():
        parts = F.ceil(F.col("n") / hot).cast("int")
        own = F.pmod(F.xxhash64("fp"), parts).cast("int")
        across = F.sequence(F.lit(0), parts - 1)
        cells = F.when(F.col("n").isNull(), F.array(F.struct(F.lit(0).alias("cell"), F.col("role").alias("role")))).otherwise(
            F.concat(F.when(F.col("role") == 3, F.transform(across, lambda j: F.struct((own * parts + j).alias("cell"), F.lit(1).alias("role")))).otherwise(F.array()), F.transform(across, lambda i: F.struct((i * parts + own).alias("cell"), F.lit(2).alias("role"))))
        )
        rows = rows.drop("cell").join(busy, "key", "left").select("key", "fp", F.explode(cells).alias("c")).select("key", "fp", "c.role", "c.cell")
        rows = rows.withColumn("key", F.when(F.col("cell") > 0, F.xxhash64("key", "cell")).otherwise(F.col("key")))
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "fp", "role").repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(meet, "u long, v long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """One row per document: id, fp (long), component_id: the smallest id that a chain of links reaches."""
    small_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "simhash")
    prints = ws.keep("prints", fingerprints(docs, id_col=id_col, text_col=text_col, width=width))
    nodes = ws.keep("nodes", prints.groupBy("fp").agg(F.min("id").alias("rep")))
    star = components(ws, links(ws, nodes))
    rooted = ws.keep("rooted", nodes.join(star.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = ws.keep("least", rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = ws.keep("named", rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MOST_WORDS = 50_000


class _Words(dict):
    """Hashes of words, kept while there are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MOST_WORDS:
            self.clear()
        self[word] = h = _hash(word)
        return h


_known = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int = SIMILAR_WORDS) -> np.ndarray:
    """The sorted distinct hashes of the shingles; fewer words than the width are one shingle."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    h = np.full(len(words) - k + 1, np.uint64(k))
    for j in range(k):
        h = _mix(h * _GOLDEN + w[j : len(words) - k + 1 + j])
    return np.unique(h)


def many_prints(found: np.ndarray, prints: int) -> np.ndarray:
    """Independent fingerprints of a set of hashes."""
    seeds = np.arange(1, prints + 1, dtype=np.uint64) * _GOLDEN
    ones = np.zeros(64 * prints, np.int64)
    for i in range(0, len(found), 4080):
        ones += _ones(_mix(found[i : i + 4080, None] + seeds))
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))


def signatures(rows: DataFrame, width: int, prints: int) -> DataFrame:
    """row, same (a hash of the whole set), n (its size), prints."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [shingle_set(t, width) for t in utf8_of(b.column(1))]
            same = [xxhash.xxh128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _lists([many_prints(s, prints) for s in sets])], ["row", "same", "n", "prints"])

    return rows.mapInArrow(run, "row long, same binary, n long, prints array<long>")


def sets_of(rows: DataFrame, width: int) -> DataFrame:
    """row, held: the shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingle_set(t, width) for t in utf8_of(b.column(1))])], ["row", "held"])

    return rows.mapInArrow(run, "row long, held array<long>")


def _counts(fp: np.ndarray, home: np.ndarray, rows: np.ndarray, others: np.ndarray, near: int) -> np.ndarray:
    """How many of the others, itself among them, each of these rows of one anchor is within `near` bits of, one of the two at home there."""
    found = [((np.bitwise_count(fp[at := rows[i : i + 64], None] ^ fp[others]) <= near) & (home[at, None] | home[others])).sum(1) for i in range(0, len(rows), 64)]
    return np.concatenate(found) if found else rows[:0]


def _reached(n: int, close: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first row of each of n rows' part; close(rows, others): which of the others (columns) are linked to which rows. A row is held against those that no part has yet."""
    root, left = np.arange(n), np.arange(n)
    while len(left):
        lead, todo, left = left[0], left[:1], left[1:]
        while len(todo) and len(left):
            met = close(todo[:64], left).any(0)
            root[left[met]] = lead
            todo, left = np.concatenate([todo[64:], left[met]]), left[~met]
    return root


def _in_anchor(fp: np.ndarray, home: np.ndarray, few: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of one anchor: the pairs (two arrays of places) of those that have `few` candidates at most, and the crowds of the others (for each row the first of its crowd, or itself)."""
    every = np.arange(len(fp))
    n = _counts(fp, home, every, every[:512], near) - (home & (every < 512))
    scarce = n <= few
    n[scarce] = _counts(fp, home, every[scarce], every, near) - home[scarce]
    rest, many = np.nonzero(n <= few)[0], np.nonzero(n > few)[0]
    alone, left, right = n <= few, [], []
    for i in range(0, len(rest), 64):
        at = rest[i : i + 64]
        p, q = np.nonzero((np.bitwise_count(fp[at, None] ^ fp) <= near) & (home[at, None] | home))
        p = at[p]
        once = (p < q) | (p > q) & ~alone[q]
        left.append(p[once])
        right.append(q[once])
    root = every.copy()
    f, h = fp[many], home[many]
    root[many] = many[_reached(len(many), lambda x, y: (np.bitwise_count(f[x, None] ^ f[y]) <= near) & (h[x, None] | h[y]))]
    return np.concatenate([every[:0], *left]), np.concatenate([every[:0], *right]), root


def _meet(batches: Iterable[pa.RecordBatch], near: int, hot: int, few: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, tag), sorted by key. Out come rows (u, v, kind).

    PAIR: the candidates of rows that have `few` in their anchor at most. CROWD: of the others a spanning forest of the
    candidates, over all anchors of the task. An anchor of more than `hot` rows is passed through as one crowd.
    """
    crowds: list[tuple] = []

    def rows_of(u: np.ndarray, v: np.ndarray, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), kind, np.int32))], ["u", "v", "kind"])

    def noted(u: np.ndarray, v: np.ndarray) -> None:
        crowds.append((u[u != v], v[u != v]))
        if sum(len(x) for x, _ in crowds) > 1 << 18:
            crowds[:] = [forest(*(np.concatenate(c) for c in zip(*crowds, strict=True)))]

    def out(key: np.ndarray, fp: np.ndarray, tag: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        size = np.diff(np.append(first, len(key)))
        home, node, found = (tag & 1) > 0, tag >> 1, []
        # anchors of a few rows, all at once: every row with the d-th after it
        rows = np.nonzero(np.repeat((size > 1) & (size <= 64), size))[0]
        room = np.repeat(first + size, size)[rows] - 1 - rows
        left, right = [rows[:0]], [rows[:0]]
        for d in range(1, 64):
            rows, room = rows[room >= d], room[room >= d]
            if not rows.size:
                break
            met = rows[(np.bitwise_count(fp[rows] ^ fp[rows + d]) <= near) & (home[rows] | home[rows + d])]
            left.append(met)
            right.append(met + d)
        p, q = np.concatenate(left), np.concatenate(right)
        n = np.bincount(p, minlength=len(key)) + np.bincount(q, minlength=len(key))
        many = (n[p] > few) & (n[q] > few)
        found.append((node[p[~many]], node[q[~many]]))
        noted(node[p[many]], node[q[many]])
        for i in np.nonzero(size > 64)[0]:
            at = slice(first[i], first[i] + size[i])
            p, q, root = _in_anchor(fp[at], home[at], few, near)
            found.append((node[at][p], node[at][q]))
            noted(node[at], node[at][root])
        u, v = (np.concatenate(x) for x in zip((node[:0], node[:0]), *found, strict=True))
        yield rows_of(np.maximum(u, v), np.minimum(u, v), PAIR)

    held: list[tuple] = []  # rows of the last anchor, which may go on
    n_held, through, lead = 0, None, None  # an anchor that has more than `hot` rows already, and its first row
    for b in batches:
        if not b.num_rows:
            continue
        rows = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
        if through is not None:
            mine = int(np.searchsorted(rows[0], through, "right"))
            noted(rows[2][:mine] >> 1, np.full(mine, lead))
            rows = tuple(c[mine:] for c in rows)
            if not len(rows[0]):
                continue
            through = None
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if held and (cut or held[0][0][0] != rows[0][0]):
            mine = int(np.searchsorted(rows[0], held[0][0][0], "right"))
            yield from out(*(np.concatenate(c) for c in zip(*held, tuple(c[:mine] for c in rows), strict=True)))
            held, n_held, rows, cut = [], 0, tuple(c[mine:] for c in rows), cut - mine
        if cut > 0:
            yield from out(*(c[:cut] for c in rows))
            rows = tuple(c[cut:] for c in rows)
        held.append(rows)
        n_held += len(rows[0])
        if n_held > hot:
            key, _, tag = (np.concatenate(c) for c in zip(*held, strict=True))
            through, lead = int(key[-1]), int(tag[0] >> 1)
            noted(tag >> 1, np.full(len(tag), lead))
            held, n_held = [], 0
    if held:
        yield from out(*(np.concatenate(c) for c in zip(*held, strict=True)))
    if crowds:
        yield rows_of(*forest(*(np.concatenate(c) for c in zip(*crowds, strict=True))), CROWD)


def sent_if_few(rows: DataFrame) -> DataFrame:
    """Row numbers, broadcast if they are counted to be MOST_SENT at most, so that texts that are filtered by them stay in place."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def bits_apart(prints: int, similarity: tuple[int, int]) -> tuple[int, int]:
    """How many bits of all fingerprints together two sets of the similarity differ in at most: 5 standard deviations over the mean, for large sets and for those of under SMALL shingles, whose bits are less even."""
    s = similarity[0] / similarity[1]
    mean, root = 64 * math.acos(min(1.0, 2 * s / (1 + s))) / math.pi, math.sqrt(prints)
    return math.ceil(mean * prints + 15 * root), math.ceil((mean + 2.3) * prints + 17 * root)


def _open(n: np.ndarray, prints: np.ndarray, rows: np.ndarray, others: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Which of the others (columns) these rows may be similar to by what near_enough looks at."""
    p, q = similarity
    large, small = bits_apart(prints.shape[1], similarity)
    apart = np.zeros((len(rows), len(others)), np.int64)
    for k in range(prints.shape[1]):
        apart += np.bitwise_count(prints[rows, None, k] ^ prints[others, k])
    least, most = np.minimum(n[rows, None], n[others]), np.maximum(n[rows, None], n[others])
    return (q * least >= p * most) & (apart <= np.where(least < SMALL, small, large))


def linked(n: np.ndarray, prints: np.ndarray, part: np.ndarray, held: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """For each row the first row of its component: links by the similarity of the sets, which lie end to end in `held`. If there are two parts, only rows of different parts are compared."""
    p, q = similarity
    _, word = np.unique(held, return_inverse=True)
    ends = np.cumsum(n)
    sets = np.split(word, ends[:-1])
    seen, root, two = np.zeros(word.max(initial=0) + 1, bool), np.arange(len(n)), len(np.unique(part)) > 1
    for i in range(0, len(n), 64):
        at, after = np.arange(i, min(i + 64, len(n))), np.arange(i, len(n))
        for row, near in zip(at, _open(n, prints, at, after, similarity), strict=True):
            other = after[near & (root[after] != root[row]) & (after > row)]
            other = other[part[other] != part[row]] if two else other
            if not len(other):
                continue
            seen[sets[row]] = True
            shared = np.add.reduceat(seen[np.concatenate([sets[j] for j in other])], np.cumsum(n[other]) - n[other], dtype=np.int64)
            seen[sets[row]] = False
            met = other[q * shared >= p * (n[row] + n[other] - shared)]
            roots = np.unique(root[[row, *met]])
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    return root


def in_cells(members: DataFrame, weight: Column, most: int) -> DataFrame:
    """Members (node, crowd, ...) dealt out so that all pairs of a crowd meet in cells (a, b) of about 2 * most weight: `part` is a row's own part, a or b. A small crowd is one cell."""
    large = members.groupBy("crowd").agg(F.ceil(F.sum(weight) / most).cast("int").alias("_parts")).filter("_parts > 1")
    own = members.join(F.broadcast(large), "crowd", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int"))
    cells = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("a", F.least("part", "_other")).withColumn("b", F.greatest("part", "_other")).drop("_parts", "_other")
    return cells.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "crowd", "a", "b")  # what stands by crowd alone would do for groupBy, too


def _cell(t: pa.Table, prints: int) -> tuple[np.ndarray, ...]:
    flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy().view(np.uint64)
    return t.column("node").to_numpy(), t.column("n").to_numpy(), flat("prints").reshape(-1, prints)


def _edges(node: np.ndarray, root: np.ndarray) -> pa.Table:
    moved = root != np.arange(len(root))
    return pa.table({"u": node[moved], "v": node[root[moved]]})


def crowd_links(ws: Workspace, rows: DataFrame, own: DataFrame, similarity: tuple[int, int], prints: int, width: int) -> DataFrame:
    """own: node, n, prints, crowd (null for most). Rows (u, v): a spanning forest of the similar pairs of every crowd.

    All pairs of a crowd are compared, cell by cell, first by sizes and fingerprints, of which components remain (rows that
    met by chance fall apart here), then by the sets in each of these.
    """

    def near(t: pa.Table) -> pa.Table:
        node, n, every = _cell(t, prints)
        return _edges(node, _reached(len(node), lambda x, y: _open(n, every, x, y, similarity)))

    def same(t: pa.Table) -> pa.Table:
        node, n, every = _cell(t, prints)
        held = t.column("held").combine_chunks().flatten().to_numpy().view(np.uint64)
        return _edges(node, linked(n, every, t.column("part").to_numpy(), held, similarity))

    met = in_cells(own.filter("crowd IS NOT NULL"), F.lit(1), CELL_ROWS).groupBy("crowd", "a", "b").applyInArrow(near, "u long, v long")
    star = components(ws, met)
    fine = ws.keep("fine", own.drop("crowd").join(crowds_of(star), "node"))
    sets = sets_of(rows.join(sent_if_few(fine.select(F.col("node").alias("row"))), "row", "left_semi"), width).withColumnRenamed("row", "node")
    return ws.keep("crowd_links", in_cells(ws.keep("crowd_sets", fine.join(sets, "node")), F.col("n"), CELL_WORDS).groupBy("crowd", "a", "b").applyInArrow(same, "u long, v long"))


def crowds_of(star: DataFrame) -> DataFrame:
    """node, crowd: the members of the components that a star (u, v) gives, the smallest included."""
    return star.select(F.col("u").alias("node"), F.col("v").alias("crowd")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("crowd")).distinct())


def near_enough(pairs: DataFrame, own: DataFrame, similarity: tuple[int, int], prints: int) -> DataFrame:
    """Of pairs (u, v) those that their sizes and all fingerprints together leave open, 8 bytes each: what met at one anchor by chance is far apart in the other fingerprints. Pairs within a crowd are left to crowd_links."""
    p, q = similarity
    large, small = bits_apart(prints, similarity)
    side = lambda c, n, f, k: own.select(F.col("node").alias(c), F.col("n").alias(n), F.col("prints").alias(f), F.coalesce("crowd", F.lit(-1)).alias(k))
    apart = F.aggregate(F.zip_with("f", "g", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    near = apart <= F.when(F.least("a", "b") < SMALL, small).otherwise(large)
    both = pairs.join(side("u", "a", "f", "c"), "u").join(side("v", "b", "g", "d"), "v")
    return both.filter(((F.col("c") != F.col("d")) | (F.col("c") < 0)) & (q * F.least("a", "b") >= p * F.greatest("a", "b")) & near).select("u", "v")


def alike(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Of pairs (u, v) those whose sets have the similarity (a fraction) or more."""
    p, q = similarity
    both = pairs.join(sets.select(F.col("row").alias("u"), F.col("held").alias("x")), "u").join(sets.select(F.col("row").alias("v"), F.col("held").alias("y")), "v")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(q * shared >= p * (F.size("x") + F.size("y") - shared)).select("u", "v")


def similar(docs: DataFrame, *, row_col: str, text_col: str = "text", width: int = SIMILAR_WORDS, similarity: tuple[int, int] = (4, 5), prints: int = PRINTS, near: int = NEAR, hot: int = HOT, few: int = FEW) -> DataFrame:
    """One row per document: row_col, component (the smallest row_col that a chain of links reaches). row_col: long, unique, the same in every scan.

    Rows with at most `few` candidates in an anchor give them as pairs. The others (large groups, whose pairs would grow
    with the square) give a spanning forest of theirs; what that connects is a crowd, and the pairs of a crowd are
    compared where its rows lie together, so that only a forest of links leaves a task. `few` shares out the work between
    the two ways; both compare every candidate, so it has no part in the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ws = Workspace(spark, "similar")
    rows = docs.select(F.col(row_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    sketches = ws.keep("sketches", signatures(rows, width, prints))
    nodes = ws.keep("nodes", sketches.groupBy("same").agg(F.min("row").alias("node")))
    own = ws.keep("own", sketches.filter("n > 0").join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n", "prints"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                node, every = part.column(0).to_numpy(), part.column(1).flatten().to_numpy().view(np.uint64).reshape(part.num_rows, prints)
                for k in range(prints):
                    key, at, home = anchors(every[:, k])
                    yield pa.RecordBatch.from_arrays([pa.array(k << 44 | key), pa.array(every[at, k].view(np.int64)), pa.array(node[at] << 1 | home)], ["key", "fp", "tag"])

    dealt = own.select("node", "prints").mapInArrow(spread, "key long, fp long, tag long").repartition(n, "key").sortWithinPartitions("key")
    met = ws.keep("met", dealt.mapInArrow(lambda bs: _meet(bs, near, hot, few), "u long, v long, kind int"))
    star = components(ws, met.filter(F.col("kind") == CROWD).select("u", "v"))
    own = ws.keep("crowded", own.join(crowds_of(star), "node", "left"))
    links = crowd_links(ws, rows, own, similarity, prints, width)
    pairs = ws.keep("pairs", near_enough(met.filter(F.col("kind") == PAIR).select("u", "v").distinct(), own, similarity, prints))
    some = pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct()
    sets = ws.keep("sets", sets_of(rows.join(sent_if_few(some), "row", "left_semi"), width))
    star = components(ws, links.unionByName(alike(pairs, sets, similarity)))
    named = nodes.join(star.select(F.col("u").alias("node"), F.col("v").alias("_l")), "node", "left").select("same", F.coalesce("_l", "node").alias("component"))
    found = ws.keep("found", sketches.select("row", "same").join(named, "same").select(F.col("row").alias(row_col), "component"))
    ws.free("sketches", "nodes", "own", "met", "crowded", "fine", "crowd_sets", "crowd_links", "pairs", "sets", "edges")
    return found


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
