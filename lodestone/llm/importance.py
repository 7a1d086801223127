"""Operator 13: importance resampling towards a target distribution, with hashed word runs as features.

Features are all runs of 1 to `n` consecutive words, joined by one space; a feature's bucket is the CRC-32 of its bytes
modulo `buckets`. A ring holds the running CRC states of the last n - 1 starts: at each word every state of the ring is
extended by a space and the word, and a new state starts with the word itself, so no run of words is ever built. The
words of a text come in pieces of PIECE, the ring is carried from piece to piece.

The corpus is read twice, for the counts of all buckets (each task sends one row per bucket it met, added up in Spark)
and for the documents' mean gains; what goes to the executors between is one number per bucket. A bucket's gain is
floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), a document's weight the floored mean of its features'
gains (0 without features), its score the weight plus Gumbel noise hashed from seed and id. Of the N documents with at
least `least_words` words the floor(percent * N / 100) of highest scores are drawn, ties to smaller ids; ranks come from
a range partition and the sizes of its parts, so nothing is sorted in one task.

Null and empty texts have no words: no features, weight 0, never drawn (if least_words > 0). A null id hashes as the
empty text and stands last among ties; rows that share an id share their noise and are drawn each by its own weight, in
any order if that is the same. Texts of any length are read whole, in bounded pieces. An empty corpus gives no rows; an
empty target is one without features. Other columns are not read by `resample`, whatever their names, and are carried by
`drawn`, with `rank` (or the first of rank_1, rank_2, ... that is free) added.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._common import Workspace, free_name, packed, slices, table, utf8_of

N, BUCKETS, PERCENT, SEED, LEAST_WORDS = 2, 10_000, 25, 7, 20
PIECE = 1 << 16  # words
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def crc_ring(text: bytes, n: int) -> Iterator[tuple[int, list[list[int]]]]:
    """Per piece of a text: its number of words, and the CRCs of all runs that end in it, a list per length."""
    ring: list[int | None] = [None] * (n - 1)  # ring[k]: the state of the start k words back, null before the text
    words = (m[0] for m in _WORD.finditer(text.translate(_LOWER)))
    while piece := list(islice(words, PIECE)):
        spaced = [b" " + w for w in piece] if n > 1 else []
        runs = [list(map(zlib.crc32, piece))]
        for k in range(1, n):
            ahead = runs[-1][:-1]
            if ring[k - 1] is not None:
                now = list(map(zlib.crc32, spaced, [ring[k - 1], *ahead]))
            else:  # the text begins here: its first words end no run of this length
                now = list(map(zlib.crc32, spaced[len(piece) - len(ahead) :], ahead))
            ring[k - 1] = runs[-1][-1] if runs[-1] else None
            runs.append(now)
        yield len(piece), runs


def _buckets(runs: list[list[int]], buckets: int) -> np.ndarray:
    return np.concatenate([np.asarray(r, np.uint32) for r in runs]) % np.uint32(buckets)


def bucket_counts(docs: DataFrame, *, text_col: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; buckets without a feature are missing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for b in slices(batches, "text"):
            for text in utf8_of(b.column(0)):
                for _, runs in crc_ring(text, n):
                    seen += np.bincount(_buckets(runs, buckets), minlength=buckets)
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["bucket", "n"])

    each = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, *, text_col: str = "text", target_col: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for each of all buckets."""
    s, t = bucket_counts(docs, text_col=text_col, n=n, buckets=buckets), bucket_counts(target, text_col=target_col, n=n, buckets=buckets)
    both = s.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(t.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = both.unionByName(docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    met = every.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    totals = met.agg(F.sum("s").alias("s_all"), F.sum("t").alias("t_all"))  # one row
    gain = F.floor(1000 * F.log((F.col("t") + 1) * (F.col("s_all") + buckets) / ((F.col("s") + 1) * (F.col("t_all") + buckets))))
    return met.join(F.broadcast(totals)).select("bucket", gain.cast("long").alias("gain"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a SHA-256 of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = N, buckets: int = BUCKETS, seed: int = SEED, carried: Column | None = None) -> DataFrame:
    """Per document: doc_id (under id_col's name), n_words, n_features, weight, score, and `carried` if given."""
    known = np.zeros(buckets, np.int64)
    for r in gains(docs, target, text_col=text_col, target_col=target_col, n=n, buckets=buckets).collect():  # a row per bucket, however large the corpus
        known[r.bucket] = r.gain
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for text in utf8_of(b.column(1)):
                words = features = total = 0
                for count, runs in crc_ring(text, n):
                    hit = _buckets(runs, buckets)
                    words, features, total = words + count, features + len(hit), total + int(sent.value[hit].sum())
                out.append((words, features, total // features if features else 0))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols), *b.columns[2:]], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([] if carried is None else [carried.alias("carried")]))
    names = ["id", "n_words", "n_features", "weight", *(["carried"] if carried is not None else [])]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"id {kinds['id']}, n_words long, n_features long, weight long" + (f", carried {kinds['carried']}" if carried is not None else "")
    return rows.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumnRenamed("id", id_col)


def ranked(weighed: DataFrame, ws: Workspace, *, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """weighed, written, with rank: 1, 2, ... for what is drawn, else null."""
    held = ws.keep("weighed", weighed.withColumn("_row", F.monotonically_increasing_id()))
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("_row")]  # the row number splits what ties in all else
    placed = ws.keep("placed", held.filter(F.col("n_words") >= least_words).orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part")  # a row for each shuffle partition
    ahead = ws.keep("ahead", sizes.select("_part", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all")))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    hit = placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(ahead), "_part").withColumn("rank", F.when(place <= F.floor(F.col("_all") * percent / 100), place).cast("long"))
    columns = [c for c in weighed.columns]
    return hit.select(*columns, "rank").unionByName(held.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every document: id, n_words, n_features, weight, score, rank (null if it isn't drawn)."""
    ws = Workspace(docs.sparkSession, "importance")
    return ranked(weigh(docs, target, id_col=id_col, text_col=text_col, target_col=target_col, n=n, buckets=buckets, seed=seed), ws, id_col=id_col, percent=percent, least_words=least_words)


def drawn(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn documents with all their columns, and their rank."""
    ws, kept = Workspace(docs.sparkSession, "importance"), {k: options.pop(k) for k in ("percent", "least_words") if k in options}
    found = ranked(weigh(docs, target, id_col=id_col, text_col=text_col, carried=packed(docs), **options), ws, id_col=id_col, **kept)
    return found.filter("rank is not null").select("carried.*", F.col("rank").alias(free_name("rank", docs.columns)))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE_SQL = {
    "op13_importance": r"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8),
texts AS (SELECT 's' AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), item_id, text FROM benchmark),
words AS (SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (
  SELECT side, row, unnest(w) AS f FROM words
  UNION ALL SELECT side, row, w[i] || ' ' || w[i + 1] FROM (SELECT side, row, w, unnest(generate_series(1, len(w) - 1)) AS i FROM words WHERE len(w) > 1)),
counted AS (SELECT side, row, f, count(*) AS n FROM features GROUP BY ALL),
hex AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted)),
bytes AS (SELECT f, list_transform(generate_series(1, length(x)::BIGINT, 2), lambda i: ('0x' || x[i:i + 1])::BIGINT) AS b FROM hex),
hashed AS (SELECT f, xor(list_reduce(b, lambda a, v: xor(a >> 8, steps[xor(a & 255, v) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM bytes, crc),
per AS (SELECT side, row, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM per GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + 10000) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000))))::BIGINT AS gain FROM b),
m AS (SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM per JOIN g USING (bucket) WHERE side = 's' GROUP BY row),
scored AS (
  SELECT w.row, w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(w.doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM words w LEFT JOIN m USING (row) WHERE w.side = 's'),
placed AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor(25 * n / 100) THEN place END AS rank FROM scored LEFT JOIN placed USING (row)
"""
}
