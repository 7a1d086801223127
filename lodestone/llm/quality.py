"""Operator 6: quality rules as a short-circuit cascade.

The counts that every row reports (words, symbols, repeated lines and word windows) are taken once. The verdict is a
cascade of further rules: documents of a few randomly drawn partitions give each rule's seconds per document and the
share it rejects, and the rules run in the order of rejections per second; a document leaves at the first rule that
rejects it. Seconds are measured, so the order may change from run to run, and with it `rejected_by`; kept does not: a
document is kept if no rule rejects it, whatever the order.

Null text has no words: all counts are 0, it fails the base rules and is not kept. Texts of any length are read whole;
repeated rows are judged each; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import random
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import slices, table, utf8_of

SAMPLE_PARTITIONS, SAMPLE_DOCS, SEED = 3, 400, 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass
class Document:
    text: bytes
    words: list[bytes]
    n_symbols: int
    lines: list[bytes] = field(default_factory=list)
    n_dup_lines: int = 0


#: True: the rule rejects the document. All in whole numbers.
RULES: dict[str, Callable[[Document], bool]] = {
    "symbols": lambda d: 10 * d.n_symbols > len(d.words),
    "repeated_lines": lambda d: 10 * d.n_dup_lines > 4 * len(d.lines),
    "exclamations": lambda d: 10 * d.text.count(b"!") > 3 * len(d.words),
    "short_or_long_words": lambda d: not 2 * len(d.words) <= sum(map(len, d.words)) <= 40 * len(d.words),
    "few_distinct_words": lambda d: 100 * len(set(d.words)) < 15 * len(d.words),
    "one_word_dominates": lambda d: 100 * max(Counter(d.words).values()) > 35 * len(d.words),
}


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of `width` words found twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    with np.errstate(over="ignore"):
        size, factor = 1, np.uint64(0x9E3779B97F4A7C15)
        while size < width:
            h = h[:-size] * factor + (h[size:] ^ (h[size:] >> np.uint64(29)))
            size, factor = 2 * size, factor * factor
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not twice.size:
        return 0
    at = np.nonzero(np.isin(h, twice))[0]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def read(text: bytes) -> Document:
    a = np.frombuffer(text, np.uint8)
    d = Document(text, text.split(), int(_SYMBOL[a].sum()))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    d.lines, d.n_dup_lines = lines, len(lines) - len(set(lines))
    return d


def measure(docs: DataFrame, text_col: str, rules: dict) -> list[str]:
    """Rule names by rejections per second on the sample, most first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, seen = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0
        for b in slices(batches, "text"):
            for t in utf8_of(b.column(0)):
                d = read(t)
                if len(d.words) < 20:
                    continue
                seen += 1
                for name, rule in rules.items():
                    began = time.perf_counter()
                    hits[name] += bool(rule(d))
                    spent[name] += time.perf_counter() - began
            if seen >= SAMPLE_DOCS:
                break
        if seen:
            yield pa.RecordBatch.from_pydict({"name": [*rules], "spent": [*spent.values()], "hits": [*hits.values()]})

    rdd = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "name string, spent double, hits long").rdd
    n = rdd.getNumPartitions()
    drawn = sorted(random.Random(SEED).sample(range(n), min(n, SAMPLE_PARTITIONS)))
    got = docs.sparkSession.sparkContext.runJob(rdd, list, drawn) if n else []  # reads these partitions only
    spent, hits = Counter(), Counter()
    for r in got:
        spent[r.name] += r.spent
        hits[r.name] += r.hits
    return sorted(rules, key=lambda n: (-hits[n] / (spent[n] + 1e-9), n))


def judge(docs: DataFrame, *, rules: dict[str, Callable[[Document], bool]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, the base counts, base_failed, kept, and rejected_by (the first rule of the cascade that rejects; null if none)."""
    order = measure(docs, text_col, rules)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = []
            for t in utf8_of(b.column(1)):
                d = read(t)
                n = len(d.words)
                a = np.frombuffer(b"".join(d.words), np.uint8)
                repeats = repeat_words(d.words)
                failed = n < 20 or 100 * repeats > 30 * n
                by = "base" if failed else next((name for name in order if rules[name](d)), None)
                out.append((n, int(((a & 0xC0) != 0x80).sum()), d.n_symbols, d.n_dup_lines, repeats, failed, by is None, by))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:7]), pa.array(cols[7], pa.string())], names)

    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names[1:6]) + ", base_failed boolean, kept boolean, rejected_by string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")


ORACLE_SQL = {
    "op6_quality": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) > 7)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY doc_id),
most AS (SELECT doc_id, max(n) AS n, count(*) AS distinct_words FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY doc_id, x) GROUP BY doc_id),
b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, strlen(array_to_string(w, '')) AS word_bytes,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!]', '', 'g')) AS marks,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(m.n, 0) AS top, coalesce(m.distinct_words, 0) AS distinct_words
  FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN most m USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 4 * n_lines OR 10 * marks > 3 * n_words
            OR word_bytes < 2 * n_words OR word_bytes > 40 * n_words OR 100 * distinct_words < 15 * n_words OR 100 * top > 35 * n_words) AS kept
FROM b
"""
}
