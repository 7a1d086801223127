"""Importance resampling against a plain program."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import importance
from lodestone.llm._common import table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def by_hand(docs, target, n=2, percent=25):
    """docs: (id, text). Rows (id, n_features, weight, score, rank), sorted."""
    every = [runs(t, n) for _, t in docs]
    s, t = Counter(b for _, f in every for b in f), Counter(b for x in target for b in runs(x, n)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000))))
    out = []
    for (i, _), (words, f) in zip(docs, every, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(repr, (tuple(r[:5]) for r in out)))


def shown(df):
    return sorted(repr((r.doc_id, r.n_features, r.weight, r.score, r.rank)) for r in df.collect())


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 16])
@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_ring(monkeypatch, piece, n):
    monkeypatch.setattr(importance, "PIECE", piece)
    for text in ("", "one", "one two", "A b C d É f", "x1 y2 z3 " * 9, "日本 kein-wort, 1 2 3"):
        got, words = Counter(), 0
        for count, found in importance.crc_ring(text.encode(), n):
            words += count
            got.update(c % 10000 for r in found for c in r)
        assert (words, got) == (runs(text, n)[0], Counter(runs(text, n)[1]))


def test_query(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, SF, "benchmark").collect()]
    assert shown(importance.op13_importance(spark, SF)) == by_hand(docs, target)


ROWS = [(None, "a null id " * 9), (None, None), (1, ""), (2, None), (3, "word " * 100_000), (4, "x" * 200_000), (5, "twice the same text " * 6), (5, "twice the same text " * 6), (6, "one id two texts " * 7), (6, "two texts one id " * 7), (-7, "negative and 日本語 É " * 8), *((i, f"filler {i} " * 12) for i in range(100, 140))]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    target = spark.createDataFrame([("filler text",), (None,), ("",)], "text string")
    want = by_hand(ROWS, ["filler text", None, ""], n=3, percent=50)
    assert shown(importance.resample(docs, target, n=3, percent=50)) == want
    clash = docs.withColumns({c: F.lit(f"own {c}") for c in ("rank", "score", "weight", "id", "carried", "_row", "n_words", "_at", "bucket")})
    assert shown(importance.resample(clash, target, n=3, percent=50)) == want
    kept = importance.drawn(clash, target, n=3, percent=50)
    assert kept.columns == [*clash.columns, "rank_1"] and sorted(r.rank_1 for r in kept.collect()) == list(range(1, kept.count() + 1)) and kept.filter("rank != 'own rank'").isEmpty()
    assert importance.resample(docs.limit(0), target).count() == 0
    assert shown(importance.resample(docs, target.limit(0))) == by_hand(ROWS, [])
