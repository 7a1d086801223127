"""Mixing draws every row by itself: null ids, repeated ids, full duplicates."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import mixing

ROWS = {
    "null ids": lambda i: (None, f"text {i}"),
    "one id": lambda i: (7, f"text {i}"),
    "full duplicates": lambda i: (None, "the same"),
    "pairs": lambda i: (i // 2, "the same"),
}


@pytest.mark.parametrize("name", ROWS)
def test_rows_are_drawn_one_by_one(spark, name):
    docs = spark.createDataFrame([(*ROWS[name](i), "en", "one source", 8) for i in range(4000)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = mixing.mix(docs, epochs=1.0)
    per_part = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert abs(sum(per_part) - 4000) < 260 and len(per_part) == 4 and max(per_part) < 1.2 * min(per_part)
    first = Counter(map(tuple, got.collect()))
    assert first == Counter(map(tuple, mixing.mix(docs.repartition(7), epochs=1.0).collect()))  # the same, however the rows lie
    drawn = got.filter("replica = 0").count()
    assert abs(drawn - 4000 * 0.632) < 200  # a Poisson of mean 1 is 0 for 37 in 100


def test_unique_ids_keep_their_draws(spark):
    rows = [(i, f"text {i}", "en", "s", 8) for i in range(500)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    alone = Counter(r.doc_id for r in mixing.mix(spark.createDataFrame(rows, schema), weights={"s": 1.0}).collect())
    more = [(None, f"null {i}", "en", "s", 8) for i in range(50)] + [(900, "twice", "en", "s", 8)] * 2
    both = Counter(r.doc_id for r in mixing.mix(spark.createDataFrame(rows + more, schema), weights={"s": 1.0}).collect())
    assert all(both[i] == alone[i] for i in range(500))
