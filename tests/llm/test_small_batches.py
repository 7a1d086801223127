"""Texts reach the Python workers in small batches, and what a worker holds of them is bounded."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import simhash, substrings, toxicity
from lodestone.llm._common import BATCH_BYTES

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture()
def fresh(spark):
    spark.conf.unset(BOUND)
    yield spark
    spark.conf.unset(BOUND)


def largest(rows):
    """Bytes of the largest batch of one task that a worker gets."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)], pa.int64())], ["n"])

    return rows.coalesce(1).mapInArrow(run, "n long").first().n


@pytest.mark.parametrize("stage", ["toxicity", "near_duplicates", "repeated_substrings"])
def test_texts_go_to_workers_in_small_batches(fresh, stage):
    docs = fresh.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string"), F.repeat(F.lit(" text"), 1800)).alias("text"))
    few = docs.limit(8)
    if stage == "toxicity":
        toxicity.drop_toxic(few, 0.1)
    elif stage == "near_duplicates":
        simhash.similar(few, row_col="doc_id")
    else:
        substrings.remove_repeats(few)
    assert largest(docs) < 2 * BATCH_BYTES  # 18 MB before


def test_a_bound_set_by_the_user_stays(fresh):
    fresh.conf.set(BOUND, "1m")
    toxicity.drop_toxic(fresh.range(3).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")), 0.1)
    assert fresh.conf.get(BOUND) == "1m"


def test_runs_are_hashed_in_bounded_memory():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 6_000_000, dtype=np.uint8).tobytes().decode()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([text, text[:5000]])], ["doc", "copy", "text"])
    tracemalloc.start()
    n = sum(b.num_rows for b in substrings._map_runs([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 100_000 and peak < 64e6  # 97 MB before, 6 of them the text
