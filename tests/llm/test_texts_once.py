"""Texts go to Python workers once, and come back only where they are changed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import substrings, toxicity


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def texts_through_workers(df):
    """How often a plan's steps in Python take or give the column text."""
    n = 0
    for p in nodes(df._jdf.queryExecution().optimizedPlan()):
        if p.nodeName() == "MapInArrow":
            n += p.schema().json().count('"name":"text"') + p.children().apply(0).schema().json().count('"name":"text"')
    return n


@pytest.fixture()
def docs(spark):
    return spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.repeat(F.lit("and the same again "), (F.col("id") % 9).cast("int")), F.col("id").cast("string")).alias("text"), F.lit("x").alias("lang"), F.lit(0).alias("n_chars"))


def test_toxicity_keeps_rows_out_of_the_workers(spark, docs):
    net = toxicity.Network(3)
    kept = toxicity.drop_toxic(docs, net, threshold=0.5)
    assert texts_through_workers(kept) == 0  # 3 before
    got = {r.doc_id: r for r in toxicity.score(docs, net).collect()}
    want = 1 / (1 + np.exp(-net.logits([toxicity.words_of(r.text.encode()) for r in docs.orderBy("doc_id").collect()])))
    assert [got[i].score for i in range(40)] == pytest.approx(list(want), abs=1e-5)
    assert {i for i in got if got[i].predicted == 0} == {r.doc_id for r in kept.collect()} and kept.columns == docs.columns


def test_repeats_are_cut_from_the_one_text_that_is_sent(spark, docs):
    cut = substrings.without_repeats(docs)
    assert texts_through_workers(cut) == 1  # 3 before
    assert cut.columns == docs.columns and cut.count() == 40
    rows = {r.doc_id: r for r in cut.collect()}
    assert all(r.n_chars == len(r.text) and r.lang == "x" for r in rows.values()) and len(rows[8].text) < 100
