"""Which page is the response must not hang on how a scan is split."""

from lodestone.llm import warc
from lodestone.llm._common import Workspace


def test_splits_may_change_between_the_jobs(spark):
    ws = Workspace(spark, "warc-splits")
    rows = [(i, b"p%d" % (i % 5) * 100) for i in range(40)] + [(1, b"p1" * 100), (1, b"p1" * 100), (None, b"q" * 200), (None, b"q" * 200), (50, b"r" * 9)]
    pages = ws.keep("pages", spark.createDataFrame(rows, "page_id long, html binary").repartition(12))
    out = warc.revisits(pages, ws)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "500")
    try:
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((repr(r.id), bytes(r.payload)) for r in got) == sorted((repr(i), b) for i, b in rows)
    firsts = [(r.id, bytes(r.payload)) for r in got if not r.revisit]
    assert sorted(map(repr, firsts)) == sorted(map(repr, [*((k, b"p%d" % k * 100) for k in range(5)), (None, b"q" * 200), (50, b"r" * 9)]))
    assert all(r.refers_to == (None if r.id is None else r.id % 5) for r in got if r.revisit)
