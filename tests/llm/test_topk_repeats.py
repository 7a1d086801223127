"""Repeated rows count as rows, as in the query's SQL."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import topk


def test_repeated_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 64]) for i in range(60)]
    rows += [(61, [9 / 64] * 4)] * 25 + [rows[20]] * 2 + [rows[5]] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    x = np.floor(64 * np.array([v for _, v in rows])).astype(int)
    s, want = x @ x.T, []
    for q in (0, 20, 40):
        met = [(-s[i, j], rows[j][0]) for i, r in enumerate(rows) if r[0] == q for j in range(len(rows)) if rows[j][0] != q]
        want += [(q, k + 1, c, -n) for k, (n, c) in enumerate(sorted(met)[:20])]
    for block in (1, 32):
        got = topk.search(df, F.col("vec_id") % 20 == 0, 20, block=block, bins=4).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
