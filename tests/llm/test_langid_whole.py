"""Every n-gram counts, however many there are."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import langid


def test_small_language_beside_millions_of_ngrams(spark):
    rng = np.random.default_rng(4)
    noise = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 55_000))) for _ in range(40)]
    rows = [("aa", t, i) for i, t in enumerate(noise)] + [("zz", "sphinx of black quartz judge my vow", 99)]
    train = spark.createDataFrame(rows, "lang string, text string, key long")
    model = langid.train_model(train)
    assert model.langs == ["aa", "zz"] and len(model.levels[-1].grams) > 2_000_000
    got = langid.identify(spark.createDataFrame([(1, "black quartz")], "doc_id long, text string"), model).select(F.col("lang_pred")).collect()
    assert [r.lang_pred for r in got] == ["zz"]
