"""Every operator and every stage on the odd cases: nulls, empty and very long texts, repeated rows, no rows, clashing names."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import langid, mixing, packing, quality, simhash, substrings, token_counts, topk, toxicity, warc
from lodestone.llm._common import Workspace, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASH = ["id", "row", "_row", "key", "cdf", "draws", "copies", "of", "replica", "score", "predicted", "kept", "doc", "copy", "spans", "n_bytes", "component", "fp", "same", "node", "apart", "digest", "payload", "first", "ids", "tag", "x", "none", "lang_pred", "held_out", "text_1"]
LONG = ("lorem ipsum dolor sit amet consectetur " * 9000)[:300_000]


def odd_rows():
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a null id with some words"), (None, None), (4, LONG), (5, "x" * 200_000), (6, "twice the same row"), (6, "twice the same row"), (7, "one id and two texts"), (7, "two texts and one id"), (8, "日本語 texte"), (-9, "negative")]
    return [(i, t, None if i is None or i % 2 else "en", None if i is None else f"s{i % 2}", len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), DOCS).repartition(3)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def models(spark):
    d = table(spark, SF, "documents")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    texts = spark.createDataFrame([(i, ("good calm day " if i % 2 == 0 else "vile nasty slur ") * 12) for i in range(60)], "doc_id long, text string")
    return langid.train_model(d.select("lang", "text", F.col("doc_id").alias("key"))), toxicity.fit(texts, labels)


def operators(models):
    ids = {"langid": lambda d: langid.identify(d, models[0]), "simhash": simhash.near_duplicates, "substrings": substrings.remove_repeats, "quality": quality.judge, "toxicity": lambda d: toxicity.score(d, models[1])}
    ids["token_counts"] = lambda d: token_counts.count_tokens(d, P.path("word_bpe_49k.json"))
    ids["packing"] = lambda d: packing.pack_documents(d, P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN)
    ids["mixing"] = lambda d: mixing.mix(d, epochs=3.0, smoothing=1.0)
    return ids


NAMES = ["langid", "simhash", "substrings", "quality", "toxicity", "token_counts", "packing", "mixing"]


@pytest.mark.parametrize("name", NAMES)
def test_operators(spark, odd, models, name):
    run = operators(models)[name]
    got = run(odd).collect()
    plain = run(odd.select("doc_id", "text", "lang", "source", "n_chars")).collect()
    key = [c for c in plain[0].asDict() if c not in ("replica", "sequence_id", "offset", "start", "length", "ids_crc32", "rejected_by")]
    assert sorted(repr([r[c] for c in key]) for r in got) == sorted(repr([r[c] for c in key]) for r in plain)  # clashing names change nothing
    if name not in ("packing", "mixing"):
        assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, *_ in odd_rows())
    if name == "packing":
        assert {r.doc_id for r in got} == {i for i, *_ in odd_rows()} and sum(r.length for r in got if r.doc_id == 6) == sum(r.doc_tokens for r in got if r.doc_id == 6 and r.start == 0)
    assert run(odd.limit(0)).count() == 0


def test_archives(spark):
    rows = [(1, None), (2, b""), (None, b"n" * 120), (4, LONG.encode()), (6, b"r" * 150), (6, b"r" * 150), (7, b"p"), (7, b"p")]
    df = spark.createDataFrame(rows, "page_id long, html binary").withColumns({c: F.lit(f"own {c}") for c in CLASH})
    for kind in (df, df.limit(0)):
        ws = Workspace(spark, "edges")
        warc.archive(kind, f"{ws.root}/a")
        got = warc.read_archives(spark, f"{ws.root}/a", ws).collect() if kind is df else []
        assert sorted(repr(r.id) for r in got) == (sorted(repr(i) for i, _ in rows) if kind is df else [])
        assert sorted(r.payload_bytes for r in got) == (sorted(len(b or b"") for _, b in rows) if kind is df else [])


def test_search(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(40)], "vec_id long, embedding array<double>").withColumns({c: F.lit(f"own {c}") for c in CLASH})
    got = topk.search(df, F.col("vec_id") % 20 == 0, 3).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (20, 1, 2), (20, 2, 5), (20, 3, 8)]
    assert topk.search(df.limit(0), F.lit(True), 3).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, name, stage):
    got = stage(spark, odd, SF)
    if name == "packing":
        assert {r.doc_id for r in got.collect()} == {i for i, *_ in odd_rows()}
        return
    assert got.columns == odd.columns and got.schema.simpleString() == odd.schema.simpleString()
    rows = got.collect()
    assert all(r[c] == f"own {c}" for r in rows for c in CLASH)
    ids = sorted(repr(r.doc_id) for r in rows)
    if name in ("toxicity", "repeated_substrings"):
        assert ids == sorted(repr(i) for i, *_ in odd_rows())
    if name == "near_duplicates":  # of the four texts without words one stays, and one of the two equal rows
        assert ids == sorted(map(repr, [1, None, 4, 5, 6, 7, 7, 8, -9]))
    if name == "repeated_substrings":
        assert all(r.n_chars == len(r.text or "") for r in rows)
    assert stage(spark, odd.limit(0), SF).count() == 0
