"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import simhash
from lodestone.llm._common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def brute(texts):
    def of(t):
        w = (t or "").encode().translate(simhash._LOWER).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = [of(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def texts_of(spark):
    rng = random.Random(5)
    base = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").limit(60).collect()]
    out = [*base, None, "", " \n", "a b", "A B", "one two three four five six"]
    for t in base[:40]:
        w = t.split()
        for per in (0, 0.01, 0.02, 0.03):
            if len(w) > 60:
                v = list(w)
                for i in rng.sample(range(len(v)), int(per * len(v))):
                    v[i] = f"changed{rng.randrange(1000)}"
                out.append(" ".join(v))
    return out


def test_links_all_of_similarity(spark):
    texts = texts_of(spark)
    want = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    for more in ({}, {"few": 1, "prints": 10, "hot": 3}):  # candidates at once; by turns, anchors passed through
        got = {r.row: r.component for r in simhash.similar(df, row_col="row", **more).collect()}
        assert got == dict(enumerate(want)), more


def test_recall_right_at_the_similarity(spark):
    """Pairs just above 0.8 and just below: nearly all of the former are linked, none of the latter."""
    rng = random.Random(8)
    rows, linked, apart = [], [], []
    for k in range(120):
        w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for n in (12, 16):  # a changed word is in five shingles: 236 of 356 shared, 216 of 376
            v = list(w)
            for i in range(n):
                v[5 + 18 * i if n == 16 else 5 + 24 * i] = f"c{k}x{i}"
            rows.append(" ".join(v))
        rows.append(" ".join([*w[:-6], *(f"d{k}x{i}" for i in range(6))]))  # 290 shared of 302
        linked.append(len(rows) - 1)
        near = list(w)
        for i in range(6):
            near[40 * i + 7] = f"e{k}x{i}"  # 266 of 326: 0.816
        rows += [" ".join(near), " ".join(w)]
        linked.append(len(rows) - 2)
        apart.append(len(rows) - 5)
    got = {r.row: r.component for r in simhash.similar(spark.createDataFrame(list(enumerate(rows)), "row long, text string"), row_col="row").collect()}
    truth = brute(rows)
    assert all(got[i] >= truth[i] for i in got)
    joined = [i for i, c in enumerate(truth) if c != i]
    assert len(joined) >= 120 and sum(got[i] != i for i in joined) >= 0.95 * len(joined)
    assert all(got[i] == i for i, c in enumerate(truth) if c == i)


def test_stage_keeps_one_of_each_group(spark):
    texts = texts_of(spark)
    want = sorted(set(brute(texts)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(3)
    out = corpus_pipeline.one_of_each_group(spark, df, SF)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == want
    assert corpus_pipeline.one_of_each_group(spark, df.filter(F.lit(False)), SF).count() == 0


def test_stage_keeps_a_row_of_each_text_whatever_its_id(spark):
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, say(0)), (None, say(1)), (None, say(2)), (7, say(3)), (7, say(4)), (8, say(3)), (9, say(5)), (None, say(5)), (9, say(5))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    out = corpus_pipeline.one_of_each_group(spark, df, SF).collect()
    want = [(None, say(0)), (None, say(1)), (None, say(2)), (7, say(3)), (7, say(4)), (9, say(5))]
    assert sorted((repr(r.doc_id), r.text) for r in out) == sorted((repr(i), t) for i, t in want)


def near_copies(n):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    out = []
    for k in range(n):
        v = list(base)
        for i in rng.sample(range(150), rng.randrange(2, 6)):
            v[i] = f"c{k}x{i}"
        out.append(" ".join(v))
    return out


def test_pairs_of_a_large_group_of_near_copies_stay_few(spark, monkeypatch):
    """Many of these are a little below 0.8 of each other; their pairs don't pass from task to task."""
    texts, real, made = near_copies(300), simhash.near_enough, []

    def counted(pairs, *more):
        found = real(pairs, *more)
        made.append((pairs.count(), found.count()))
        return found

    monkeypatch.setattr(simhash, "near_enough", counted)
    got = {r.row: r.component for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3), row_col="row").collect()}
    want = brute(texts)
    assert got == dict(enumerate(want)) and 1 < len(set(want)) < 300
    assert sum(n + m for n, m in made) < 50 * len(texts)


def test_crowds_in_many_cells(spark, monkeypatch):
    """Crowds of any size give what brute force gives, whatever way candidates go."""
    texts = near_copies(80) + texts_of(spark)[:60]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    monkeypatch.setattr(simhash, "CELL_ROWS", 25)
    monkeypatch.setattr(simhash, "CELL_WORDS", 3000)
    want = dict(enumerate(brute(texts)))
    assert {r.row: r.component for r in simhash.similar(df, row_col="row", few=0).collect()} == want
    assert {r.row: r.component for r in simhash.similar(df, row_col="row", few=10**6).collect()} == want
