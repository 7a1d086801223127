"""The licence scan against a plain program over words."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import licenses
from lodestone.llm._common import table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(docs):
    texts = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for _, t in docs]
    index = [dict(licenses._indexed(t.split())) for _, t, _ in licenses.TEMPLATES]
    known = {w for t in index for w in t.values()}
    df = defaultdict(int)
    for w in texts:
        for x in set(w) & known:
            df[x] += 1
    out = []
    for (i, _), w in zip(docs, texts, strict=True):
        at = lambda start, phrase: start >= 0 and w[start : start + len(phrase.split())] == phrase.split()  # noqa: B023, E731
        places = [(p, label) for phrase, label in licenses.BASE.items() for p in range(len(w)) if at(p, phrase)]
        labels, share = {x for _, x in places}, 0.0
        for (label, text, keys), words in zip(licenses.TEMPLATES, index, strict=True):
            chosen = sorted(set(words.values()) & set(w), key=lambda x: (df[x], x))[: licenses.LOOKUPS]
            for start in {p - k for p, x in enumerate(w) for k, y in words.items() if x == y and x in chosen}:
                matched = sum(0 <= start + k < len(w) and w[start + k] == x for k, x in words.items())
                place = [len(re.split(rf"\b{k}\b", text)[0].split()) for k in keys]
                if 2 * matched >= len(words) and all(at(start + p, k) for p, k in zip(place, keys, strict=True)):
                    labels.add(label)
                    share = max(share, matched / len(words))
        own = ",".join(sorted({x for _, x in places}))
        out.append(repr((i, len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), own, ",".join(sorted(labels)), 1.0 if places else share)))
    return sorted(out)


def shown(df):
    return sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)) for r in df.collect())


def test_query(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert shown(licenses.op11_licenses(spark, SF)) == by_hand(docs)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    made = [(None, "cc by"), (None, None), (1, ""), (2, "CC-BY cc_by cc  by! ccby"), (3, "all rights all rights reserved"), (4, "the Kelvin sign: worK is licensed"), (5, "filler " * 60_000 + "general public license"), (6, "MIT license"), (6, "MIT license"), (7, "mit or license")]
    vocabulary = sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()}) + ["filler", "É", "7"]
    for i in range(8, 60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            k = rng.randrange(len(w) + 1)
            w[k:k] = t[rng.randrange(3) :]
        made.append((i, rng.choice((" ", ", ", "\n")).join(w)))
    return made


def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = by_hand(rows)
    assert shown(licenses.scan(docs)) == want and sum("mit" in x for x in want) > 2
    clash = docs.withColumns({c: F.lit(f"own {c}") for c in ("row", "w", "hits", "places", "labels", "found", "score", "template", "word", "n_words")})
    assert shown(licenses.scan(clash)) == want
    assert licenses.scan(docs.limit(0)).count() == 0
    assert all(0 < x.matched <= x.of for r in licenses.scan(docs).collect() for x in r.found or [])


def test_plan_is_native(spark):
    plan = licenses.op11_licenses(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)
