"""The ten operators against brute force, exact round trips or held-out accuracy, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, mixing, packing, quality, simhash, substrings, token_counts, topk, toxicity, warc
from lodestone.llm._common import Workspace, table
from lodestone.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "Ünïcode ’s <|endoftext|> x", "日本語 " * 40, "word " * 3000, "x" * 5000, "same text", "same text"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def sample(spark):
    return [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").collect()]


def test_token_counts(spark, sample):
    from tokenizers import Tokenizer

    random.seed(3)
    path = P.path("word_bpe_49k.json")
    letters = "abcdefgh'ABC éèß  \n.,!?12$%’—日\x1c"
    texts = [*ODD, *sample[:60], *("".join(random.choice(letters) for _ in range(random.randint(1, 900))) for _ in range(150)), "don't they'll 're 'sup !!'s", "a" * 1000]
    texts += ["".join(random.choice("qwertzuiopasdfghjkl") for _ in range(2_000_000)), "x" * 97 + "'ll" + "y" * 97, "".join(random.choice("abc'12!日é") for _ in range(20_000))]
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_tokens, r.n_bytes) for r in token_counts.count_tokens(docs(spark, texts), path).collect()}
    assert got == {i: (len(tok.encode(t or "", add_special_tokens=False).ids), len((t or "").encode())) for i, t in enumerate(texts)}


def test_table_stays_bounded(monkeypatch, sample):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    monkeypatch.setattr(token_counts, "MOST_STATES", 500)
    machine, tok = token_counts.Transducer(path), Tokenizer.from_file(path)
    assert machine.counts(sample[:80]).tolist() == [len(tok.encode(t or "", add_special_tokens=False).ids) for t in sample[:80]]
    assert len(machine.states) == 500


def test_piece_maps_compose(monkeypatch):
    """Pieces whose state before was guessed wrong are walked again."""
    path = P.path("word_bpe_49k.json")
    machine = token_counts.Transducer(path)
    words = ["".join(random.Random(k).choice("etaoinshrdlu") for _ in range(700)) for k in range(5)] + ["a" * 700, "the" * 200]
    want = [machine.walk.run(w)[1] for w in words]
    monkeypatch.setattr(token_counts, "PIECE", 40)
    for warm in (30, 3, 1):
        monkeypatch.setattr(token_counts, "WARM", warm)
        assert [machine.walk.word(w) for w in words] == want


def test_packing_is_a_partition(spark, sample):
    from tokenizers import Tokenizer

    texts, path = [*ODD, *sample[:80]], P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    out = packing.pack_documents(docs(spark, texts).repartition(3), path, ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
    for i, t in enumerate(texts):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == want and all(r.doc_tokens == len(want) for r in pieces)
    for rs in by_seq.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == list(np.cumsum([0, *(r.length for r in rs)])[:-1])
        n = sum(r.length for r in rs)
        assert n == 2048 or n < 2048 and n & (n - 1) == 0


def test_sum_of_squares_choice():
    """Every choice leaves the smallest sum of squared level counts that any fill could, ties to the fuller window; nothing is lost."""
    rng = random.Random(4)
    b, window, seen, fed = packing.SumOfSquares(32), 32, [], {}
    fill: dict[int, int] = {}  # fills of the open windows, kept beside

    def squares(levels):
        return sum(n * n for f, n in Counter(levels).items() if 0 < f < window)

    for item in range(3000):
        n = rng.choice([1, 2, 3, 5, 8, 13, 21, 31, 32, 40, 77])
        rest = n % window
        options = {}
        for f in {0, *fill.values()}:
            if rest and f + rest <= window:
                left = list(fill.values())
                if f:
                    left.remove(f)
                options[f] = squares([*left, f + rest])
        before = dict(fill)
        out = list(b.put(item, n))
        fed[item] = n
        seen += out
        if rest:
            least = min(options.values())
            chosen = max(f for f, v in options.items() if v == least)
            levels = Counter(before.values())
            if chosen:
                levels[chosen] -= 1
            if chosen + rest < window:
                levels[chosen + rest] += 1
            assert {f: int(b.levels[f]) for f in range(1, window) if b.levels[f]} == {f: c for f, c in levels.items() if c}
            fill = dict(enumerate(f for f, c in levels.items() for _ in range(c)))
    seen += list(b.flush())
    got = Counter()
    for item, _, length, _, _ in seen:
        got[item] += length
    assert got == fed


def test_quality_counts(spark, sample):
    texts = [*ODD, *sample[:60], ("a b c d e f g h i " * 4), "x\nx\n\nx y\nx"]

    def brute(t):
        w = (t or "").encode().split()
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)

    got = {r.doc_id: r for r in quality.judge(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t)
        d = quality.read((t or "").encode())
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and not any(rule(d) for rule in quality.RULES.values()))


def test_language_id(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    train = d.filter(langid.fold(F.col("doc_id"), 3) != 1).select("lang", "text", F.col("doc_id").alias("key"))
    model = langid.train_model(train)
    odd = {r.doc_id: r for r in langid.identify(docs(spark, ODD), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2, 3)) and odd[4].lang_pred != "und"
    held = langid.identify(d.filter(langid.fold(F.col("doc_id"), 3) == 1), model).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in held)
    none = langid.train_model(train.limit(0))
    assert {r.lang_pred for r in langid.identify(docs(spark, ODD), none).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    codes, n = np.unique(langid._grams(*langid._codes(["the cat sat on the mat", "a cat"]), langid.ORDER)[0], return_counts=True)
    model = langid.fit([("en", codes, n.astype(float))])
    symbols = sorted({int(c) & 0xFFFF for c in codes})
    context = int(codes[3]) >> 16
    p = np.exp(model.logp(np.array([context << 16 | s for s in symbols], np.uint64), langid.ORDER)[:, 0])
    assert 0.9 < p.sum() <= 1 + 1e-9


def test_warc_round_trip(spark):
    fake = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, b"a" * 150), (2, b"a" * 150), (3, None), (4, b""), (5, fake * 30), (6, b"x" * 99), (7, b"x" * 99), (8, b"\xff\r\n\r\n" + fake + b"WARC/1.1"), (9, b"WARC/1.1\r\n"), (10, fake * 30), (None, b"q" * 200), (12, b"q" * 200)]
    rows += [(100 + i, b"WARC/1.1\r\n" * (i % 7) + b"z%d " % i * 50) for i in range(30)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        ws = Workspace(spark, "warc-test")
        warc.archive(spark.createDataFrame(rows, "page_id long, html binary").repartition(2), f"{ws.root}/a")
        got = warc.read_archives(spark, f"{ws.root}/a", ws).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert Counter((r.id, r.payload_digest, r.payload_bytes) for r in got) == Counter((i, hashlib.sha256(b or b"").hexdigest(), len(b or b"")) for i, b in rows)
    assert all(r.header_digest == r.payload_digest for r in got) and len({r.record for r in got}) == len(got)
    raw = b"".join(p.read_bytes() for p in Path(f"{ws.root}/a".removeprefix("file://")).glob("part-*"))
    for field in (rb"WARC-Record-ID: <urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", rb"WARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ"):
        assert len(re.findall(field + rb"\r\n", raw)) == len(rows)
    assert raw.count(b"WARC-Profile: ") == raw.count(b"WARC-Type: revisit") == 3
    assert {(r.id, r.refers_to) for r in got if r.type == "revisit"} == {(2, 1), (10, 5), (None, 12)}


def test_components(spark):
    ws = Workspace(spark, "cc")
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (5, 5)], "u long, v long")
    assert {r.u: r.v for r in components(ws, e).collect()} == {**{i: 0 for i in range(1, 41)}, 91: 90}


def test_simhash_links_all(spark, sample):
    import xxhash

    rng = random.Random(1)
    texts = [*ODD, *sample[:60]]
    for t in sample[:20]:
        w = t.split()
        if len(w) > 50:
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))

    def print_of(t):
        w = (t or "").encode().translate(simhash._LOWER).split()
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fp = [print_of(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (fp[i], root[i]) for i in range(len(texts))}


def test_covering_meets_every_pair(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    parts = [x]
    for flips in range(1, 6):
        y = x.copy()
        for _ in range(flips):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y), dtype=np.uint64)
        parts.append(y)
    x = np.unique(np.concatenate(parts))
    p, q = np.nonzero(np.bitwise_count(x[:, None] ^ x) <= 4)
    want = dict(zip(*map(np.ndarray.tolist, simhash.forest(x[p], x[q])), strict=True))
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    for hot in (simhash.HOT, 20):
        found = simhash.links(Workspace(spark, "links"), df, hot=hot).collect()
        u, v = (np.array([r[k] for r in found], np.int64).view(np.uint64) for k in (0, 1))
        assert dict(zip(*map(np.ndarray.tolist, simhash.forest(u, v)), strict=True)) == want


def test_repeats_against_brute_force(spark):
    random.seed(7)
    syllables = ["the", "of", "anré", "tion", "qu", "x", "sch"]
    say = lambda n: "".join(random.choice(syllables) + random.choice(["", " "]) for _ in range(n))
    shared = [say(80) for _ in range(5)]
    texts = [*ODD, "a" * 1500, "ab" * 300, "x" * 99, "x" * 100, "x" * 100]
    for _ in range(60):
        t = say(random.randint(0, 40))
        for _ in range(random.randint(0, 3)):
            s = random.choice(shared)
            i = random.randint(0, len(s) // 2)
            t += s[i : i + random.randint(50, 300)] + say(random.randint(0, 9))
        texts.append(t)
    texts += [shared[0] + say(20) for _ in range(30)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        want[i] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs(spark, texts).repartition(5)).collect()}
    assert got == want


def test_repeated_rows_of_one_id(spark):
    t = "one two three four five six seven eight nine ten " * 3
    df = spark.createDataFrame([(1, t), (1, t), (None, t[:120])], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_removed) for r in substrings.remove_repeats(df).collect())
    assert got[0][0] == -1 and len(got) == 3 and got[2][1] == len(t)


def test_mixing(spark):
    df = docs(spark, [f"t{i}" for i in range(3000)])
    even = mixing.mix(df, smoothing=0.0, epochs=2.0)
    assert [r.asDict() for r in even.collect()] == [r.asDict() for r in even.collect()]
    n = {r.source: r["count"] for r in even.groupBy("source").count().collect()}
    assert set(n) == {None, "s0", "s1", "s2"} and all(abs(v - 1500) < 200 for v in n.values())
    assert mixing.mix(df, weights={"s1": 1.0}).select("source").distinct().collect() == [("s1",)]
    big = mixing.mix(df.limit(50), smoothing=1.0, epochs=200.0).count()
    assert abs(big - 10_000) < 500
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df, weights={}).count() == mixing.mix(df, weights={"none": 1.0}).count() == 0
    clash = df.withColumn("replica", F.lit(9)).withColumn("cdf", F.lit("x")).withColumn("key", F.lit(1)).withColumn("row", F.lit(2))
    got = mixing.mix(clash, smoothing=0.0, epochs=2.0)
    assert got.columns == [*clash.columns, "replica_1"]
    assert sorted((r.doc_id, r.replica, r.cdf, r.key, r.row, r.replica_1) for r in got.collect()) == sorted((r.doc_id, 9, "x", 1, 2, r.replica) for r in even.collect())


def test_toxicity_learns_words_and_stems(spark):
    d, lab = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = toxicity.fit(d, lab.filter(~toxicity.held_out(F.col("doc_id"))))
    got = toxicity.score(d, model).join(lab, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.93 * len(got)
    odd = toxicity.score(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in toxicity.score(docs(spark, ["a"]), toxicity.fit(d, lab.limit(0))).collect()} == {0.0}
    assert toxicity.score(d.limit(0), model).count() == 0


def test_gradients():
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    word, gram, there = toxicity.features([b"good", b"bad", b"words"])
    ids, y = np.array([[1, 2, 3, 0], [3, 2, 0, 0]]), np.array([1.0, 0.0])
    _, g = net.gradients(word, gram, there, ids, y)
    for name in ("wo", "va", "wa", "uf", "ub", "wf", "cb"):
        at = tuple(0 for _ in net.p[name].shape)
        e, losses = 1e-3, []
        for s in (1, -1):
            net.p[name][at] += s * e
            losses.append(net.gradients(word, gram, there, ids, y)[0])
            net.p[name][at] -= s * e
        assert abs((losses[0] - losses[1]) / (2 * e) - g[name][at]) < 2e-3


def test_topk_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 64]) for i in range(300)]
    rows += [(1000, None), (1001, [float("nan")] * 4), (1020, [None, 0.0, 0.0, 0.0]), (1021, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    x = np.floor(64 * np.array([np.float32(v) for _, v in rows[:300]], float)).astype(int)
    s = x @ x.T
    want = {}
    for q in range(0, 300, 20):
        order = sorted((c for c in range(300) if c != q), key=lambda c: (-s[q, c], c))[:20]
        want |= {(q, k + 1): (c, s[q, c]) for k, c in enumerate(order)}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 20 == 0, 20, block=32, bins=4).collect()}
    assert got == want
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 20 == 0, 20, block=32, wave=7).collect()}
    assert got == want
    few = topk.search(df.filter("vec_id < 5"), F.col("vec_id") == 0, 20).collect()
    assert len(few) == 4
    assert topk.search(df.limit(0), F.lit(True), 3).count() == 0


def test_topk_lengths_and_large_numbers(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=3 + i % 3)]) for i in range(90)]
    rows += [(90, [1e12, -1e12, 3.0]), (91, [1e9, 2.0, 1e12]), (92, [1e300, 1.0, 1.0]), (93, [-1e300, 1e300, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    want = []
    for q, x in whole:
        if q % 6 == 0:
            met = sorted((-max(-topk._TOP, min(topk._TOP, sum(a * b for a, b in zip(x, y, strict=True)))), c) for c, y in whole if c != q and len(x) == len(y))
            want += [(q, k + 1, c, -n) for k, (n, c) in enumerate(met[:5])]
    got = topk.search(df, F.col("vec_id") % 6 == 0, 5, block=8).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = table(spark, "/root/testdata/sf0.001", "documents")
    at, ws = d, Workspace(spark, "stages")
    for name, stage in corpus_pipeline.STAGES:
        out = ws.keep(name, stage(spark, at, "/root/testdata/sf0.001"))
        if name != "packing":
            assert out.columns == d.columns and 0 < out.count()
        at = out
    sums = at.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sums and at.count() > 0


@pytest.mark.parametrize("name", ["op1_language_id", "op2_warc", "op3_simhash", "op4_substrings", "op5_packing", "op6_quality", "op7_mixing", "op8_token_counts", "op9_toxicity", "op10_topk"])
def test_queries_against_sql(spark, name):
    import duckdb

    from lodestone.llm import registry

    sf = "/root/testdata/sf0.001"
    df = registry.queries()[name](spark, sf)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert rows
    if sql := registry.oracle_sql().get(name):
        c = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        r = c.sql(sql)
        assert sorted(r.columns) == sorted(df.columns)
        assert sorted(map(repr, rows)) == sorted(map(repr, r.select(*sorted(r.columns)).fetchall()))
