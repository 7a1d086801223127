import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bench as B
from lodestone.operators import claims as C
from lodestone.operators import graph as G
from lodestone.operators import ledger as L
from lodestone.operators import schedule as SC
from lodestone.operators import search as Q
from lodestone.operators import tables as X
from lodestone.operators import vectors as V
from lodestone.operators import work as W
from lodestone.sources import replay as R
from lodestone.streaming import events as E

CLAIM = "id long, entity_id long, attribute string, value_text string, value_num decimal(38,10), as_of date, grade string, superseded_by long"


def test_contradictions(spark):
    d = dt.date
    rows = [
        (1, 1, "pricing.entry_usd_month", None, 5, d(2024, 1, 1), "A", None), (2, 1, "pricing.entry_usd_month", None, 18, d(2024, 2, 1), "C", None),
        (3, 2, "pricing.model", "Flat", None, None, "B", None), (4, 2, "pricing.model", " flat ", None, None, "C", None),
        (5, 3, "pricing.model", "flat", None, None, "A", None), (6, 3, "pricing.model", "seat", None, None, "D", None),
        (7, 4, "company.stage", None, None, None, "B", None), (8, 4, "company.stage", "", None, d(2024, 1, 1), "B", None),
        (9, 5, "company.stage", "seed", None, d(2023, 1, 1), "B", None), (10, 5, "company.stage", "series-a", None, d(2024, 1, 1), "B", None),
    ]
    from decimal import Decimal

    df = spark.createDataFrame([(*r[:4], None if r[4] is None else Decimal(r[4]), *r[5:]) for r in rows], CLAIM)
    lists = spark.createDataFrame([(20 + i, 6, "product.platforms", v, None, None, "A", None) for i, v in enumerate(["web", "ios"])], CLAIM)
    assert {r.entity_id for r in C.contradictions(df.unionByName(lists)).collect()} == {1, 5}
    assert [r.superseded_by for r in C.resolve_contradictions(lists).collect()] == [None, None]
    out = {r.id: (r.superseded_by, r.contradicted) for r in C.resolve_contradictions(df).collect()}
    assert out[2] == (1, False) and out[1] == (None, True) and out[9] == (10, False) and out[10] == (None, True)
    assert out[6] == (None, False) and out[4] == (None, False) and len(out) == 10
    inputs = F.when(F.col("id") != 10, F.struct(F.col("grade").alias("best_grade"), F.lit(1).alias("n_distinct_domains"), F.lit(30.0).alias("age_days"), F.lit(False).alias("contradicted")))
    scored = {r.id: r for r in C.resolve_contradictions(df.withColumn("confidence", F.lit(0.8)).withColumn("confidence_inputs", inputs)).collect()}
    assert abs(scored[1].confidence - 0.9 * 0.98 * 0.6) < 1e-12 and scored[1].confidence_inputs.contradicted
    assert scored[2].confidence == 0.8 and scored[10].confidence == 0.8 and scored[10].confidence_inputs is None


def test_gate_order(spark):
    rows = [("made.up", "x", None, "q", "q"), ("oss.stars", "x", None, "q", "q"), ("company.stage", "x", None, "zz", "q"), ("company.stage", "x", None, "q", "qq"), ("company.stage", "x", None, "q", "aq")]
    got = C.gate(spark.createDataFrame(rows, "attribute string, value_text string, value_num double, quote string, text string"))
    assert [r.drop_reason for r in got.collect()] == ["invalid_attribute", "value_type_mismatch", "quote_not_in_source", "quote_ambiguous", None]
    assert [(r.char_start, r.char_end) for r in got.collect()][-1] == (1, 2)


def test_coverage_and_promotion(spark):
    t = spark.createDataFrame([("a", "done", None, 3), ("b", "failed", None, 1), ("c", "skipped", "budget_weight", 2), ("d", "skipped", "timeout", 1), ("a", "failed", None, 1)], "kind string, status string, reason string, weight int")
    r = C.coverage(t).first()
    assert r.coverage == 3 / 8 and r.failed_branches == ["b"] and r.budget_skipped_branches == ["c"] and r.other_skipped_branches == ["d"]
    assert C.coverage(t.limit(0)).first().coverage == 0
    themes = spark.createDataFrame([("x", i % 3, 4) for i in range(5)] + [("y", i % 2, 3) for i in range(5)] + [("z", i % 3, 5) for i in range(4)], "t string, source_id int, r int")
    assert [r.t for r in C.promoted(themes, ["t"]).collect()] == ["x"]
    assert {r.t for r in C.promoted(themes, ["t"], reactions="r").collect()} == {"x", "z"}


def test_components_and_aliases(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in G.components(e, spark.createDataFrame([(500,)], "node long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100 and got[500] == 500
    k = spark.createDataFrame([("npm:z", "gh:a/b"), ("gh:a/b", "web:x.com"), ("ph:q", "gh:c/d")], "a string, b string")
    assert {r.key: r.canonical for r in G.canonical_keys(k).collect()} == {"npm:z": "web:x.com", "gh:a/b": "web:x.com", "web:x.com": "web:x.com", "ph:q": "gh:c/d", "gh:c/d": "gh:c/d"}


def test_similar_pairs(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [0.0, 0.0]), (6, [1.0])], "id long, v array<double>")
    for block in (512, 2):
        assert {(r.a, r.b) for r in V.similar_pairs(v, block=block).collect()} == {(1, 2), (1, 4), (2, 4)}


def test_task_graph(spark):
    t = spark.createDataFrame([("r", "a", [], "done"), ("r", "b", ["a"], "pending"), ("r", "c", ["x"], "pending"), ("r", "d", ["c"], "pending"), ("r", "e", ["d"], "pending"), ("r", "f", ["b"], "pending")], "run_id string, node_key string, depends_on array<string>, status string")
    assert [r.node_key for r in G.ready(t).collect()] == ["b"]
    assert {r.node_key for r in G.unreachable(t).collect()} == {"c", "d", "e"}
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "a")], "a string, b string")
    assert {r.node for r in G.cyclic_nodes(e).collect()} == {"b", "c"}
    faults = {(r.fault, r.detail) for r in G.plan_errors(spark.createDataFrame([("a", 50), ("a", 30)], "node_key string, weight int"), e, 70).collect()}
    assert ("duplicate_key", "a") in faults and ("over_budget", "80") in faults and ("undeclared_node", "d") in faults


def test_budget_and_percentiles(spark):
    t = spark.createDataFrame([("r", i, w, 0.5) for i, w in enumerate([3, 4, 2, 1])], "run string, o int, w int, usd double")
    assert [r.admitted for r in L.admit_greedy(t, "run", ["o"], "w", 5).orderBy("o").collect()] == [True, False, True, False]
    paid = [r.reason for r in L.admit_greedy(t, "run", ["o"], "w", 100, usd="usd", usd_cap=1.0).orderBy("o").collect()]
    assert paid == [None, None, "budget_usd", "budget_usd"]
    v = spark.createDataFrame([(float(x),) for x in [5, 1, 9, 3, 7, 11]], "v double")
    r = L.at_ranks(v, [], "v", {"a": L.nearest(0.95), "b": L.nearest(0.5), "c": L.spike()}).first()
    assert (r.a, r.b, r.c) == (11, 5, 11)


def test_numbered_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    got = W.numbered(df, [F.desc("x")], "n", first=0).collect()
    assert {r.x: r.n for r in got} == {x: 999 - x for x in range(1000)}
    assert W.numbered(df.limit(0), [F.asc("x")], "n").count() == 0


def test_checklist(spark):
    nodes = spark.createDataFrame([("r", "a", "k", 1), ("r", "b", "k", 2), ("r", "c", "k", 3), ("r", "d", "m", 4)], "run_id string, node_id string, kind string, pos int")
    rows = [(1, "task.completed", 9, "k"), (2, "task.started", 9, "k"), (3, "task.started", 9, "k"), (4, "task.started", 8, "k"), (5, "task.failed", 8, "k"), (6, "task.started", 5, "m"), (7, "task.completed", 5, "m"), (8, "task.started", 4, "m"), (9, "task.failed", 4, "m")]
    events = spark.createDataFrame([("r", *x) for x in rows], "run_id string, id long, event_type string, task_id long, kind string")
    assert {r.node_id: r.status for r in E.checklist(nodes, events).collect()} == {"a": "running", "b": "failed", "c": "pending", "d": "done"}


def test_schedule(spark):
    t = spark.createDataFrame([("r", 1, "a", [], "done", 0), ("r", 2, "b", ["a"], "pending", 5), ("r", 3, "c", ["a"], "pending", 1), ("r", 4, "d", ["c"], "pending", 0), ("s", 5, "a", ["zz"], "pending", 0)], "run_id string, id long, node_key string, depends_on array<string>, status string, priority int")
    assert [(r.run_id, r.id) for r in SC.next_tasks(t).collect()] == [("r", 3)]
    req = spark.createDataFrame([(1, "h", 0.0), (2, "h", 0.1), (3, "h", 5.0), (4, "g", 0.0)], "i int, h string, at double")
    assert {r.i: r.starts for r in SC.throttled(req, "h", "at", "i").collect()} == {1: 0.0, 2: 0.25, 3: 5.0, 4: 0.0}
    w = t.withColumn("service", F.lit("x"))
    assert {(r.run_id, r.node_key): (r.depth, r.wave) for r in SC.dispatch_waves(w.filter("run_id = 'r'"), {"x": 1}).collect()} == {("r", "a"): (0, 1), ("r", "b"): (1, 2), ("r", "c"): (1, 1), ("r", "d"): (2, 1)}


def test_benchmark_files(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    for i, split in enumerate(["tuning", "held_out"]):
        (tmp_path / f"q0{i}.yaml").write_text(yaml.safe_dump({"id": f"q0{i}", "query": "x", "difficulty": "easy", "split": split, "role": None, "ground_truth": {"must_include": ["a.com"], "facts": [{"entity": "a.com", "attribute": "pricing.model", "value": 5, "verified_on": dt.date(2024, 6, 1), "source": "u"}]}}))
    truth = R.ground_truth(spark, str(tmp_path))
    day = F.lit(dt.date(2024, 6, 30))
    assert [r.query_id for r in B.of_split(truth, "tuning", day).collect()] == ["q00"]
    with pytest.raises(PermissionError):
        B.of_split(truth, "held_out", day)
    assert B.of_split(truth, "held_out", day, confirm=True).count() == 1
    with pytest.raises(Exception, match="stale facts"):
        B.of_split(truth, "tuning", F.lit(dt.date(2024, 9, 30))).collect()
    B.write_snapshot(spark.createDataFrame([("q1", 0.5), ("q2", 1.0)], "query_id string, cost double"), str(tmp_path / "out"), "2024-06-30")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out" / "2024-06-30" / "*" / "*")).collect()) == ['{"cost":0.5,"query_id":"q1"}', '{"cost":1.0,"query_id":"q2"}']


def test_export_and_size(spark, tmp_path):
    X.export({"a": spark.range(5), "b": spark.range(2)}, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x" / "a")).count() == 5
    size = X.stored_bytes(spark, str(tmp_path / "x"), 10_000_000)
    assert size["bytes"] > 0 and 0 < size["share"] < 1


def test_periodic(spark, tmp_path):
    seen = []
    q = E.periodic(spark, 0.2, seen.append, str(tmp_path / "c"))
    try:
        for _ in range(100):
            if len(seen) >= 2:
                break
            q.awaitTermination(0.3)
    finally:
        q.stop()
    assert seen[:2] == [0, 1]


def test_tables(spark):
    s = "k long, v long, note string, is_pinned boolean"
    old = spark.createDataFrame([(1, 1, "a", True), (2, 1, "b", False)], s)
    new = spark.createDataFrame([(1, 2, "c", False), (3, 1, "d", None)], s)
    got = {r.k: (r.note, r.is_pinned) for r in X.upsert(old, new, ["k"], F.col("v"), sticky=["is_pinned"]).collect()}
    assert got == {1: ("c", True), 2: ("b", False), 3: ("d", None)}
    assert [r.k for r in X.insert_ignore(old, new, ["k"], [F.col("v")]).collect()] == [3]
    ids = X.append_events(spark.createDataFrame([(7,)], "id long"), spark.createDataFrame([("x",), ("y",)], "e string"), [F.col("e")])
    assert {r.e: r.id for r in ids.collect()} == {"x": 8, "y": 9}
    evicted = X.evict(spark.createDataFrame([(1, dt.datetime(2024, 1, 1), False, "t"), (2, dt.datetime(2024, 1, 1), True, "t")], "id int, ttl_expires_at timestamp, is_pinned boolean, extracted_text string"), F.lit("2024-06-01").cast("timestamp"))
    assert [r.extracted_text for r in evicted.orderBy("id").collect()] == [None, "t"]


def test_scores(spark):
    r = spark.range(1).select(B.recall(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("r"), B.recall(F.array().cast("array<string>"), F.array(F.lit("b"))).alias("e"), B.precision(F.array(F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("p")).first()
    assert (r.r, r.e, r.p) == (0.5, 1.0, 0.5)
    cur = spark.createDataFrame([("q1", 0.3, 1.6, 1.0, False), ("q07", 0.5, 1.0, 0.9, False), ("q3", 0.0, 9.0, 1.0, False)], "query_id string, recall double, cost double, binding_rate double, contradiction_fired boolean")
    old = spark.createDataFrame([("q1", 0.5, 1.0, True), ("q07", 0.5, 1.0, True)], "query_id string, recall double, cost double, contradiction_fired boolean")
    rules = {(x.query_id, x.rule) for x in B.regressions(cur, old).collect()}
    assert rules == {("q1", "recall_drop"), ("q1", "cost_rise"), ("q07", "unbound"), ("q07", "trap_silent")}
    assert ("q07", "trap_silent") not in {(x.query_id, x.rule) for x in B.regressions(cur, old.withColumn("contradiction_fired", F.lit(False))).collect()}


def test_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"query": "q", "results": [{"url": "u", "title": "t", "text": "x"}, {"url": "v", "title": "t", "text": "y"}], "cost": 0.1}\n')
    assert [(r.rank, r.url) for r in R.search_results(R.read(spark, "search", str(tmp_path)), 1).collect()] == [(0, "u")]
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("p", "a", 1, at(0), 1.0, None), ("p", "b", 2, at(1), 1.0, None), ("p", "c", 3, at(2), 1.0, None), ("p", "d", 4, at(3), 1.0, "boom"), ("p", "e", 5, at(26), 1.0, None), ("q", "f", 6, at(3), 1.0, "boom")]
    req = spark.createDataFrame(rows, "provider string, query string, ord int, at timestamp, cost double, error string")
    cache = spark.createDataFrame([("a", dt.datetime(2030, 1, 1))], "query string, expires_at timestamp")
    got = {r.query: (r.hit, r.charged, r.reason) for r in R.route(req, cache, F.lit("2024-01-01").cast("timestamp"), 1.0).collect()}
    assert got == {"a": (True, 0.0, None), "b": (False, 1.0, None), "c": (False, 0.0, "allowance"), "d": (False, 0.0, "allowance"), "e": (False, 1.0, None), "f": (False, 0.0, "boom")}
    one = lambda text: spark.createDataFrame([(text,)], "value string")
    repos = one('{"items": [{"full_name": "a/b", "html_url": "u", "description": "d", "stargazers_count": 7}]}').select(F.from_json("value", R.SCHEMAS["github_repositories"]).alias("r")).select("r.*")
    assert [(r["rank"], r.full_name, r.stars) for r in R.search_repositories(repos).collect()] == [(0, "a/b", 7)]
    issues = spark.createDataFrame([(1, "t", "https://github.com/o/r/issues/1", (3,), "x"), (2, "t", "https://github.com/o/s/issues/2", (9,), "x")], R.SCHEMAS["github_issues"])
    assert [(r.number, r.repo) for r in R.search_issues(issues, 1).collect()] == [(2, "o/s")]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "s.json").write_text('{"query": "x site:g2.com", "results": [{"url": "https://www.g2.com/p", "title": "t", "text": "s"}, {"url": "https://other.com", "title": "t", "text": "s"}], "cost": 0.1}\n')
    assert [r.url for r in R.aggregator_snippets(R.read(spark, "search", str(tmp_path / "g")), "g2.com").collect()] == ["https://www.g2.com/p"]
    with pytest.raises(ValueError):
        R.aggregator_snippets(repos, "other.com")


def test_lease_stream_matches_batch(spark, tmp_path):
    rows = [(1, 1, "claim", 5), (1, 2, "renew", 5), (1, 3, "complete", 5), (2, 1, "claim", 1), (2, 2, "complete", 9), (2, 3, "sweep", 0), (3, 1, "complete", 1)]
    schema = "task_id long, ord long, command string, token long"
    df = spark.createDataFrame(rows, schema)
    batch = {r.task_id: (r.status, r.token, r.attempts) for r in E.fold_leases(df).collect()}
    assert batch == {1: ("done", 5, 1), 2: ("pending", -1, 1), 3: ("pending", -1, 0)}
    df.write.parquet(str(tmp_path / "in"))
    q = E.lease_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.task_id: (r.status, r.token, r.attempts) for r in spark.table("leases").collect()} == batch


def test_follow_drops_repeats(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1), "view"), (1, dt.datetime(2024, 1, 1), "view"), (2, dt.datetime(2024, 1, 1), "internal")]
    df = spark.createDataFrame(rows, "id long, ts timestamp, event_type string")
    df.write.parquet(str(tmp_path / "in"))
    q = E.follow(spark, str(tmp_path / "in"), df.schema, kinds=["view"]).writeStream.format("memory").queryName("log").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.id for r in spark.table("log").collect()] == [1]


def test_quotes_both_ways(spark):
    docs = spark.createDataFrame([(1, "hello big wide world of text"), (2, "other"), (3, "")], "d int, text string")
    docs = docs.unionByName(spark.createDataFrame([(4, None), (5, "é" * 30)], "d int, text string"))
    quotes = spark.createDataFrame([(1, "big wide world of"), (2, "other"), (3, "zz"), (4, "o"), (5, ""), (6, "é" * 20), (7, None)], "q int, quote string")
    few = {(r.d, r.q) for r in Q.quotes_in(docs, quotes, "text", "quote").collect()}
    assert few == {(r.d, r.q) for r in Q.quotes_in(docs, quotes, "text", "quote", most_bits=1 << 7).collect()} == {(1, 1), (2, 2), (1, 4), (2, 4), (5, 6)}
