"""Ledgers, metrics, budgets, caches, task graphs, event logs and benchmark scores over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scoring as S
from lodestone.operators import bench as B
from lodestone.operators import claims as C
from lodestone.operators import graph as G
from lodestone.operators import ledger as L
from lodestone.operators import report as P
from lodestone.operators import runs as RUN
from lodestone.operators import tables as X
from lodestone.operators import vectors as V
from lodestone.plans._common import now, table
from lodestone.plans.evidence import quoting_claims
from lodestone.sources import replay as R
from lodestone.streaming import events as E


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.status_counts(table(spark, d, "events"), "event_type", ["view", "signup", "purchase", "error", "click", "refund"])


def failure_rates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 10).alias("bucket")).agg(F.round(L.ratio(F.col("event_type") == "error", empty=0.0), 9).alias("failure_rate"))


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("v", F.col("o_totalprice").cast("double"))
    ranks = L.at_ranks(o, ["o_orderpriority"], "v", {"rank95": L.nearest(0.95), "rank50": L.nearest(0.5), "spike95": L.spike()})
    cont = L.continuous(o, ["o_orderpriority"], "v", {"cont95": 0.95}).withColumn("cont95", F.round("cont95", 4))
    return o.groupBy("o_orderpriority").agg(F.round(F.avg("v"), 4).alias("mean")).join(cont, "o_orderpriority").join(ranks, "o_orderpriority")


def percentiles_whole(spark: SparkSession, d: str) -> DataFrame:
    """All lines as one group: nearest ranks and interpolated percentiles of their prices."""
    li = table(spark, d, "lineitem").withColumn("v", F.col("l_extendedprice").cast("double"))
    ranks = L.at_ranks(li, [], "v", {"rank95": L.nearest(0.95), "rank50": L.nearest(0.5), "spike95": L.spike()})
    return ranks.join(L.continuous(li, [], "v", {"cont95": 0.95, "cont50": 0.5}).select(*(F.round(c, 6).alias(c) for c in ("cont95", "cont50"))))


def rolling_spend(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 17).alias("credits"))
    return L.rolling_sum(e, ["user_id"], "ts", "credits").select("event_id", F.col("rolling").cast("long").alias("rolling"))


def greedy_budget(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 3 % 5 + 1).cast("long").alias("weight"), F.col("l_quantity").alias("usd"))
    return L.admit_greedy(li, "l_orderkey", ["l_linenumber", "usd"], "weight", 11, usd="usd", usd_cap=60.0).select("l_orderkey", "l_linenumber", "weight", "admitted", "reason")


def counter_budget(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id")
    return L.within_counter(e, "user_id", [F.asc("event_id")], 4)


def queue_positions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "running").when(F.col("s_suppkey") % 3 == 1, "queued").otherwise("done").alias("status"))
    return L.queue_positions(c, "status", [F.asc("s_suppkey")]).select("s_suppkey", "position")


def admission(spark: SparkSession, d: str) -> DataFrame:
    """Whether each user may start another run at the end of the log: own and global counts of its last 24 hours."""
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    runs = e.select("user_id", F.col("ts").alias("started_at")).join(F.broadcast(last))
    return L.admissible(runs, F.col("last"), per_user=3, globally=1_000_000)


def drop_rate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stats = e.select(F.col("event_id").alias("claims_bound"), F.from_json("props", "map<string,bigint>").alias("claims_dropped"))
    return L.drop_rate(stats).select(F.round("drop_rate", 12).alias("drop_rate"))


def drop_breakdown(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("reason", "n"))
    return e.groupBy("event_type", "reason").agg(F.sum("n").alias("n"))


def llm_costs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 2 == 0, "deepseek/deepseek-v4-flash").otherwise("openai/text-embedding-3-small").alias("model"), F.length("text").alias("i"), (F.length("text") % 50).alias("o"), (F.length("text") % 7 * 10).alias("c"))
    return c.groupBy("model").agg(F.round(F.sum(S.cost_usd(F.col("model"), F.col("i"), F.col("o"), F.col("c"))), 9).alias("cost_usd"), F.count("*").alias("calls"))


def breaches(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").groupBy("event_type").agg(F.avg(F.col("value").cast("double")).alias("v"), F.count("*").alias("n"))
    return r.select("event_type", S.breached(F.col("v"), F.lit(50.0), F.col("event_type") == "view").alias("breached"))


def retry_plan(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, [200, 404, 429, 500, 502, 503])), (F.col("s_suppkey") % 6 + 1).cast("int")).alias("status"))
    return s.select("s_suppkey", S.is_retryable(F.col("status"), F.lit(False)).alias("retry"), S.backoff_limit(F.col("s_suppkey") % 9).alias("longest_s"))


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tasks: each depends on the customer's order before."""
    from pyspark.sql import Window

    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    before = F.lag("k").over(Window.partitionBy("run_id").orderBy("k"))
    status = F.when(F.col("k") % 7 == 0, "failed").when(F.col("k") % 2 == 0, "done").otherwise("pending")
    return o.select("run_id", F.col("k").cast("string").alias("node_key"), F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.array(before.cast("string"))).alias("depends_on"), status.alias("status"))


def ready_tasks(spark: SparkSession, d: str) -> DataFrame:
    return G.ready(_tasks(spark, d)).select("run_id", "node_key")


def dead_tasks(spark: SparkSession, d: str) -> DataFrame:
    return G.unreachable(_tasks(spark, d))


KINDS = {"discover_competitors": "query_variants", "mine_community": "keywords"}


def plan_faults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = table(spark, d, "nation")
    kind = F.element_at(F.array(*map(F.lit, ["discover_competitors", "mine_community", "oss_profile"])), (k % 3 + 1).cast("int"))
    args = F.when(k % 4 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.when(k % 3 == 0, "query_variants").otherwise("keywords"), F.lit("x")))
    tasks = n.select((k - k.isin(7, 8).cast("int")).cast("string").alias("node_key"), (k % 5 + 1).alias("weight"), kind.alias("kind"), args.alias("args"))
    edges = n.select(k.cast("string").alias("a"), ((k * 7 + 3) % 26).cast("string").alias("b"))
    return G.plan_errors(tasks, edges, 70, needs=KINDS)


def edge_inversion(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("a"), F.col("n_regionkey").cast("string").alias("b"))
    return G.depends_on(n).select("node_key", F.array_join("depends_on", ",").alias("deps"))


def event_replay(spark: SparkSession, d: str) -> DataFrame:
    return E.replay(table(spark, d, "events"), F.lit(100), key="event_id", kinds=["view", "purchase", "error"]).select("event_id", "event_type", "user_id")


def checklist(spark: SparkSession, d: str) -> DataFrame:
    """Customers as nodes of fifty plans, events as those of their tasks; starts are delivered more than once."""
    c, e = table(spark, d, "customer"), table(spark, d, "events")
    nodes = c.select((F.col("c_custkey") % 50).alias("run_id"), F.col("c_custkey").alias("node_id"), (F.col("c_custkey") % 5).cast("string").alias("kind"), F.col("c_custkey").alias("pos"))
    what = F.when(F.col("event_type").isin("view", "signup"), "task.started").when(F.col("event_type") == "purchase", "task.completed").when(F.col("event_type") == "error", "task.failed").otherwise("other")
    task = F.col("event_id") % 40
    events = e.select((F.col("user_id") % 50).alias("run_id"), F.col("event_id").alias("id"), what.alias("event_type"), task.alias("task_id"), (task % 5).cast("string").alias("kind"))
    return E.checklist(nodes, events).select("run_id", "node_id", "status")


def lease_fold(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as lease commands; view claims, click renews, purchase completes, error fails."""
    e = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("ord"), F.element_at(F.create_map(*[F.lit(x) for kv in {"view": "claim", "click": "renew", "purchase": "complete", "error": "fail", "signup": "sweep"}.items() for x in kv]), F.col("event_type")).alias("command"), (F.col("event_id") % 2).alias("token"))
    return E.fold_leases(e).withColumn("attempts", F.col("attempts").cast("long"))


def eviction(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("extracted_text"), (F.col("doc_id") % 4 == 0).alias("is_pinned"), F.when(F.col("doc_id") % 3 == 0, now() - F.expr("interval 1 day")).otherwise(now() + F.expr("interval 1 day")).alias("ttl_expires_at"))
    return X.evict(docs, now()).select("doc_id", F.sha2("extracted_text", 256).alias("text_hash"))


def retention(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    return X.retain(e.join(F.broadcast(last)), F.col("last"), 10, at="ts").select("event_id")


def pinning(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50 == 0).alias("is_pinned"))
    return X.pin(docs, table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("source_id"))).select("id", "is_pinned")


def sticky_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("note"), (F.col("o_orderkey") % 2 == 0).alias("is_pinned"))
    return X.upsert(o.filter("version % 3 = 0"), o.filter("version % 3 != 0"), ["k"], F.col("version"), sticky=["is_pinned"])


def merged_meta(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    m = X.merge_maps(F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.col("s_suppkey").cast("string")), F.create_map(F.lit("a"), F.col("s_nationkey").cast("string")))
    return s.select("s_suppkey", m["a"].alias("a"), m["b"].alias("b"))


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id")
    cache = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, now() + F.expr("interval 1 hour")).otherwise(now() - F.expr("interval 1 hour")).alias("expires_at"))
    return X.cached(e, cache, ["user_id"], now()).select("event_id", "user_id", "hit")


def cache_any_age(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id")
    cache = table(spark, d, "customer").filter("c_custkey % 2 = 1").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return X.cached(e, cache, ["user_id"], now(), expires=None).select("event_id", "name", "hit")


def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Texts by their key, each once, that no vector is kept of."""
    key = X.cache_key(F.col("lang"), F.col("source"), (F.col("n_chars") % 50).alias("k"))
    docs = table(spark, d, "documents").select("doc_id", key.alias("key"))
    return X.not_cached(docs.select("key"), docs.filter("doc_id % 3 = 0"), ["key"])


def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    entities = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("entity_key"), F.col("s_suppkey").alias("id"))
    aliases = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("alias_key"), (F.col("p_partkey") + 100_000).alias("entity_id"))
    return X.resolve_alias(keys, entities, aliases)


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, d, "customer")
    entities = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("web:"), F.col("c_custkey").cast("string")).alias("entity_key"))
    aliases = c.filter("c_custkey % 4 > 1").select(F.concat(F.lit("old:"), F.col("c_custkey").cast("string")).alias("alias_key"), F.col("c_custkey").alias("entity_id"))
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity_id"))
    canon = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - F.col("c_custkey") % 3).alias("canonical_id"))
    return X.merge_entities(entities, aliases, claims, canon)


def entity_merge(spark: SparkSession, d: str) -> DataFrame:
    """Entities that are left, and how many claims each has by then."""
    kept, _, claims = _merged(spark, d)
    return kept.join(claims.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", "entity_key", F.coalesce("n", F.lit(0)).alias("n"))


def merged_aliases(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)[1]


def recall_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    sets = e.groupBy("user_id").agg(F.collect_set("event_type").alias("found"))
    want, absent = F.array(F.lit("view"), F.lit("purchase"), F.lit("refund")), F.array(F.lit("error"))
    return sets.select("user_id", F.round(B.recall(want, F.col("found")), 9).alias("recall"), F.round(B.precision(absent, F.col("found")), 9).alias("precision"))


def fact_accuracy(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", F.col("p_retailprice").cast("double").alias("x"))
    ok = S.fact_matches(F.lit("numeric"), F.round("x", 0).cast("string"), (F.col("x") + F.col("x") % 3).cast("string"))
    return p.groupBy("p_brand").agg(F.round(B.fact_accuracy(ok), 9).alias("fact_accuracy"))


def regressions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(F.concat(F.lit("q"), F.lpad(k.cast("string"), 2, "0")).alias("query_id"), k.alias("k"))
    k = F.col("k")
    cur = s.select("query_id", "k", (k % 10 / 10.0).alias("recall"), (k % 7).cast("double").alias("cost"), F.when(k % 9 == 0, 0.5).otherwise(1.0).alias("binding_rate"), (k % 2 == 0).alias("contradiction_fired"))
    old = s.filter("k % 8 != 0").select("query_id", "k", F.lit(0.45).alias("recall"), (k % 4).cast("double").alias("cost"), F.lit(True).alias("contradiction_fired"))
    return B.regressions(cur, old, keys=("query_id", "k"))  # two digits name ten suppliers or more beyond a hundred


def stale_facts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("verified_on"))
    return B.stale_facts(o, F.lit("1998-01-01").cast("date"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b.distinct()).withColumn("side", F.lit("left")))


def star_velocity(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    stars = e.select(F.col("user_id").alias("repo"), F.col("ts").alias("starred_at")).join(F.broadcast(last))
    return R.star_velocity(stars, F.col("last")).select("repo", "stars", F.round("velocity", 9).alias("velocity"))


def archive_rows(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses as header-row JSON, read back as records."""
    p = table(spark, d, "pages").select("page_id", F.to_json(F.array(F.array(F.lit("original"), F.lit("statuscode")), F.array("url", F.lit("200")), F.array("url", F.lit("404")))).alias("body"))
    return R.header_rows(p, "body", ["page_id"]).select("page_id", F.col("record")["original"].alias("url"), F.col("record")["statuscode"].cast("int").alias("status"))


def page_views(spark: SparkSession, d: str) -> DataFrame:
    """Users as articles with a row of views for each event, spread over two years; the last twelve whole months count."""
    e = table(spark, d, "events").withColumn("day", F.date_sub(F.lit("2024-07-31").cast("date"), (F.col("event_id") % 730).cast("int")))
    raw = e.groupBy(F.col("user_id").alias("article")).agg(F.collect_list(F.struct(F.concat(F.date_format("day", "yyyyMMdd"), F.lit("00")).alias("timestamp"), (F.col("event_id") % 5).alias("views"))).alias("items"))
    return R.twelve_months(raw, now())


def rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def path_guess(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.functions import fixed
    from lodestone.operators import discover as D

    s = table(spark, d, "supplier").select("s_suppkey", F.posexplode(F.array(*map(F.lit, fixed.PATHS["pricing"][: fixed.PATH_ATTEMPTS]))).alias("pos", "path"))
    return D.first_success(s.withColumn("ok", (F.col("s_suppkey") + F.col("pos")) % 5 == 0), ["s_suppkey"])


def source_claims(spark: SparkSession, d: str) -> DataFrame:
    """Lines as claims, the first of an order supersedes its others: winners and losers as the report's section lists them."""
    k = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    li = table(spark, d, "lineitem").select(k.alias("id"), F.col("l_orderkey").alias("entity_id"), F.lit("pricing.model").alias("attribute"), F.col("l_linestatus").alias("value_text"), F.col("l_quantity").alias("value_num"), F.lit("B").alias("grade"), F.when(F.col("l_linenumber") > 1, (F.col("l_orderkey") * 10 + 1).cast("long")).alias("superseded_by"))
    out = P.contradiction_section(li).select("entity_id", F.explode("values").alias("v"))
    return out.select("entity_id", "v.src", "v.lost", "v.v")


def report_competitors(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as competitors: model, price and free tier from three claims each, one of them missing for some."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("entity_id"))
    k = F.col("entity_id")
    made = lambda n, attribute, text, num: s.filter(text.isNotNull() if text is not None else num.isNotNull()).select((k * 10 + n).alias("id"), "entity_id", F.lit(attribute).alias("attribute"), (F.lit(None).cast("string") if text is None else text).alias("value_text"), (F.lit(None).cast("double") if num is None else num).alias("value_num"), F.lit(None).cast("long").alias("superseded_by"))
    claims = X.union(made(1, "pricing.model", F.when(k % 3 == 0, "free").otherwise("seat"), None), made(2, "pricing.entry_usd_month", None, F.when(k % 2 == 0, k * 1.5)), made(3, "pricing.free_tier", F.when(k % 5 != 0, F.when(k % 4 == 0, "true").otherwise("false")), None), made(4, "product.platforms", F.when(k % 7 == 0, "web"), None), made(5, "product.platforms", F.when(k % 7 == 0, "ios"), None))
    entities = s.select(F.col("entity_id").alias("id"), F.when(k % 2 == 0, "indie").alias("maturity"))
    return P.competitors(claims, entities).select("entity_id", "model", "price", "free_tier", "positioning")


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs, lines as tasks; thresholds decide what breaches."""
    o, li, e = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "events")
    at = F.to_timestamp_ntz(F.lit("1998-06-30 00:00:00"))
    runs = o.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("cost_usd"), F.col("o_orderdate").cast("timestamp_ntz").alias("started_at"), (F.col("o_orderdate").cast("timestamp_ntz") + F.make_interval(mins=(F.col("o_orderkey") % 90).cast("int"))).alias("finished_at"))
    tasks = li.select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linenumber") == 3, "failed").otherwise("done").alias("status"))
    claims, sources = quoting_claims(spark, d)
    stats = e.select(F.col("event_id").alias("claims_bound"), F.from_json("props", "map<string,bigint>").alias("claims_dropped"))
    out = RUN.metrics(runs, tasks, claims, sources, stats, {"cost_per_run": 100.0, "task_failure_rate": 0.5, "binding_rate": 1.0}, at)
    return out.select("key", F.round("value", 6).alias("value"), "threshold", "breached")


def similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of vectors of cosine 0.2 or more."""
    v = table(spark, d, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return V.similar_pairs(v, 0.2).select("a", "b", F.round("score", 6).alias("score"))


SQL = {
    "report_competitors": """
SELECT * FROM (SELECT s_suppkey::BIGINT AS entity_id, CASE WHEN s_suppkey % 3 = 0 THEN 'free' ELSE 'seat' END AS model, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 1.5::DOUBLE WHEN s_suppkey % 3 = 0 THEN 0 END AS price, s_suppkey % 4 = 0 AS free_tier,
 CASE WHEN s_suppkey % 2 = 0 THEN 'Indie' ELSE 'Unclassified' END || ' competitor' || CASE WHEN s_suppkey % 7 = 0 THEN ' on ios, web' ELSE '' END || ' with ' || CASE WHEN s_suppkey % 3 = 0 THEN 'free' ELSE 'seat' END || '-based pricing.' AS positioning FROM supplier WHERE s_suppkey % 5 <> 0) WHERE price IS NOT NULL""",
    "run_metrics": """
WITH r AS (SELECT o_orderkey, o_totalprice::DOUBLE / 1000 AS cost, o_orderdate::TIMESTAMP AS t FROM orders), n AS (SELECT * FROM r WHERE t > TIMESTAMP '1998-06-30' - INTERVAL 30 DAYS),
m AS (SELECT 'cost_per_run' AS key, avg(cost) AS value, 100.0::DOUBLE AS threshold FROM n
 UNION ALL SELECT 'p95_seconds', percentile_cont(0.95) WITHIN GROUP (ORDER BY (o_orderkey % 90 * 60)::DOUBLE), NULL FROM n
 UNION ALL SELECT 'runs_today', (count(*) FILTER (WHERE t >= TIMESTAMP '1998-06-30'))::DOUBLE, NULL FROM r
 UNION ALL SELECT 'task_failure_rate', count(*) FILTER (WHERE l_linenumber = 3) / nullif(count(*), 0)::DOUBLE, 0.5 FROM lineitem JOIN n ON l_orderkey = o_orderkey
 UNION ALL SELECT 'drop_rate', sum(k) / (sum(k) + sum(event_id))::DOUBLE, NULL FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
 UNION ALL SELECT 'binding_rate', count(*) FILTER (WHERE contains(text, substr(text, 3, 24) || CASE WHEN quality = 1 THEN '' ELSE '~zq' END)) / count(*)::DOUBLE, 1.0 FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL)
SELECT key, round(value, 6) AS value, threshold, coalesce(CASE WHEN key = 'binding_rate' THEN value < threshold ELSE value > threshold END, false) AS breached FROM m""",
    "similar_vectors": "SELECT a, b, round(s, 6) AS score FROM (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE s >= 0.2",
    "status_counts": "SELECT " + ", ".join(f"count(*) FILTER (WHERE event_type = '{x}') AS {x}" for x in ["view", "signup", "purchase", "error", "click", "refund"]) + " FROM events",
    "failure_rates": "SELECT user_id % 10 AS bucket, round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 9) AS failure_rate FROM events GROUP BY 1",
    "percentiles": """
WITH s AS (SELECT o_orderpriority, list_sort(list(o_totalprice::DOUBLE)) AS v, count(*) AS n, percentile_cont(0.95) WITHIN GROUP (ORDER BY o_totalprice::DOUBLE) AS c, avg(o_totalprice::DOUBLE) AS a FROM orders GROUP BY 1)
SELECT o_orderpriority, round(c, 4) AS cont95, v[(round_even(0.95 * (n - 1), 0))::INT + 1] AS rank95, v[(round_even(0.5 * (n - 1), 0))::INT + 1] AS rank50, v[least(n - 1, floor(0.95 * n))::INT + 1] AS spike95, round(a, 4) AS mean FROM s""",
    "percentiles_whole": """
WITH s AS (SELECT list_sort(list(l_extendedprice::DOUBLE)) AS v, count(*) AS n, percentile_cont(0.95) WITHIN GROUP (ORDER BY l_extendedprice::DOUBLE) AS c, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice::DOUBLE) AS d FROM lineitem)
SELECT round(c, 6) AS cont95, round(d, 6) AS cont50, v[(round_even(0.95 * (n - 1), 0))::INT + 1] AS rank95, v[(round_even(0.5 * (n - 1), 0))::INT + 1] AS rank50, v[least(n - 1, floor(0.95 * n))::INT + 1] AS spike95 FROM s""",
    "rolling_spend": "SELECT event_id, sum(event_id % 17) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)::BIGINT AS rolling FROM events",
    "greedy_budget": """
WITH RECURSIVE t AS (SELECT l_orderkey, l_linenumber, (l_linenumber * 3 % 5 + 1)::BIGINT AS weight, l_quantity AS usd, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, weight, i, NULL::VARCHAR AS reason, weight AS spent, usd AS paid FROM t WHERE i = 1
 UNION ALL SELECT t.l_orderkey, t.l_linenumber, t.weight, t.i, CASE WHEN r.paid >= 60 THEN 'budget_usd' WHEN r.spent + t.weight > 11 THEN 'budget_weight' END, r.spent + CASE WHEN r.paid < 60 AND r.spent + t.weight <= 11 THEN t.weight ELSE 0 END, r.paid + CASE WHEN r.paid < 60 AND r.spent + t.weight <= 11 THEN t.usd ELSE 0 END
 FROM r JOIN t ON t.l_orderkey = r.l_orderkey AND t.i = r.i + 1)
SELECT l_orderkey, l_linenumber, weight, reason IS NULL AS admitted, reason FROM r""",
    "counter_budget": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 4 AS admitted FROM events",
    "queue_positions": "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) END AS position FROM supplier",
    "admission": "SELECT user_id, count(*) AS runs, count(*) < 3 AS ok FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS GROUP BY 1",
    "drop_rate": "SELECT round(sum(k) / (sum(k) + sum(event_id))::DOUBLE, 12) AS drop_rate FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events)",
    "drop_breakdown": "SELECT event_type, 'k' AS reason, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS n FROM events GROUP BY 1",
    "llm_costs": """
SELECT model, round(sum((greatest(i - c, 0) * a + c * b + o * e) / 1000000), 9) AS cost_usd, count(*) AS calls FROM (
 SELECT CASE WHEN turn % 2 = 0 THEN 'deepseek/deepseek-v4-flash' ELSE 'openai/text-embedding-3-small' END AS model, CASE WHEN turn % 2 = 0 THEN 0.09::DOUBLE ELSE 0.02::DOUBLE END AS a, 0.02::DOUBLE AS b, CASE WHEN turn % 2 = 0 THEN 0.18::DOUBLE ELSE 0.02::DOUBLE END AS e,
 length(text) AS i, length(text) % 50 AS o, length(text) % 7 * 10 AS c FROM conversations) GROUP BY 1""",
    "breaches": "SELECT event_type, coalesce(CASE WHEN event_type = 'view' THEN avg(value::DOUBLE) < 50 ELSE avg(value::DOUBLE) > 50 END, false) AS breached FROM events GROUP BY 1",
    "retry_plan": "SELECT s_suppkey, s_suppkey % 6 >= 2 AS retry, least(30::DOUBLE, 0.5::DOUBLE * pow(2::DOUBLE, s_suppkey % 9)) AS longest_s FROM supplier",
    "ready_tasks": """
WITH t AS (SELECT o_custkey::VARCHAR AS run_id, o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
SELECT run_id, k::VARCHAR AS node_key FROM t WHERE k % 7 <> 0 AND k % 2 <> 0 AND (p IS NULL OR (p % 7 <> 0 AND p % 2 = 0))""",
    "dead_tasks": """
WITH RECURSIVE t AS (SELECT o_custkey AS run_id, o_orderkey AS k, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, o_orderkey % 7 <> 0 AND o_orderkey % 2 <> 0 AS pending FROM orders),
r AS (SELECT run_id, k FROM t WHERE pending AND p % 7 = 0 UNION SELECT t.run_id, t.k FROM r JOIN t ON t.run_id = r.run_id AND t.p = r.k WHERE t.pending)
SELECT run_id::VARCHAR AS run_id, k::VARCHAR AS node_key FROM r""",
    "plan_faults": """
WITH RECURSIVE t AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey IN (7, 8) THEN n_nationkey - 1 ELSE n_nationkey END AS k FROM nation), e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 26 AS b FROM nation),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a FROM r WHERE a = b)
SELECT 'duplicate_key' AS fault, k::VARCHAR AS detail FROM t GROUP BY k HAVING count(*) > 1
UNION ALL SELECT 'undeclared_node', k::VARCHAR FROM (SELECT a AS k FROM e UNION SELECT b FROM e) WHERE k NOT IN (SELECT k FROM t)
UNION ALL SELECT 'over_budget', sum(n % 5 + 1)::BIGINT::VARCHAR FROM t HAVING sum(n % 5 + 1) > 70
UNION ALL SELECT 'cycle', k::VARCHAR FROM (SELECT a AS k FROM c UNION SELECT b FROM r WHERE a IN (SELECT a FROM c))
UNION ALL SELECT 'bad_kind', k::VARCHAR FROM t WHERE n % 3 = 2
UNION ALL SELECT 'bad_args', k::VARCHAR FROM t WHERE n % 3 < 2 AND n % 4 = 0""",
    "edge_inversion": "SELECT n_regionkey::VARCHAR AS node_key, array_to_string(list_sort(list(DISTINCT n_nationkey::VARCHAR)), ',') AS deps FROM nation GROUP BY 1",
    "event_replay": "SELECT event_id, event_type, user_id FROM events WHERE event_id > 100 AND event_type IN ('view', 'purchase', 'error')",
    "checklist": """
WITH n AS (SELECT c_custkey % 50 AS run_id, c_custkey AS node_id, c_custkey % 5 AS kind, row_number() OVER (PARTITION BY c_custkey % 50, c_custkey % 5 ORDER BY c_custkey) AS k FROM customer),
v AS (SELECT user_id % 50 AS run_id, event_id AS id, event_type AS y, event_id % 40 AS task FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY run_id, task % 5 ORDER BY since) AS k FROM (SELECT run_id, task, min(id) AS since FROM v WHERE y IN ('view', 'signup') GROUP BY 1, 2)),
x AS (SELECT s.run_id, s.task, arg_max(v.y, v.id) AS y FROM s JOIN v ON v.run_id = s.run_id AND v.task = s.task AND v.id > s.since AND v.y IN ('purchase', 'error') GROUP BY 1, 2)
SELECT n.run_id, n.node_id, CASE WHEN x.y = 'purchase' THEN 'done' WHEN x.y = 'error' THEN 'failed' WHEN s.since IS NOT NULL THEN 'running' ELSE 'pending' END AS status
FROM n LEFT JOIN s ON s.run_id = n.run_id AND s.task % 5 = n.kind AND s.k = n.k LEFT JOIN x ON x.run_id = s.run_id AND x.task = s.task""",
    "lease_fold": """
WITH RECURSIVE t AS (SELECT user_id, event_type AS c, (event_id % 2)::BIGINT AS g, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 'pending' AS status, (-1)::BIGINT AS token, 0 AS attempts FROM t
 UNION ALL SELECT t.user_id, t.i,
  CASE WHEN t.c = 'view' AND r.status = 'pending' THEN 'running' WHEN r.status = 'running' AND t.g = r.token AND t.c = 'purchase' THEN 'done' WHEN r.status = 'running' AND t.g = r.token AND t.c = 'error' THEN CASE WHEN r.attempts >= 3 THEN 'failed' ELSE 'pending' END WHEN r.status = 'running' AND t.c = 'signup' THEN 'pending' ELSE r.status END,
  CASE WHEN t.c = 'view' AND r.status = 'pending' THEN t.g WHEN r.status = 'running' AND (t.g = r.token AND t.c = 'error' OR t.c = 'signup') THEN -1 ELSE r.token END,
  r.attempts + CASE WHEN t.c = 'view' AND r.status = 'pending' THEN 1 ELSE 0 END
 FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i + 1)
SELECT user_id AS task_id, arg_max(status, i) AS status, arg_max(token, i) AS token, arg_max(attempts, i)::BIGINT AS attempts FROM r GROUP BY 1""",
    "eviction": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 THEN NULL ELSE sha256(text) END AS text_hash FROM documents",
    "retention": "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAYS",
    "pinning": "SELECT doc_id AS id, doc_id % 50 = 0 OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_pinned FROM documents",
    "sticky_upsert": "SELECT o_custkey AS k, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS note, arg_min(o_orderkey % 2 = 0, o_orderkey) AS is_pinned FROM orders GROUP BY 1",
    "merged_meta": "SELECT s_suppkey, s_nationkey::VARCHAR AS a, s_suppkey::VARCHAR AS b FROM supplier",
    "cache_lookup": "SELECT event_id, user_id, user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AS hit FROM events",
    "cache_any_age": "SELECT event_id, c_name AS name, c_name IS NOT NULL AS hit FROM events LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 1",
    "missing_embeddings": """
WITH k AS (SELECT doc_id, sha256('{' || concat_ws(',', '"lang":"' || lang || '"', '"source":"' || source || '"', '"k":' || (n_chars % 50)) || '}') AS key FROM documents)
SELECT DISTINCT key FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 3 = 0)""",
    "alias_lookup": "SELECT c_custkey::VARCHAR AS key, coalesce(s_suppkey, p_partkey + 100000)::BIGINT AS entity_id FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN part ON p_partkey = c_custkey",
    "entity_merge": "SELECT c_custkey AS id, 'web:' || c_custkey AS entity_key, (SELECT count(*) FROM orders WHERE o_custkey - o_custkey % 3 = c_custkey AND o_custkey IN (SELECT c_custkey FROM customer)) AS n FROM customer WHERE c_custkey % 3 = 0",
    "merged_aliases": "SELECT 'old:' || c_custkey AS alias_key, c_custkey - c_custkey % 3 AS entity_id FROM customer WHERE c_custkey % 4 > 1 UNION ALL SELECT 'web:' || c_custkey, c_custkey - c_custkey % 3 FROM customer WHERE c_custkey % 3 > 0",
    "recall_scores": "SELECT user_id, round(len(list_intersect(s, ['view', 'purchase', 'refund'])) / 3::DOUBLE, 9) AS recall, round(1 - len(list_intersect(s, ['error'])) / len(s)::DOUBLE, 9) AS precision FROM (SELECT user_id, list(DISTINCT event_type) AS s FROM events GROUP BY 1)",
    "fact_accuracy": "SELECT p_brand, round(avg(CASE WHEN abs(round(x, 0) - (x + x % 3)) <= 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS fact_accuracy FROM (SELECT p_brand, p_retailprice::DOUBLE AS x FROM part) GROUP BY 1",
    "regressions": """
WITH s AS (SELECT 'q' || lpad(s_suppkey::VARCHAR, 2, '0') AS query_id, s_suppkey AS k, s_suppkey % 8 <> 0 AS old FROM supplier)
SELECT query_id, unnest(list_filter([CASE WHEN k % 9 = 0 THEN 'unbound' END, CASE WHEN old AND 0.45::DOUBLE - k % 10 / 10.0::DOUBLE > 0.1 THEN 'recall_drop' END, CASE WHEN old AND k % 4 > 0 AND k % 7 > k % 4 * 1.5 THEN 'cost_rise' END,
 CASE WHEN query_id = 'q07' THEN 'trap_silent' END], lambda x: x IS NOT NULL)) AS rule FROM s""",
    "stale_facts": "SELECT o_orderkey, o_orderdate::DATE AS verified_on FROM orders WHERE date_diff('day', o_orderdate::DATE, DATE '1998-01-01') > 60",
    "set_operations": "SELECT c_custkey AS k, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'both' ELSE 'left' END AS side FROM customer",
    "star_velocity": "SELECT user_id AS repo, count(*) AS stars, round(count(*) / greatest(1::DOUBLE, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(min(ts))) / 86400000000.0::DOUBLE), 9) AS velocity FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 90 DAYS GROUP BY 1",
    "archive_rows": "SELECT page_id, url, unnest([200, 404])::INT AS status FROM pages",
    "page_views": "SELECT user_id AS article, nullif((sum(event_id % 5) FILTER (WHERE DATE '2024-07-31' - (event_id % 730)::INT >= DATE '2023-07-01' AND DATE '2024-07-31' - (event_id % 730)::INT < DATE '2024-06-01'))::BIGINT, 0) AS views FROM events GROUP BY 1",
    "rollup": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, grouping(o_orderpriority, o_orderstatus)::BIGINT AS level FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "path_guess": "SELECT s_suppkey, arg_min(p, i) AS path FROM (SELECT s_suppkey, unnest(['/pricing', '/plans', '/pricing-plans', '/price']) AS p, unnest([0, 1, 2, 3]) AS i FROM supplier) WHERE (s_suppkey + i) % 5 = 0 GROUP BY 1",
    "source_claims": """
WITH l AS (SELECT l_orderkey AS entity_id, (l_orderkey * 10 + l_linenumber)::BIGINT AS id, l_linenumber > 1 AS lost, l_linestatus AS v FROM lineitem)
SELECT entity_id, id AS src, lost, v FROM l WHERE lost OR id IN (SELECT entity_id * 10 + 1 FROM l WHERE lost)""",
}
QUERIES = {name: globals()[name] for name in SQL}
