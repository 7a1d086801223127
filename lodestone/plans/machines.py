"""Runs as state machines, exact joins of vectors, budgets, ranks and reachability at scale, over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import findings as FI
from lodestone.operators.work import shared_dir
from lodestone.plans._common import table
from lodestone.streaming import runs as R

HOUR = 3_600_000
LEASE_MS, DELAY_MS = 6 * HOUR, HOUR


def run_log(e: DataFrame) -> DataFrame:
    """Users as runs: signups claim, clicks renew, views complete, errors fail, purchases skip; every 90th and 170th event ends its run."""
    task = F.col("event_id") % 4
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in {"signup": "task.claimed", "click": "task.renewed", "view": "task.completed", "error": "task.failed", "purchase": "task.skipped"}.items() for x in kv)), F.col("event_type"))
    event = F.when(F.col("event_id") % 90 == 0, "report.ready").when(F.col("event_id") % 170 == 0, "run.failed").otherwise(kind)
    token = F.when(F.col("event_id") % 11 == 0, -7).otherwise(F.col("user_id") * 10 + task)
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), event.alias("event_type"), task.alias("task_id"), token.alias("token"))


def _tasks(changes: DataFrame) -> DataFrame:
    ended = R.states(changes, "run").select("run_id", F.col("status").alias("ended"))
    return R.states(changes, "task").join(ended, "run_id", "left").select("run_id", F.col("item").cast("long").alias("task_id"), "status", "token", F.col("attempts").cast("long").alias("attempts"), "ended")


def run_states(spark: SparkSession, d: str) -> DataFrame:
    """Tasks of every run an hour before the last event."""
    log = run_log(table(spark, d, "events"))
    now = log.agg((F.max(F.unix_millis("ts")) - DELAY_MS).alias("now"))
    timed = log.join(F.broadcast(now))  # one row
    return _tasks(R.fold_runs(timed, F.col("now"), lease_ms=LEASE_MS))


def run_states_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same by the stream, read to its end: the watermark stands an hour behind the last event."""
    store, out = "spark.sql.streaming.stateStore.providerClass", f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    before = spark.conf.get(store)
    spark.conf.set(store, R.STORE)
    try:
        log = run_log(spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]"))  # a pattern, since a path has to be a folder
        q = R.run_stream(log, delay="1 hour", lease_ms=LEASE_MS).writeStream.format("parquet").option("path", f"{out}/changes").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(store, before)
    return _tasks(spark.read.schema(R.CHANGES).parquet(f"{out}/changes"))


_RUN_STATES = """
WITH RECURSIVE log AS (
  SELECT user_id AS run, event_id AS id, epoch_ms(ts) AS ms, event_id % 4 AS task, CASE WHEN event_id % 11 = 0 THEN -7 ELSE user_id * 10 + event_id % 4 END AS token, event_type,
         CASE WHEN event_id % 90 = 0 THEN 'ready' WHEN event_id % 170 = 0 THEN 'failed' END AS ends, max(epoch_ms(ts)) OVER () - 3600000 AS now
  FROM events),
passed AS (SELECT * FROM log WHERE ms <= now),
stop AS (SELECT run, min(struct_pack(ms := ms, id := id)) AS at, arg_min(ends, struct_pack(ms := ms, id := id)) AS ends FROM passed WHERE ends IS NOT NULL GROUP BY run),
e AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.run, task ORDER BY p.ms, p.id) AS k
  FROM passed p LEFT JOIN stop USING (run) WHERE stop.run IS NULL OR struct_pack(ms := p.ms, id := p.id) < stop.at),
s(run, task, k, status, held, attempts, til) AS (
  SELECT DISTINCT run, task, 0::BIGINT, 'pending', (-1)::BIGINT, 0::BIGINT, NULL::BIGINT FROM e
  UNION ALL
  SELECT run, task, k,
    CASE WHEN event_type = 'signup' AND st = 'pending' THEN 'running' WHEN NOT mine THEN st WHEN event_type = 'view' THEN 'done' WHEN event_type = 'purchase' THEN 'skipped'
         WHEN event_type = 'error' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE st END,
    CASE WHEN event_type = 'signup' AND st = 'pending' THEN token WHEN mine AND event_type IN ('view', 'purchase', 'error') THEN -1 ELSE h END,
    attempts + CASE WHEN event_type = 'signup' AND st = 'pending' THEN 1 ELSE 0 END,
    CASE WHEN (event_type = 'signup' AND st = 'pending') OR (mine AND event_type = 'click') THEN ms + 21600000 WHEN mine AND event_type IN ('view', 'purchase', 'error') THEN NULL ELSE t END
  FROM (SELECT *, st = 'running' AND h = token AS mine FROM (
    SELECT e.*, s.attempts, CASE WHEN status = 'running' AND til < ms THEN 'pending' ELSE status END AS st, CASE WHEN status = 'running' AND til < ms THEN -1 ELSE held END AS h,
           CASE WHEN status = 'running' AND til < ms THEN NULL ELSE til END AS t
    FROM s JOIN e ON e.run = s.run AND e.task = s.task AND e.k = s.k + 1))),
f AS (SELECT s.*, stop.ends, coalesce(stop.at.ms, (SELECT max(now) FROM log)) AS lim FROM s LEFT JOIN stop USING (run) QUALIFY row_number() OVER (PARTITION BY s.run, s.task ORDER BY s.k DESC) = 1)
SELECT run AS run_id, task AS task_id, CASE WHEN status = 'running' AND til < lim THEN 'pending' ELSE status END AS status, CASE WHEN status = 'running' AND til < lim THEN -1 ELSE held END AS token, attempts, ends AS ended
FROM f WHERE attempts > 0
"""

def clustered_findings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of 25 themes, each a theme's own vector with two fifths of its row's: complaints (even themes) as pain points, requests as gaps."""
    e = table(spark, d, "embeddings").filter("embedding is not null").withColumn("g", F.col("vec_id") % 25)
    centre = e.groupBy("g").agg(F.min_by("embedding", "vec_id").alias("c"))
    vectors = e.join(centre, "g").select(F.col("vec_id").alias("id"), F.zip_with(F.col("c").cast("array<double>"), F.col("embedding").cast("array<double>"), lambda x, y: x + y * 0.4).alias("v"))
    slug = F.concat(F.lit("theme-"), F.col("g").cast("string"), F.when(F.col("vec_id") % 3 == 0, "-again").otherwise(""))
    claims = e.select(F.col("vec_id").alias("id"), "g", slug.alias("slug"), (F.col("vec_id") % 11).alias("source_id"), F.when(F.col("vec_id") % 4 == 0, "B").otherwise("C").alias("grade"), ((F.col("vec_id") % 8) / 8.0).alias("confidence"))
    shipped = spark.range(1).select(F.explode(F.array(F.lit("theme-3"), F.lit("theme-7"))).alias("slug"))
    reviewed = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    found = FI.pain_points(claims.filter("g % 2 = 0"), vectors).unionByName(FI.feature_gaps(claims.filter("g % 2 = 1"), vectors, shipped, reviewed))
    return found.select("kind", "statement", F.array_join("claim_ids", ",").alias("claim_ids"), "support_count", F.round("confidence", 6).alias("confidence"), "theme", "distinct_threads", "best_grade")


def all_findings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as complaints and requests of two runs, parts as their prices, suppliers' features as what is shipped."""
    e = table(spark, d, "embeddings").filter("embedding is not null").withColumn("g", F.col("vec_id") % 20)
    centre = e.groupBy("g").agg(F.min_by("embedding", "vec_id").alias("c"))
    vectors = e.join(centre, "g").select(F.col("vec_id").alias("id"), F.zip_with(F.col("c").cast("array<double>"), F.col("embedding").cast("array<double>"), lambda x, y: x + y * 0.35).alias("v"))
    k, none = F.col("vec_id"), lambda t: F.lit(None).cast(t)
    shape = lambda id_, run, entity, attribute, text, num, source: [id_.alias("id"), run.alias("run_id"), entity.alias("entity_id"), attribute.alias("attribute"), text.alias("value_text"), num.cast("double").alias("value_num"), source.alias("source_id"), F.when(id_ % 4 == 0, "B").otherwise("C").alias("grade"), ((id_ % 8) / 8.0).alias("confidence"), F.when(id_ % 17 == 0, id_ + 1).alias("superseded_by")]
    themes = e.select(*shape(k, k % 3 % 2, F.lit(0).cast("long"), F.concat(F.when(F.col("g") % 2 == 0, "complaint.t").otherwise("request.t"), F.col("g").cast("string"), F.when(k % 19 == 0, ".reactions").otherwise("")), none("string"), none("double"), k % 11))
    p, q = table(spark, d, "part"), F.col("p_partkey")
    prices = p.select(*shape(q + 1_000_000, q % 2, q % 50 + 1, F.lit("pricing.entry_usd_month"), none("string"), F.col("p_retailprice"), q % 5))
    s, r = table(spark, d, "supplier"), F.col("s_suppkey")
    features = s.select(*shape(r + 2_000_000, r % 2, r % 50 + 1, F.concat(F.lit("feature.t"), (r % 40).cast("string"), F.lit(".present")), F.when(r % 3 == 0, "true").otherwise("false"), none("double"), r % 5)).filter("id % 40 < 8")
    entities = spark.range(51).select("id", F.when(F.col("id") == 0, "category:x").otherwise(F.concat(F.lit("web:e"), F.col("id").cast("string"), F.lit(".com"))).alias("entity_key"), F.concat(F.lit("E"), F.col("id").cast("string")).alias("display_name"))
    found = FI.all_findings(themes.unionByName(prices).unionByName(features), entities, vectors)
    return found.select("run_id", "kind", "statement", F.md5(F.array_join("claim_ids", ",")).alias("claims"), "support_count", F.round("confidence", 6).alias("confidence"), "theme", "distinct_threads", "best_grade")


_ALL_FINDINGS = """
WITH RECURSIVE x AS (SELECT vec_id, vec_id % 20 AS g, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
ce AS (SELECT g, arg_min(e, vec_id) AS c FROM x GROUP BY g),
t AS (SELECT vec_id AS id, vec_id % 3 % 2 AS run, g, list_transform(list_zip(c, e), lambda p: p[1] + p[2] * 0.35::DOUBLE) AS v FROM x JOIN ce USING (g) WHERE vec_id % 19 <> 0 AND vec_id % 17 <> 0),
p AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.id <> b.id AND a.run = b.run AND a.g % 2 = b.g % 2 AND list_cosine_similarity(a.v, b.v) >= 0.86),
cc(id, comp) USING KEY (id) AS (SELECT id, id FROM t UNION (SELECT DISTINCT ON (u.id) u.id, w.comp FROM recurring.cc AS u, cc AS w, p WHERE p.a = u.id AND p.b = w.id AND w.comp < u.comp ORDER BY u.id ASC, w.comp ASC)),
m AS (SELECT cc.id, comp, t.run, t.g % 2 AS odd, 't' || t.g AS slug, cc.id % 11 AS source_id, CASE WHEN cc.id % 4 = 0 THEN 'B' ELSE 'C' END AS grade, (cc.id % 8) / 8.0::DOUBLE AS confidence FROM cc JOIN t ON t.id = cc.id),
l AS (SELECT comp, arg_min(slug, (-n, f)) AS theme FROM (SELECT comp, slug, count(*) AS n, min(id) AS f FROM m GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT run, comp, odd, theme, count(*) AS n, count(DISTINCT source_id) AS th, min(grade) AS best_grade, round(avg(confidence), 6) AS confidence, md5(string_agg(id::VARCHAR, ',' ORDER BY id)) AS claims FROM m JOIN l USING (comp) GROUP BY ALL HAVING count(*) >= 5 AND count(DISTINCT source_id) >= 3),
pr AS (SELECT p_partkey + 1000000 AS id, p_partkey % 2 AS run, p_partkey % 50 + 1 AS entity, p_retailprice::DOUBLE AS num FROM part WHERE (p_partkey + 1000000) % 17 <> 0),
fe AS (SELECT s_suppkey + 2000000 AS id, s_suppkey % 2 AS run, s_suppkey % 50 + 1 AS entity, 't' || (s_suppkey % 40) AS slug, s_suppkey % 3 = 0 AS yes FROM supplier WHERE (s_suppkey + 2000000) % 40 < 8 AND (s_suppkey + 2000000) % 17 <> 0),
co AS (SELECT run, entity, count(*) AS n, md5(string_agg(id::VARCHAR, ',' ORDER BY id)) AS claims FROM (SELECT run, entity, id FROM pr UNION ALL SELECT run, entity, id FROM fe) GROUP BY 1, 2)
SELECT run AS run_id, 'competitor' AS kind, 'E' || entity || ' verified with ' || n || ' bound claims' AS statement, claims, n AS support_count, NULL::DOUBLE AS confidence, NULL AS theme, NULL::BIGINT AS distinct_threads, NULL AS best_grade FROM co
UNION ALL SELECT run, 'pain_point', n || ' users across ' || th || ' threads report ' || theme, claims, n, confidence, theme, th, best_grade FROM s WHERE odd = 0
UNION ALL SELECT run, 'feature_gap', n || ' users across ' || th || ' threads request ' || theme || '; not found among ' || (SELECT count(*) FROM co WHERE co.run = s.run) || ' reviewed competitors', claims, n, confidence, theme, th, best_grade FROM s WHERE odd = 1 AND NOT EXISTS (SELECT 1 FROM fe WHERE fe.run = s.run AND fe.slug = s.theme AND yes)
UNION ALL SELECT run, 'pricing_observation', printf('Entry pricing observed across %d competitors: median $%.2f/mo (range $%.2f-$%.2f)', count(DISTINCT entity), median(num), min(num), max(num)), md5(string_agg(id::VARCHAR, ',' ORDER BY id)), count(*), round(avg((id % 8) / 8.0::DOUBLE), 6), NULL, NULL, NULL FROM pr GROUP BY run HAVING count(DISTINCT entity) >= 2
"""

_FINDINGS = """
WITH RECURSIVE x AS (SELECT vec_id, vec_id % 25 AS g, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT g, arg_min(e, vec_id) AS c FROM x GROUP BY g),
v AS (SELECT vec_id, g, list_transform(list_zip(c, e), lambda p: p[1] + p[2] * 0.4::DOUBLE) AS v FROM x JOIN c USING (g)),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.g % 2 = b.g % 2 AND list_cosine_similarity(a.v, b.v) >= 0.86),
cc(id, comp) USING KEY (id) AS (SELECT vec_id, vec_id FROM v UNION (SELECT DISTINCT ON (u.id) u.id, w.comp FROM recurring.cc AS u, cc AS w, p WHERE p.a = u.id AND p.b = w.id AND w.comp < u.comp ORDER BY u.id ASC, w.comp ASC)),
m AS (SELECT id, comp, 'theme-' || (id % 25) || CASE WHEN id % 3 = 0 THEN '-again' ELSE '' END AS slug, id % 11 AS source_id, CASE WHEN id % 4 = 0 THEN 'B' ELSE 'C' END AS grade, (id % 8) / 8.0::DOUBLE AS confidence FROM cc),
l AS (SELECT comp, arg_min(slug, (-n, f)) AS theme FROM (SELECT comp, slug, count(*) AS n, min(id) AS f FROM m GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT comp, theme, min(id) % 25 % 2 AS odd, count(*) AS n, count(DISTINCT source_id) AS t, min(grade) AS best_grade, round(avg(confidence), 6) AS confidence, string_agg(id::VARCHAR, ',' ORDER BY id) AS claim_ids FROM m JOIN l USING (comp) GROUP BY 1, 2)
SELECT CASE WHEN odd = 0 THEN 'pain_point' ELSE 'feature_gap' END AS kind,
       n || ' users across ' || t || ' threads ' || CASE WHEN odd = 0 THEN 'report ' || theme ELSE 'request ' || theme || '; not found among ' || (SELECT count(*) FROM supplier) || ' reviewed competitors' END AS statement,
       claim_ids, n AS support_count, confidence, theme, t AS distinct_threads, best_grade
FROM s WHERE n >= 5 AND t >= 3 AND (odd = 0 OR theme NOT IN ('theme-3', 'theme-7'))
"""

QUERIES = {f.__name__: f for f in (run_states, run_states_stream, clustered_findings, all_findings)}
SQL = {"run_states": _RUN_STATES, "run_states_stream": _RUN_STATES, "clustered_findings": _FINDINGS, "all_findings": _ALL_FINDINGS}
