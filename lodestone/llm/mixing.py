"""Operator 7: mixing sources to target weights by Poisson replication.

A source with n of N rows and target share w gets the mean repetition rate w * N * epochs / n. A row's count is the
inverse of that Poisson distribution at a uniform number hashed from seed and the row's key, so it depends on nothing
else; rates above SPLIT are drawn as a sum of equal smaller ones. A row's key is its id; where several rows share an id,
or it is null, it is the id, a digest of the text, one of the whole row if rows with this text differ, and of rows alike
in everything which of them it is (from 0). So every row is drawn by itself, full duplicates too. Rows are exploded by their count
and dealt out by a hash of seed, key and replica, sorted by it within partitions: a global shuffle that comes out the
same every time.

Targets: a weight per source (made to sum to 1; sources without one get 0; if no source has any, nothing is drawn), or
`smoothing`: share proportional to n ** smoothing. Null is a source like any other; null, empty and very long texts are
carried like any other column. An empty table gives no rows. All columns are carried along under their names; if one of them is called `replica`, the
number of the copy is called replica_1 (or the first such name that is free).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._common import Workspace, free_name, packed, table

SEED, SPLIT, FEW = 17, 64.0, 10_000
BLOCK = 1024  # copies of one full duplicate that are dealt out together


def uniform(seed: int, key: Column, draw: Column) -> Column:
    """In [0, 1): the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), draw.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, *, source_col: str = "source", weights: dict | None = None, smoothing: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """A row per source: source, n, rate, draws, cdf (of one draw)."""
    counts = docs.select(F.col(source_col).alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(smoothing)))
    else:
        pairs = [x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
        given = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
        weight = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(given)
    weighed = counts.withColumn("w", weight)
    total = weighed.agg(F.sum("w").alias("w_all"), F.sum("n").alias("n_all"))  # one row
    rate = weighed.join(F.broadcast(total)).withColumn("rate", F.expr(f"coalesce(try_divide(w, w_all), 0D) * n_all * {float(epochs)}D / n")).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / SPLIT)).cast("int"))
    cdf = """aggregate(sequence(1, cast(ceil(rate / draws + 12 * sqrt(rate / draws) + 24) as int)),
        named_struct('p', exp(-rate / draws), 'c', array(exp(-rate / draws))),
        (s, k) -> named_struct('p', s.p * (rate / draws) / k, 'c', concat(s.c, array(element_at(s.c, -1) + s.p * (rate / draws) / k)))).c"""
    return rate.select("source", "n", "rate", "draws", F.expr(cdf).alias("cdf"))


def _digest(c: Column) -> Column:
    return F.md5(F.to_json(F.struct(c), {"ignoreNullFields": "false"}).cast("binary"))


def told_apart(rows: DataFrame, ws: Workspace) -> DataFrame:
    """rows: row, id, text, source. Instead of text a key, another one for every row (see above)."""
    again = ws.keep("again", rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").select(F.col("id").alias("of_id"), F.lit(True).alias("again")))
    n = again.count()
    if not n:
        return rows.select("row", "source", F.col("id").alias("key"))
    marked = rows.join(F.broadcast(again) if n <= FEW else again, F.col("id").eqNullSafe(F.col("of_id")), "left")
    alone = marked.filter("again is null").select("row", "source", F.col("id").alias("key"))
    hashed = marked.filter("again").select("row", "source", F.concat_ws(":", "id", _digest(F.col("text"))).alias("text"), _digest(F.col("row")).alias("all"))
    alike = ws.keep("alike", hashed.groupBy("text", "all").agg(F.first("row").alias("row"), F.first("source").alias("source"), F.count("*").alias("n")))
    differ = ws.keep("differ", alike.groupBy("text").agg((F.min("all") != F.max("all")).alias("differ")).filter("differ").select(F.col("text").alias("of_text"), "differ"))
    known = alike.join(F.broadcast(differ) if differ.count() <= FEW else differ, F.col("text") == F.col("of_text"), "left").select("row", "source", "n", F.concat_ws(":", "text", F.when(F.col("differ"), F.col("all"))).alias("group"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = known.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long")))).repartition(parts, "group", "block")
    each = blocks.withColumn("place", F.explode(F.sequence("block", F.least(F.col("block") + BLOCK, "n") - 1)))
    return alone.unionByName(each.select("row", "source", F.concat_ws(":", "group", F.col("place").cast("string")).alias("key")))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict | None = None, smoothing: float = 0.5, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """The documents, each as often as it was drawn, in shuffled order, with `replica` (from 0)."""
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "mixing")
    found = ws.keep("rates", rates(docs, source_col=source_col, weights=weights, smoothing=smoothing, epochs=epochs))
    plan = found.filter("rate > 0").select(F.col("source").alias("of"), "draws", "cdf")
    if found.count() <= FEW:
        plan = F.broadcast(plan)
    rows = told_apart(docs.select(packed(docs).alias("row"), F.col(id_col).cast("string").alias("id"), (F.col(text_col) if text_col in docs.columns else F.lit(None)).cast("string").alias("text"), F.col(source_col).alias("source")), ws)
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    drawn = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda n, d: n + F.size(F.filter("cdf", lambda c: c <= uniform(seed, F.col("key"), d))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = joined.withColumn("copies", drawn).filter("copies > 0").withColumn("replica", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)))
    keyed = copies.select("row", "replica", F.xxhash64(F.lit(seed), "key", "replica").alias("key"))
    return keyed.repartition(n, "key").sortWithinPartitions("key").select("row.*", F.col("replica").alias(free_name("replica", docs.columns)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op7_mixing": """
WITH c AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM c) * (SELECT sum(n) FROM c) * 1.0::DOUBLE / n AS rate FROM c),
d AS (SELECT source, greatest(1, ceil(rate / 64))::INT AS draws, rate / greatest(1, ceil(rate / 64)) AS m FROM r),
k AS (SELECT source, draws, m, unnest(generate_series(0, ceil(m + 12 * sqrt(m) + 24)::INT)) AS k FROM d),
p AS (SELECT source, draws, k, exp(-m + k * ln(m) - coalesce(sum(CASE WHEN k > 0 THEN ln(k) END) OVER (PARTITION BY source ORDER BY k), 0)) AS p FROM k),
f AS (SELECT source, draws, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
u AS (SELECT x.*, j, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM (SELECT documents.*, unnest(generate_series(1, d.draws)) AS j FROM documents JOIN d ON documents.source IS NOT DISTINCT FROM d.source) x),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) AS n FROM u JOIN f ON u.source IS NOT DISTINCT FROM f.source WHERE f.c <= u.u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(0, n - 1)) AS replica FROM n
"""
}
