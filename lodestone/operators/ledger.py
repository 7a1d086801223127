"""Ledgers, budgets and operational metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.folds import GreedyBudget, folded
from lodestone.operators.work import Scratch, numbered


def ratio(condition: Column, *, empty: float | None = None) -> Column:
    """Share of rows; `empty` (or null) for no rows."""
    share = F.try_divide(F.count_if(condition).cast("double"), F.count("*"))
    return share if empty is None else F.coalesce(share, F.lit(empty))


def status_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row with a count for each status, zeros included."""
    return df.agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


def nearest(p: float):
    """The place (from 1) of the nearest rank, half to even, among n sorted values."""
    return lambda n: F.bround(p * (n - 1)).cast("long") + 1


def spike(p: float = 0.95):
    """The place of the element at min(n - 1, floor(p * n))."""
    return lambda n: F.least(n - 1, F.floor(p * n)).cast("long") + 1


def placed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n (rows of the group), low, high (the first and last place of the value in its sorted group, from 1): a row for each value of each group.

    Values are counted first, then dealt out by ranges of group and value, so a group of any size is spread over many
    tasks, and a value that most rows have is one row. What is added up over a group is a row for each range it spans.
    """
    ws = Scratch(df.sparkSession, "ranks")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    dealt = ws.keep("dealt", counted.repartitionByRange(parts, *keys, "_x").withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("_t"))
    whole = Window.partitionBy(*keys)
    ahead = sums.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), (F.sum("_t").over(whole.orderBy("_part")) - F.col("_t")).alias("_before"), F.sum("_t").over(whole).alias("n"))
    run = dealt.withColumn("_sum", F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_x")))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return run.join(ahead, same).select(*keys, F.col("_x").alias(value), "n", (F.col("_before") + F.col("_sum") - F.col("_c") + 1).alias("low"), (F.col("_before") + F.col("_sum")).alias("high"))


def at_ranks(df: DataFrame, keys: list[str], value: str, places: dict) -> DataFrame:
    """Per group the values at some places of the sorted column; groups may be of any size, keys null."""
    at = placed(df, keys, value)
    return at.groupBy(*keys).agg(*(F.max(F.when(place(F.col("n")).between(F.col("low"), F.col("high")), F.col(value))).alias(name) for name, place in places.items()))


def continuous(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the interpolated percentiles (name -> share from 0 to 1), exactly, without holding a group's values together."""
    low = lambda p: lambda n: F.floor(p * (n - 1)).cast("long") + 1
    high = lambda p: lambda n: F.ceil(p * (n - 1)).cast("long") + 1
    at = placed(df, keys, value)
    take = lambda place: F.max(F.when(place(F.col("n")).between(F.col("low"), F.col("high")), F.col(value).cast("double")))
    ends = at.groupBy(*keys).agg(F.max("n").alias("_n"), *(take(side(p)).alias(f"_{tag}{name}") for name, p in shares.items() for tag, side in (("l", low), ("h", high))))
    part = lambda p: p * (F.col("_n") - 1) - F.floor(p * (F.col("_n") - 1))
    return ends.select(*keys, *((F.col(f"_l{n}") + (F.col(f"_h{n}") - F.col(f"_l{n}")) * part(p)).alias(n) for n, p in shares.items()))


def admit_greedy(tasks: DataFrame, run: str, order: list[str], weight: str, cap: int, *, usd: str | None = None, usd_cap: float | None = None) -> DataFrame:
    """Adds admitted and reason: in order, a task is refused if its run has spent usd_cap (budget_usd), else if it doesn't fit in what is left of cap (budget_weight); a refused one takes nothing. A run of any length is spread over all tasks."""
    return folded(tasks, [run], order, GreedyBudget(weight, cap, usd, usd_cap))


def within_counter(df: DataFrame, run: str, order: list[Column], cap: int) -> DataFrame:
    return df.withColumn("admitted", F.row_number().over(Window.partitionBy(run).orderBy(*order)) <= cap)


def rolling_sum(df: DataFrame, keys: list[str], at: str, value: str, hours: int = 24) -> DataFrame:
    """Adds rolling: the sum over the hours up to each row, itself included."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-hours * 3_600_000_000, 0)
    return df.withColumn("rolling", F.sum(value).over(w))


def queue_positions(df: DataFrame, status: str, order: list[Column]) -> DataFrame:
    """0 for running, place in the queue for waiting, null for others."""
    waiting = numbered(df.filter(F.col(status) == "queued"), order, "position")
    running = df.filter(F.col(status) == "running").withColumn("position", F.lit(0).cast("long"))
    return waiting.unionByName(running).unionByName(df.filter(~F.col(status).isin("queued", "running")).withColumn("position", F.lit(None).cast("long")))


def spent(df: DataFrame, usd: str, *, keys: list[str] | None = None, since: Column | None = None, at: str | None = None) -> DataFrame:
    """Sums with 0 for none: of a run or task (keys), of the month to date or the last hours (since)."""
    rows = df if since is None else df.filter(F.col(at) >= since)
    return rows.groupBy(*(keys or [])).agg(F.coalesce(F.sum(usd), F.lit(0)).cast("double").alias("spent"))


def drop_rate(stats: DataFrame) -> DataFrame:
    """stats: claims_bound, claims_dropped (map). Dropped over all."""
    drops = stats.select("claims_bound", F.aggregate(F.map_values("claims_dropped"), F.lit(0).cast("long"), lambda a, b: a + b).alias("d"))
    return drops.agg(F.try_divide(F.sum("d").cast("double"), F.sum("d") + F.sum("claims_bound")).alias("drop_rate"))


def admissible(runs: DataFrame, now: Column, *, per_user: int, globally: int) -> DataFrame:
    """Per user of the last 24 hours: how many runs, and whether another may start, by the own and the global count."""
    recent = runs.filter(F.col("started_at") > now - F.expr("interval 24 hours"))
    every = recent.agg(F.count("*").alias("_all"))
    return recent.groupBy("user_id").agg(F.count("*").alias("runs")).join(F.broadcast(every)).withColumn("ok", (F.col("runs") < per_user) & (F.col("_all") < globally)).drop("_all")


def llm_ledger(requests: DataFrame, responses: DataFrame, rates: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """requests: run_id, task_id, model, cache_key; responses: cache_key, content, input_tokens, output_tokens, cached_tokens. The answers that are kept for good, each with a ledger row that costs nothing, and what is left to be asked, each key once."""
    hit = requests.join(responses, "cache_key").withColumn("cost_usd", F.lit(0.0)).withColumn("latency_ms", F.lit(0)).withColumn("cache_hit", F.lit(True)).withColumn("repaired", F.lit(False))
    return hit, requests.dropDuplicates(["cache_key"]).join(responses.select("cache_key"), "cache_key", "left_anti")


def repaired_usage(calls: DataFrame) -> DataFrame:
    """calls: request_id, attempt, body (a vendor's JSON answer). The last content and the tokens of all attempts together."""
    use = lambda name: F.coalesce(F.get_json_object("body", f"$.usage.{name}").try_cast("long"), F.lit(0))
    rows = calls.select("request_id", "attempt", F.get_json_object("body", "$.choices[0].message.content").alias("content"), use("prompt_tokens").alias("i"), use("completion_tokens").alias("o"), use("prompt_tokens_details.cached_tokens").alias("c"))
    return rows.groupBy("request_id").agg(F.max_by("content", "attempt").alias("content"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum("c").alias("cached_tokens"), (F.count("*") > 1).alias("repaired"))


def search_credits(routed: DataFrame, at: str = "at") -> DataFrame:
    """The ledger of search credits, from what the search router gives back: a row for each request that was answered and charged: run_id, provider, credits_usd, spent_at."""
    return routed.filter((F.col("charged") > 0) & ~F.col("degraded")).select("run_id", "provider", F.col("charged").alias("credits_usd"), F.col(at).alias("spent_at"))


def path_rates(attempts: DataFrame) -> DataFrame:
    """Per kind and path of the path attempts: how often it was tried, how often it hit, and the share."""
    return attempts.groupBy("kind", "path").agg(F.count("*").alias("tried"), F.count_if(F.col("outcome") == "hit").alias("hits"), ratio(F.col("outcome") == "hit").alias("rate"))
