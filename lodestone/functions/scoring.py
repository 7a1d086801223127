"""Scores and ordered decisions as columns. `now` is always given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.functions.text import strip


def lookup(c: Column, values: dict) -> Column:
    return reduce(lambda w, kv: w.when(c == kv[0], F.lit(kv[1])), list(values.items())[1:], F.when(c == next(iter(values)), F.lit(next(iter(values.values())))))


def confidence(grade: Column, domains: Column, age_days: Column, contradicted: Column) -> Column:
    """Base of the grade, more for further domains, decay by age, less if contradicted, capped."""
    more = 1 + fixed.DOMAIN_STEP * F.least(domains - 1, F.lit(fixed.DOMAIN_STEPS))
    decay = F.pow(F.lit(fixed.DECAY_30_DAYS), age_days / 30)
    return F.least(lookup(grade, fixed.GRADE_BASE) * more * decay * F.when(contradicted, fixed.CONTRADICTED).otherwise(1.0), F.lit(fixed.CONFIDENCE_CAP))


def age_days(as_of: Column, fetched_at: Column, now: Column) -> Column:
    """Days since the stated date, else since the fetch; never below 0."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.coalesce(as_of.cast("timestamp"), fetched_at.cast("timestamp")))) / 86_400_000_000)


def domain_count(keys: Column) -> Column:
    """Aggregate: distinct registrable domains, 1 at least."""
    return F.greatest(F.count_distinct(keys), F.lit(1))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0; null for different lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)))


def cost_usd(model: Column, input_tokens: Column, output_tokens: Column, cached: Column, rates: dict = fixed.MODEL_RATES) -> Column:
    """Cached tokens are part of the input and have their own rate. Null for unknown models."""
    rate = lambda k: lookup(model, {m: r[k] for m, r in rates.items()})
    return (F.greatest(input_tokens - cached, F.lit(0)) * rate(0) + cached * rate(2) + output_tokens * rate(1)) / 1_000_000


def backoff_limit(attempt: Column) -> Column:
    """The upper end of the full-jitter delay, in seconds."""
    return F.least(F.lit(fixed.BACKOFF_CAP_S), fixed.BACKOFF_BASE_S * F.pow(F.lit(2.0), attempt))


def backoff(attempt: Column) -> Column:
    return F.rand() * backoff_limit(attempt)


def is_retryable(status: Column, timeout: Column) -> Column:
    return F.coalesce(timeout, F.lit(False)) | F.coalesce(status.isin(fixed.RETRY_STATUS), F.lit(False))


def threads_per_call(threads: Column, keywords: Column, venues: Column) -> Column:
    return F.greatest(F.floor(threads / F.greatest(keywords * venues, F.lit(1))), F.lit(1))


def breached(value: Column, threshold: Column, below: Column) -> Column:
    """Null values and thresholds never breach."""
    return F.coalesce(F.when(below, value < threshold).otherwise(value > threshold), F.lit(False))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def fact_matches(kind: Column, expected: Column, found: Column, tolerance: float = fixed.FACT_TOLERANCE) -> Column:
    """Booleans exactly, numbers within the tolerance, text without regard to case and outer white space."""
    text = F.lower(strip(expected)) == F.lower(strip(found))
    return F.coalesce(F.when(kind == "numeric", F.abs(expected.try_cast("double") - found.try_cast("double")) <= tolerance).otherwise(text), F.lit(False))


def grade_for(kind: Column, wayback_of: Column) -> Column:
    """A capture is graded as what it shows, B at best."""
    shown = lookup(wayback_of, fixed.SOURCE_GRADE)
    return F.when(kind == "wayback_snapshot", F.greatest(shown, F.lit("B"))).otherwise(lookup(kind, fixed.SOURCE_GRADE))


def own_domain_kind(path: Column) -> Column:
    p = F.regexp_replace(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), "/+$", "")
    return F.when(reduce(lambda a, b: a | b, [p.startswith(x) for x in fixed.PROSE_PATHS]), "own_domain_prose").otherwise("own_domain_structured")


def maturity(*, domain_age_days: Column, last_commit_at: Column, stars: Column, star_velocity: Column, has_funding: Column, stage: Column, installs: Column, downloads: Column, shared_host: Column, now: Column) -> Column:
    """struct(tier, rule, insufficient): the first rule of the list that holds. Unknown is not zero."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    days = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(last_commit_at.cast("timestamp"))) / 86_400)
    stale = (days / fixed.DAYS_PER_MONTH > fixed.ABANDONED_MONTHS) & (zero(stars) == 0) & (zero(installs) == 0) & (zero(downloads) == 0)
    funded = F.coalesce(has_funding, F.lit(False)) | F.coalesce((stage == "seed") | stage.startswith("series-"), F.lit(False))
    old = domain_age_days / fixed.DAYS_PER_YEAR > fixed.ESTABLISHED_YEARS
    scale = (zero(installs) > fixed.ESTABLISHED_INSTALLS) | (zero(downloads) > fixed.ESTABLISHED_DOWNLOADS) | (zero(stars) > fixed.ESTABLISHED_STARS)
    low = (stars.isNotNull() | downloads.isNotNull()) & (zero(stars) < fixed.HOBBY_STARS) & (zero(downloads) < fixed.HOBBY_DOWNLOADS)
    none = reduce(lambda a, b: a & b, [c.isNull() for c in (domain_age_days, last_commit_at, stars, star_velocity, stage, installs, downloads)]) & ~F.coalesce(has_funding, F.lit(False)) & ~F.coalesce(shared_host, F.lit(False))
    rules = [("abandoned", "stale_commit_no_liveness", stale), ("funded", "funding_signal", funded), ("established", "domain_age_and_scale", old & scale), ("hobby", "paas_subdomain", shared_host), ("hobby", "low_scale", low), ("indie", "insufficient_signal", none)]
    made = lambda tier, rule: F.struct(F.lit(tier).alias("tier"), F.lit(f"{tier}:{rule}").alias("rule"), F.lit(rule == "insufficient_signal").alias("insufficient"))
    out = F.when(F.coalesce(rules[0][2], F.lit(False)), made(*rules[0][:2]))
    for tier, rule, holds in rules[1:]:
        out = out.when(F.coalesce(holds, F.lit(False)), made(tier, rule))
    return out.otherwise(made("indie", "default"))


def attribute_kind(attribute: Column) -> Column:
    """Kind of a vocabulary entry or family member; null outside the vocabulary."""
    fixed_kind = lookup(attribute, {k: v[0] for k, v in fixed.ATTRIBUTES.items()})
    family = reduce(lambda w, f: w.when(attribute.rlike(f[0]), f[1]), fixed.FAMILIES[1:], F.when(attribute.rlike(fixed.FAMILIES[0][0]), fixed.FAMILIES[0][1]))
    return F.coalesce(fixed_kind, family)


def value_fits(attribute: Column, kind: Column, value_text: Column, value_num: Column) -> Column:
    """Numbers need a number, booleans true or false, enumerations one of their choices; other kinds take all."""
    choices = {k: v[2] for k, v in fixed.ATTRIBUTES.items() if v[2]}
    in_choices = reduce(lambda a, b: a | b, [(attribute == k) & value_text.isin(v) for k, v in choices.items()])
    return F.coalesce(F.when(kind == "numeric", value_num.isNotNull()).when(kind == "boolean", value_text.isin("true", "false")).when(kind == "enum", in_choices).otherwise(True), F.lit(False))


def effective_date(as_of: Column, fetched_at: Column, today: Column) -> Column:
    return F.coalesce(as_of, F.to_date(fetched_at), today)
