"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source's target repetition rate is its target share of all text over its present share. Each row
draws a uniform number from the hash of its id, inverts the Poisson distribution with that mean, and
is exploded into as many copies; the copies are dealt out and ordered by a second hash, a global
shuffle. Only per-source sums meet the rows, so a source of any size stays spread over all tasks.
A mean over ``MAX_RATE`` is drawn as a sum of Poissons of equal means up to it, each from a hash of its
own, so a tiny source beside a huge one is repeated as often as its weight asks.

Defined cases: a null ``source`` is a source of its own; a null text has no mass but is drawn at its
source's rate; rows with the same ``doc_id`` (nulls too) draw the same count; a source without a target
weight has weight zero, and one without text the rate 1; an empty table gives an empty result. Every
input column is carried, renamed by nothing: the operator's own columns are named by parameter and
replace input columns of the same name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import checkpointed, read, unused

SEED = "mix-1"
#: Without explicit weights a source's target share goes with its mass to this power.
POWER = 0.5
#: Largest mean inverted at once, as exp(-mean) nears the smallest double beyond it.
MAX_RATE = 500.0
#: Copies that a row is exploded into at once.
COPIES_STEP = 4096
#: Up to so many sources (a name and a number each) travel to all tasks.
BROADCAST_SOURCES = 100_000


def uniform(seed: str, doc_id: Column, draw: Column | None = None) -> Column:
    """A number between 0 and 1, both excluded, from 52 bits of the md5 of seed and id (and number of the draw)."""
    named = [F.lit(f"{seed}:")] if draw is None else [F.lit(f"{seed}#"), draw.cast("string"), F.lit(":")]
    digest = F.md5(F.concat(*named, F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson(u: Column, mean: Column) -> Column:
    """The smallest k whose cumulative Poisson probability reaches ``u``; the search ends where the
    tail is far below the steps of ``u``."""
    last = (mean + 10 * F.sqrt(mean) + 30).cast("int")
    p0 = F.exp(-mean)
    start = F.struct(p0.alias("p"), p0.alias("below"), F.lit(0).alias("k"))

    def step(acc, i):
        p = acc["p"] * mean / i
        open_ = acc["below"] < u
        return F.struct(p.alias("p"), F.when(open_, acc["below"] + p).otherwise(acc["below"]).alias("below"),
                        (acc["k"] + open_.cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["k"])


def drawn(seed: str, doc_id: Column, mean: Column) -> Column:
    """A Poisson count for any mean: inverted at once up to ``MAX_RATE``, else summed over equal parts."""
    parts = F.ceil(mean / MAX_RATE)
    several = F.aggregate(F.sequence(F.lit(1).cast("long"), parts), F.lit(0).cast("long"),
                          lambda acc, j: acc + poisson(uniform(seed, doc_id, j), mean / parts))
    return F.when(mean <= MAX_RATE, poisson(uniform(seed, doc_id), mean).cast("long")).otherwise(several)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER) -> DataFrame:
    """(source, rate): one row a source. ``weights``: target weight by source, scaled to sum 1."""
    mass = docs.groupBy(F.col("source").alias("source")).agg(
        F.sum(F.coalesce(F.char_length("text"), F.lit(0))).cast("double").alias("mass"))
    if weights is None:
        weight = F.pow("mass", F.lit(power))
    else:
        weight = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    mass = checkpointed(mass.withColumn("weight", F.when(F.col("mass") > 0, weight).otherwise(0.0)))
    total = mass.agg(F.sum("mass").alias("mass"), F.sum("weight").alias("weight")).first()
    rate = F.when(F.col("mass") > 0, F.col("weight") / F.lit(total["weight"]) * F.lit(total["mass"]) / F.col("mass")).otherwise(1.0)
    return mass.select("source", rate.cast("double").alias("rate"))


def replicated(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, seed: str = SEED,
               copy: str = "copy", order: str = "mix_key") -> DataFrame:
    """The copies of all rows in shuffled order, with their number from 1 and the hash that orders them."""
    kept = [c for c in docs.columns if c not in (copy, order)]
    of, mean, n, before = unused([*kept, copy, order], "__source", "__rate", "__n", "__before")
    rate = rates(docs, weights, power).select(F.col("source").alias(of), F.col("rate").alias(mean))
    if rate.count() <= BROADCAST_SOURCES:  # else a join that Spark splits where a source is large
        rate = F.broadcast(rate)
    rows = docs.select(*kept).join(rate, F.col("source").eqNullSafe(F.col(of)))
    rows = rows.withColumn(n, drawn(seed, F.col("doc_id"), F.col(mean))).where(F.col(n) > 0)
    step = F.lit(COPIES_STEP).cast("long")  # in two steps, so that no row's array of numbers gets long
    rows = rows.withColumn(before, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, step)))
    rows = rows.withColumn(copy, F.explode(F.sequence(F.col(before) + 1, F.least(F.col(n), F.col(before) + step)).cast("array<int>")))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                            F.col(copy).cast("string")).cast("binary"))
    # rows of one id, or equal in everything, have one key: their numbers deal them out too
    rows = rows.withColumn(order, key).select(*kept, copy, order, F.monotonically_increasing_id().alias(n))
    return rows.repartition(order, n).sortWithinPartitions(order).drop(n)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replicated towards square-root shares of their sources."""
    return replicated(read(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH mass AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS mass FROM documents GROUP BY source),
weighted AS (SELECT source, mass, CASE WHEN mass > 0 THEN pow(mass, {POWER}) ELSE 0 END AS weight FROM mass),
rate AS (SELECT source, CASE WHEN mass > 0 THEN weight / (SELECT sum(weight) FROM weighted)
           * (SELECT sum(mass) FROM weighted) / mass ELSE 1.0 END AS rate FROM weighted),
steps AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - CASE WHEN k < 2 THEN 0 ELSE lgamma(k + 1) END) AS p
          FROM rate, range(0, 700) r(k) WHERE k <= rate + 10 * sqrt(rate) + 30),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM steps),
drawn AS (SELECT *, (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / {1 << 52} AS u FROM documents),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
              (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.below < d.u) AS n FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
       md5('{SEED}-order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR) AS mix_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)
"""
