"""Text classifiers from aggregates alone (R1, R2, E8): multinomial naive Bayes with Laplace smoothing.

Several targets (the four aspects, or the review score) are learnt from the same texts at once.
Training is two aggregations: texts by their labels, and tokens by their texts' labels (for all targets at
once, so that a text's tokens are exploded once). The counts of tokens are written once.
Scoring looks up the most frequent tokens, a bounded number and nearly all occurrences, in a broadcast table
and sums them by text where the text is read, so that a row a text is shuffled; occurrences of the other tokens
alone travel to their counts. Nothing is collected; the model is a table.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.vectors import argmax, softmax
from pairlens.session import cut_lineage

#: A token is a run of characters that are neither ASCII controls, blanks nor punctuation; these part tokens.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Tokens whose counts are broadcast, the most frequent ones.
FREQUENT = 65_536
#: Log-scores are compared and normalised at this many digits, so that the order of summation doesn't show.
SCORE_DIGITS = 6


def occurrences(texts: DataFrame, key: str, text: str, carried: Sequence[str] = (), outer: bool = False) -> DataFrame:
    """(key, *carried, token): a row an occurrence of a token in lower case. ``outer``: texts null or without tokens have
    rows too, of a null or empty token."""
    explode = F.explode_outer if outer else F.explode
    rows = texts.select(key, *carried, explode(F.split(F.lower(text), BETWEEN)).alias("token"))
    return rows if outer else rows.where(F.col("token") != "")


@dataclass
class NaiveBayes:
    """``counts``: (token, total, {target}_{class}: its occurrences in texts of that class). ``sizes``: one row of
    {target}_{class}_all and {target}_words. ``priors``: one row of an array of log-priors a target."""

    targets: dict[str, int]  # target column -> number of classes
    counts: DataFrame
    sizes: DataFrame
    priors: DataFrame
    frequent: int = FREQUENT

    def _classes(self) -> list[tuple[str, int]]:
        return [(t, c) for t, k in self.targets.items() for c in range(k)]

    def _log_probabilities(self) -> list[Column]:
        """Of a row of counts, by target and class; 0 where the token is unknown to the target."""
        size = self.sizes.select(F.struct("*")).scalar()
        known = {t: reduce(lambda a, b: a + b, [F.col(f"{t}_{c}") for c in range(k)]) > 0 for t, k in self.targets.items()}
        return [F.when(known[t], F.log((F.col(f"{t}_{c}") + 1) / (size[f"{t}_{c}_all"] + size[f"{t}_words"]))).otherwise(F.lit(0.0)).alias(f"{t}_{c}")
                for t, c in self._classes()]

    def probabilities(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        """(key, {target}_probs): class probabilities of each text; one without known tokens gets the priors."""
        names = [f"{t}_{c}" for t, c in self._classes()]
        common = self.counts
        if rare := self.counts.count() > self.frequent:
            common = cut_lineage(self.counts.orderBy(F.desc("total"), "token").limit(self.frequent))
        looked_up = F.broadcast(common.select("token", *self._log_probabilities()))
        found = occurrences(texts, key, text, outer=True).join(looked_up, "token", "left").select(key, *names)
        if rare:
            own = F.broadcast(common.select("token"))
            others = occurrences(texts, key, text).join(own, "token", "left_anti").join(self.counts.join(own, "token", "left_anti"), "token")
            found = found.unionByName(others.select(key, *self._log_probabilities()))
        # texts of a null key are one row, of the priors
        sums = [F.sum(F.when(F.col(key).isNotNull(), F.col(n))).alias(n) for n in names]
        scored = found.groupBy(key).agg(*sums)
        prior = self.priors.select(F.struct("*")).scalar()
        scored = scored.withColumn("_prior", prior)
        scores = scored.select(key, *[F.array(*[
            F.round(F.coalesce(F.col(f"{t}_{i}"), F.lit(0.0)) + F.element_at(F.col("_prior")[f"{t}_prior"], i + 1), SCORE_DIGITS) for i in range(k)]).alias(t)
            for t, k in self.targets.items()])
        return scores.select(key, *[softmax(t).alias(f"{t}_probs") for t in self.targets])


def train(texts: DataFrame, key: str, text: str, targets: dict[str, int], frequent: int = FREQUENT) -> NaiveBayes:
    """``targets``: columns of class numbers from 0 (null: not labelled for that target) and their numbers of classes."""
    names = list(targets)

    def total(target: str, c: int) -> Column:
        return F.sum(F.when(F.col(target) == c, F.lit(1)).otherwise(F.lit(0)))

    # smoothed: a class without a text is possible, but unlikely
    docs = texts.agg(*[total(t, c).alias(f"{t}_{c}") for t, k in targets.items() for c in range(k)])
    every = {t: sum((F.col(f"{t}_{c}") for c in range(k)), F.lit(0)) for t, k in targets.items()}
    priors = docs.select(*[F.array(*[F.log((F.coalesce(F.col(f"{t}_{c}"), F.lit(0)) + 1) / (F.coalesce(every[t], F.lit(0)) + k)) for c in range(k)]).alias(f"{t}_prior")
                           for t, k in targets.items()])
    # a row a token, read for the sizes and for every scoring
    counts = cut_lineage(occurrences(texts, key, text, names).groupBy("token").agg(
        F.count(F.lit(1)).alias("total"), *[total(t, c).alias(f"{t}_{c}") for t, k in targets.items() for c in range(k)]))
    known = {t: sum((F.col(f"{t}_{c}") for c in range(k)), F.lit(0)) > 0 for t, k in targets.items()}
    sizes = counts.agg(*[F.sum(f"{t}_{c}").alias(f"{t}_{c}_all") for t, k in targets.items() for c in range(k)],
                       *[F.count_if(known[t]).alias(f"{t}_words") for t in targets])
    return NaiveBayes(targets, counts, sizes, priors, frequent)


def predicted(probabilities: DataFrame, target: str) -> DataFrame:
    """Adds ``prediction`` (T3: the first class of the greatest probability) and ``confidence``."""
    p = F.col(f"{target}_probs")
    return probabilities.withColumns({"prediction": argmax(p).cast("int"), "confidence": F.array_max(p)})
