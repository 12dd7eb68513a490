"""Problem 4: samples that stay the same while the population grows.

Consistent weighted Poisson sampling: an identifier's uniform number comes from a hash of seed and identifier alone, and it
is selected while that number is below weight x constant. State keeps the greatest weight x constant an identifier ever had,
so its inclusion probability never falls and nothing selected is lost while it is in the population. Partitioning, order and
reruns don't matter; nothing is sorted or collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.text import trimmed
from leadloom.operators.incremental import Versions
from leadloom.session import cut

SEED = 20260929
#: Expected share of the population per unit of weight.
CONSTANT = 0.02


def uniform(identifier: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of seed and identifier."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), identifier))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def clean_id(c: Column) -> Column:
    """Identifiers as they are compared: trimmed, lower case."""
    return F.lower(trimmed(c))


def draw(population: DataFrame, state: DataFrame, constant: float = CONSTANT, seed: int = SEED, key: str = "store_id", weight: str = "weight") -> tuple[DataFrame, DataFrame]:
    """The sample (key, probability, kept) and the new state (key, probability).

    ``population`` (key, weight): repeated keys count once with their greatest weight; null keys, and null or negative
    weights, are taken as absent and 0. ``state`` (key, probability) may be empty; keys that left the population stay in the
    state, so that they are selected again when they come back. ``kept`` tells that the state alone selects the key.
    """
    now = population.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))).alias("_w"))
    old = state.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("probability").alias("_old"))
    x = now.join(old, key, "full")
    x = x.withColumn("probability", F.least(F.lit(1.0), F.greatest(F.coalesce(F.col("_w") * constant, F.lit(0.0)), F.coalesce("_old", F.lit(0.0)))))
    x = x.withColumn("_u", uniform(F.col(key), seed))
    sample = x.where("_w IS NOT NULL AND _u < probability").select(key, "probability", (F.col("_u") < F.coalesce("_old", F.lit(0.0))).alias("kept"))
    return sample, x.select(key, "probability")


def accepted_stores(stores: DataFrame, status: str = "accepted") -> DataFrame:
    """(store_id, weight) of stores whose current row (latest ``observed_at``) has ``status``; weight: pages checked, 1 at least."""
    best = stores.where("store_id IS NOT NULL").groupBy("store_id").agg(F.max(F.struct("observed_at", "status", "pages_checked")).alias("r"))
    return best.where(F.col("r.status") == status).select("store_id", F.greatest(F.lit(1), F.coalesce("r.pages_checked", F.lit(1))).alias("weight"))


def recorded(audit_sample: DataFrame) -> DataFrame:
    """Distinct (id, wave), ids cleaned; rows without either are dropped."""
    x = audit_sample.select(clean_id(F.col("store_id")).alias("id"), "wave")
    return x.where("id <> '' AND wave IS NOT NULL").distinct()


class SampleState:
    """The sampler's state (store_id, probability) in a folder: each draw adds what it raised and swaps the version in."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def read(self) -> DataFrame:
        """The greatest probability of each identifier so far; empty where nothing was ever drawn."""
        parts = self.versions.folders()
        if not parts:
            return self.spark.createDataFrame([], "store_id string, probability double")
        return self.spark.read.parquet(*parts).groupBy("store_id").agg(F.max("probability").alias("probability"))

    def draw(self, population: DataFrame, constant: float = CONSTANT, seed: int = SEED) -> DataFrame:
        """``draw`` from this state, which is committed with what the draw raised. A run that fails commits nothing."""
        base, old = self.versions.current(), cut(self.read())
        sample, new = draw(population, old, constant, seed)
        sample, part = cut(sample), self.versions.draft()
        raised = new.join(old.withColumnRenamed("probability", "_old"), "store_id", "left").where("_old IS NULL OR probability > _old").drop("_old")
        raised.write.parquet(part)
        self.versions.commit(base, [*self.versions.folders(base), part])
        return sample


def above(u: Column) -> Column:
    """The least probability under which ``u`` (of 52 bits) is selected."""
    return u + F.lit(1.0 / (1 << 52))


def replay(audit_sample: DataFrame, population: DataFrame, constant: float = CONSTANT, seed: int = SEED) -> DataFrame:
    """(store_id, wave, probability, kept, recorded): what the sampler selects in each recorded wave, drawn one after the other.

    Each wave is drawn from ``population`` (store_id, weight) with the state that the wave before has left. A store that the
    record of the wave before has was selected then, so its probability was above its number, whatever the constant of those
    days: the state is raised to that, and ``draw`` selects it again. The state carries nothing else that the record
    doesn't have, since a store that the recorded wave before lacks need not be in this one on its account. ``kept`` tells
    that the record of the wave before selects the store, ``recorded`` that the record of this wave has it.
    """
    log = cut(recorded(audit_sample))
    people = cut(population.where("store_id IS NOT NULL").withColumn("key", clean_id(F.col("store_id"))))
    waves, out, before = [r.wave for r in log.select("wave").distinct().orderBy("wave").collect()], [], None  # one row a sampling
    for wave in waves:
        now = log.where(F.col("wave") == wave).select(F.col("id").alias("key"), F.lit(True).alias("recorded"))
        last = log.where(F.col("wave") == before).select(F.col("id").alias("key")) if before is not None else now.select("key").limit(0)
        state = last.withColumn("probability", above(uniform(F.col("key"), seed)))
        sample, _ = draw(people, state, constant, seed, key="key")
        x = sample.join(now, "key", "left").join(people.select("key", "store_id"), "key")
        out.append(x.select("store_id", F.lit(wave).cast("int").alias("wave"), "probability", "kept", F.coalesce("recorded", F.lit(False)).alias("recorded")))
        before = wave
    if not out:
        return log.sparkSession.createDataFrame([], "store_id string, wave int, probability double, kept boolean, recorded boolean")
    return reduce(DataFrame.unionByName, out)


def not_kept(audit_sample: DataFrame, stores: DataFrame, seed: int = SEED) -> DataFrame:
    """(store_id, wave): stores of one recorded wave that the next recorded wave has lost although they are still accepted:
    the waves are replayed, and what the sampler keeps and the record doesn't is reported."""
    return replay(audit_sample, accepted_stores(stores), seed=seed).where("kept AND NOT recorded").select("store_id", "wave")
