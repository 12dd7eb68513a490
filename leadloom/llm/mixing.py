"""Problem 7: combining sources to target shares of the total size in tokens.

Subset-sum budget fitting. Every document's exact token length is counted once (Arrow batches, a public tokenizer whose file
is a parameter); everything else is decided on the numbers of documents by (source, length). A source's budget is its weight times
the total. Each length first gets its proportional number of uses, what is rounded down being carried on to the next (in a
seeded order), so that the mix has the lengths of its source; what is left over goes to further uses, down to ``RESERVE`` tokens; the rest is fitted exactly by
bounded-knapsack dynamic programming over the uses still free and some short ones that are given back for it (more of
them, up to all, while the budget is not met). The uses of a length go round its documents evenly, and the remainder to those
of the smallest seeded hashes.

Only counts come to the driver: a row for each source and length, so at most sources x the longest text's tokens.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.text import trimmed
from leadloom.session import cut, small

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The word pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEED = 20260929
#: Tokens of each budget that are left to the exact fit.
RESERVE = 8192
#: Beyond so many tokens no more uses are given back for an exact fit (what is left over then is told by ``used``).
MOST_GIVEN_BACK = 1 << 20
#: Documents of one length are ordered by so many leading bits of their hashes, then within the one prefix where the uses end.
PREFIX_BITS = 16


def source_key(c: Column) -> Column:
    """A source however it is spelled: trimmed, lower case, one underscore between words. Null and blank give null."""
    k = F.regexp_replace(F.lower(trimmed(c)), r"[\s\p{Z}_\-]+", "_")
    return F.when(k != "", k)


def token_lengths(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) with the source's key; whole texts, null and empty texts have 0 tokens."""
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in shared.value.splitlines() if line.strip())}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in f["text"]]})

    return documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").mapInPandas(run, "doc_id bigint, source string, tokens bigint")


def targets_of(mix_targets: DataFrame) -> DataFrame:
    """(source, weight, max_repeats) by source key; spellings of one source are added up, with the greatest cap.
    Null sources are dropped; null weights and caps count as 0 and 1."""
    x = mix_targets.select(source_key(F.col("source")).alias("source"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    return x.where("source IS NOT NULL").groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))


def knapsack(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length to take so that their sum is the largest not above ``budget``.

    ``lengths``: length -> uses available. Exact bounded-knapsack dynamic programming: counts are split into powers of two, and
    each sum keeps the step that reached it first; it stops as soon as the budget itself is reached.
    """
    if budget <= 0:
        return {}
    first = np.full(budget + 1, -1, dtype=np.int32)
    first[0] = 0
    steps = [(0, 0)]
    for size in sorted((n for n in lengths if 0 < n <= budget), reverse=True):
        left, k = min(lengths[size], budget // size), 1
        while left > 0 and first[budget] < 0:
            k = min(k, left)
            w = size * k
            first[w + np.flatnonzero((first[:-w] >= 0) & (first[w:] < 0))] = len(steps)
            steps.append((size, k))
            left, k = left - k, 2 * k
    best, out = int(np.flatnonzero(first >= 0)[-1]), {}
    while best:
        size, k = steps[first[best]]
        out[size] = out.get(size, 0) + k
        best -= size * k
    return out


def fill(counts: dict[int, int], budget: int, most: int, seed: int = SEED) -> dict[int, int]:
    """Uses of each length: at most ``most`` for each of its ``counts`` documents, their sum as near below ``budget`` as can be.

    Exact where all uses, or ``MOST_GIVEN_BACK`` tokens of short ones, are enough to meet the budget or all of them are
    fitted together; texts of 0 tokens get the whole rounds only. No text is used a round more than others before that is needed.
    """
    total = sum(size * n for size, n in counts.items())
    if budget >= total * most:
        return {size: most * n for size, n in counts.items()}
    sizes = sorted((size for size in counts if size), reverse=True)
    even = {size: min(most * counts[size], -(-counts[size] * budget // total)) for size in sizes}
    full = {size: most * counts[size] for size in sizes}
    uses, carry = {0: counts[0] * (budget // total)} if 0 in counts else {}, 0
    # proportional, what is rounded down being carried on to the next length, in a seeded order
    for size in sorted(sizes, key=lambda n: xxhash.xxh64_intdigest(str(n), seed)):
        carry += size * counts[size] * budget
        uses[size] = min(even[size], carry // (size * total))
        carry -= uses[size] * size * total
    rest = budget - sum(size * uses[size] for size in sizes)
    for cap in (even, full):
        for size in sizes:
            k = max(0, min(cap[size] - uses[size], (rest - RESERVE) // size))
            uses[size], rest = uses[size] + k, rest - k * size
    unreached = budget % math.gcd(*sizes)  # no sum of uses is nearer than this
    back = RESERVE
    while rest > unreached:
        given, sum_given = {}, 0
        for size in reversed(sizes):
            k = min(uses[size], max(1, back // (8 * size)) if back < MOST_GIVEN_BACK else (MOST_GIVEN_BACK - sum_given) // size)
            if k and sum_given + k * size <= back:
                given[size], sum_given = k, sum_given + k * size
        cap, target = even if back == RESERVE else full, rest + sum_given
        free = {size: max(0, cap[size] - uses[size]) + given.get(size, 0) for size in sizes}
        take = knapsack({size: k for size, k in free.items() if k}, target)
        for size in sizes:
            uses[size] += take.get(size, 0) - given.get(size, 0)
        rest = target - sum(size * k for size, k in take.items())
        if back >= MOST_GIVEN_BACK:
            break
        back *= 8
    return uses


class Mix:
    """``plan`` (a row a source: source, weight, max_repeats, docs, tokens, total, budget, used, reachable), ``selected``
    (doc_id, source, tokens, repeats) and ``report`` (the plan's rows and what was selected).

    ``total`` is the size of all documents of the listed sources used once, ``budget`` weight x total, rounded down.
    A source is not ``reachable`` if, filled, it uses every text ``max_repeats`` times and still has less than its weight.
    The same seed gives the same selection at any partitioning. Sources that are not listed are not used; a listed source
    without documents gets none. Null and empty texts have no tokens and are taken with the whole rounds only.
    """

    def __init__(self, documents: DataFrame, mix_targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED):
        spark = documents.sparkSession
        targets = cut(targets_of(mix_targets))
        lengths = token_lengths(documents, vocabulary)
        self.lengths = cut(lengths.join(small(targets.select("source")), "source", "left_semi").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")))
        counts: dict[str, dict[int, int]] = {r.source: {} for r in targets.collect()}
        for source, tokens, n in self.lengths.groupBy("source", "tokens").agg(F.count("*").alias("n")).toPandas().itertuples(index=False):
            counts[source][int(tokens)] = int(n)
        size = {s: sum(n * k for n, k in c.items()) for s, c in counts.items()}
        total, rows, filled = sum(size.values()), [], []
        for t in targets.collect():  # one row a target
            have, aim = counts[t.source], t.weight * total
            uses = fill(have, math.floor(aim), t.max_repeats, seed) if aim > 0 else dict.fromkeys(have, 0)
            used = sum(n * k for n, k in uses.items())
            all_used = all(k == have[n] * t.max_repeats for n, k in uses.items())
            rows.append((t.source, t.weight, t.max_repeats, sum(have.values()), size[t.source], total, math.floor(aim), used, not (all_used and used < aim)))
            filled += [(t.source, n, have[n], k) for n, k in uses.items()]
        self.plan = spark.createDataFrame(rows, "source string, weight double, max_repeats int, docs bigint, tokens bigint, total bigint, budget bigint, used bigint, reachable boolean")
        self.filled = spark.createDataFrame(filled, "source string, tokens bigint, n bigint, uses bigint")

    @property
    def selected(self) -> DataFrame:
        f = self.filled.select("source", "tokens", F.floor(F.col("uses") / F.col("n")).cast("int").alias("rounds"), F.pmod("uses", "n").alias("more")).where("rounds > 0 OR more > 0")
        x = self.lengths.join(small(f), ["source", "tokens"]).withColumn("p", F.shiftrightunsigned("h", 64 - PREFIX_BITS))
        # where, among the hash prefixes of a length, its uses end: at most 2^PREFIX_BITS rows of a length meet in a task
        by = x.where("more > 0").groupBy("source", "tokens", "more", "p").agg(F.count("*").alias("k"))
        before = F.sum("k").over(Window.partitionBy("source", "tokens").orderBy("p")) - F.col("k")
        end = by.withColumn("before", before).where("before < more AND before + k >= more").select("source", "tokens", F.col("p").alias("last"), (F.col("more") - F.col("before")).alias("left"))
        x = x.join(end, ["source", "tokens"], "left")
        rank = F.row_number().over(Window.partitionBy("source", "tokens").orderBy("h", "doc_id"))
        edge = x.where("p = last").withColumn("once", (rank <= F.col("left")).cast("int"))
        x = x.where("last IS NULL OR p <> last").withColumn("once", F.coalesce((F.col("p") < F.col("last")).cast("int"), F.lit(0))).unionByName(edge)
        return x.select("doc_id", "source", "tokens", (F.col("rounds") + F.col("once")).alias("repeats")).where("repeats > 0")

    @property
    def report(self) -> DataFrame:
        got = self.selected.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used"), F.sum("repeats").alias("uses"), F.max("repeats").alias("most"))
        return self.plan.drop("used").join(got, "source", "left").fillna(0, ["used", "uses", "most"])
