"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power a, normalised. a is bisected on [0, 1]: to the largest value whose
entropy is at least the target (as a share of the greatest possible), or to the smallest whose repetition stays within the limit
(how often more a token of one source is seen than of another); with both, repetition has the last word.

A budget of tokens is dealt to the sources by weight. A source is read in whole passes; each pass is a new permutation of its blocks
(rows by hash, about BLOCK_TOKENS tokens each) and of the rows in each block. The last pass stops at the row with
which the budget is reached. Tokens are words; the search evaluates five levels of the bisection in each Spark job, over
one row for each source, and no source or block list is gathered in a task or on the driver beyond those sums.

Defined results: a null source is a source of its own; rows without words have no tokens and go with their block, in whole passes and in the
last one if it has reached them; a source without any token is read once, after all others (mix_at 1); repeated rows share a block
and are interchangeable; ties of the seeded hash are broken by id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, pick
from .line_cleaning import words_of

BLOCK_TOKENS = 100_000
TARGET_ENTROPY = 0.9
MAX_REPEAT = 4.0
LEVELS, STEPS = 5, 8
SEED = 7


@dataclass(frozen=True)
class Goal:
    """entropy: share of the greatest possible; repeat: the most passes of one source for one pass of another; budget: tokens.

    budget None: as many tokens as the corpus has; "all": so many that every source is read once at least.
    """

    entropy: float | None = TARGET_ENTROPY
    repeat: float | None = MAX_REPEAT
    budget: int | str | None = None


def find_exponent(shares: DataFrame, goal: Goal) -> float:
    """shares: one row for each source, p > 0. Both tests are monotone in the exponent, so bisection finds the border."""
    n, low_p, high_p = shares.agg(F.count("*"), F.min("p"), F.max("p")).first()
    if n < 2:
        return 1.0

    def border(holds) -> float:
        """The largest exponent in [0, 1] for which holds is true, if it is true at 0."""
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            inner = [low + (high - low) * k / 2**LEVELS for k in range(1, 2**LEVELS + 1)]
            true = holds(inner)
            at = 0  # five levels of bisection over the answers
            for level in reversed(range(LEVELS)):
                if true[at + 2**level - 1]:
                    at += 2**level
            if at == 2**LEVELS - 1 and true[at]:
                return high
            low, high = (inner[at - 1] if at else low), inner[at]
        return low

    def entropies(exponents: list[float]) -> list[bool]:
        lp = F.log("p")
        sums = [x for a in exponents for x in (F.sum(F.exp(a * lp)), F.sum(F.exp(a * lp) * lp))]
        got = shares.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
        return [math.log(got[2 * i]) - a * got[2 * i + 1] / got[2 * i] >= goal.entropy * math.log(n) for i, a in enumerate(exponents)]

    a = border(entropies) if goal.entropy is not None else 0.0 if goal.repeat is not None else 1.0
    if goal.repeat is not None and high_p > low_p:
        # passes are as p ** (a - 1), so the rarest source is read (high_p / low_p) ** (1 - a) times as often as the largest
        low, high = 0.0, 1.0
        for _ in range(LEVELS * STEPS):
            middle = (low + high) / 2
            if (high_p / low_p) ** (1 - middle) > goal.repeat:
                low = middle
            else:
                high = middle
        a = max(a, high)
    return a


def shuffled(*what: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *what)


def mix(df: DataFrame, goal: Goal = Goal(), block_tokens: int = BLOCK_TOKENS, seed: int = SEED, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df's rows as often as they are read, in columns as in df, then mix_source, mix_weight, mix_tokens, mix_pass, mix_block, mix_position (in the block), mix_at.

    mix_at is the share of its source's tokens that are read before the row. In this order a source is read pass by pass and block by block, and all sources
    together keep to their weights from the begin to the end; sorted by it (range-partitioned), the table is the order of training.
    """
    tables = Tables(df.sparkSession)
    names = df.columns
    flat = df.toDF(*(f"c{i}" for i in range(len(names))))
    source, text, doc = (F.col(f"c{names.index(c)}") for c in (source_col, text_col, id_col))
    tokens = F.coalesce(F.size(words_of(F.coalesce(text, F.lit("")))), F.lit(0)).cast("long")
    rows = flat.select(*flat.columns, source.alias("mix_source"), tokens.alias("mix_tokens"), doc.cast("string").alias("mix_id"))

    narrow = tables.keep(rows.select("mix_source", "mix_tokens", "mix_id"), "tokens")
    per = tables.keep(narrow.groupBy("mix_source").agg(F.sum("mix_tokens").alias("t")), "sources")
    total = per.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    shares = per.select("mix_source", "t", (F.col("t") / F.lit(max(total, 1))).alias("p"))
    some = shares.where("t > 0")
    a = find_exponent(some, goal)
    power = F.exp(a * F.log("p"))
    z, reach = some.agg(F.coalesce(F.sum(power), F.lit(1.0)), F.coalesce(F.max(F.col("t") / power), F.lit(0.0))).first()
    budget = total if goal.budget is None else (reach * z * (1 + 1e-12)) if goal.budget == "all" else goal.budget
    weights = shares.select(F.col("mix_source").alias("s"), "t", F.when(F.col("t") > 0, power / z).otherwise(0.0).alias("mix_weight"), (F.floor(F.col("t") / block_tokens) + 1).alias("blocks"))
    quota = F.when(F.col("t") > 0, F.col("mix_weight") * budget / F.col("t")).otherwise(1.0)
    weights = weights.withColumn("passes", F.floor(quota)).withColumn("left", F.floor((quota - F.floor(quota)) * F.col("t")))
    weights = tables.keep(weights.withColumn("quota", F.col("passes") * F.col("t") + F.col("left")), "weights")

    def placed(df: DataFrame) -> DataFrame:
        """With the weight of the source, and the row's block."""
        known = df.join(weights, F.col("mix_source").eqNullSafe(F.col("s"))).drop("s")
        return known.withColumn("mix_block", F.pmod(shuffled(F.col("mix_id"), seed=seed), F.col("blocks")))

    # each pass's blocks in its own order, with the tokens of the source before each; in about 1024 steps of the hash, so that a source's blocks are not ordered in one task
    sizes = placed(narrow).groupBy("mix_source", "mix_block", "passes", "left", "t").agg(F.sum("mix_tokens").alias("bt"))
    reads = F.col("passes") + F.when(F.col("left") > 0, 1).otherwise(0)
    sizes = sizes.where(reads > 0).withColumn("mix_pass", F.explode(F.sequence(F.lit(0).cast("long"), reads - 1)))
    sizes = sizes.withColumn("turn", shuffled(F.col("mix_source"), F.col("mix_pass"), F.col("mix_block"), seed=seed + 1))
    sizes = tables.keep(sizes.withColumn("step", F.floor(F.shiftrightunsigned("turn", 54))), "sizes")
    steps = sizes.groupBy("mix_source", "mix_pass", "step").agg(F.sum("bt").alias("st"))
    ahead = W.partitionBy("mix_source", "mix_pass").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    steps = steps.select(F.col("mix_source").alias("s1"), F.col("mix_pass").alias("p1"), F.col("step").alias("k1"), F.coalesce(F.sum("st").over(ahead), F.lit(0)).alias("step_before"))
    within = W.partitionBy("mix_source", "mix_pass", "step").orderBy(F.shiftleft("turn", 10), "mix_block").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.withColumn("block_before", F.coalesce(F.sum("bt").over(within), F.lit(0)))
    before = before.join(steps, F.col("mix_source").eqNullSafe(F.col("s1")) & (F.col("mix_pass") == F.col("p1")) & (F.col("step") == F.col("k1")))
    before = before.withColumn("before", F.col("step_before") + F.col("block_before")).where((F.col("mix_pass") < F.col("passes")) | (F.col("before") < F.col("left")))
    before = tables.keep(before.select(F.col("mix_source").alias("s2"), F.col("mix_block").alias("b2"), "mix_pass", "before"), "blocks")

    read = placed(rows).join(before, F.col("mix_source").eqNullSafe(F.col("s2")) & (F.col("mix_block") == F.col("b2"))).drop("s2", "b2")
    order = W.partitionBy("mix_source", "mix_block", "mix_pass").orderBy(shuffled(F.col("mix_id"), F.col("mix_pass"), seed=seed + 2), "mix_id")
    read = read.withColumn("mix_position", F.row_number().over(order)).withColumn("row_before", F.coalesce(F.sum("mix_tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    taken = read.where((F.col("mix_pass") < F.col("passes")) | (F.col("before") + F.col("row_before") < F.col("left")))
    at = F.when(F.col("quota") > 0, (F.col("mix_pass") * F.col("t") + F.col("before") + F.col("row_before")) / F.col("quota")).otherwise(1.0)
    extra = ["mix_source", "mix_weight", "mix_tokens", "mix_pass", "mix_block", "mix_position", "mix_at"]
    return taken.withColumn("mix_at", at).select(*flat.columns, *extra).toDF(*names, *extra)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="doc_id", text="text", source="source")
    out = mix(docs)
    return out.select("doc_id", F.col("mix_source").alias("source"), F.round("mix_weight", 9).alias("weight"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_pass").alias("pass"), F.col("mix_block").alias("block"), F.col("mix_position").cast("long").alias("position"), F.round("mix_at", 9).alias("at"))
