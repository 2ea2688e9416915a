"""Mixing sources to target weights: temperature, and budgeted block permutations.

Token shares p of the sources are raised to an exponent and normalised,
``w = p**alpha / sum``. The exponent is bisected between 0 (all sources alike)
and 1 (as they come) until the mix meets a repetition limit or an entropy:

* ``repeat_limit``: the smallest exponent at which no source is read more than
  that many times,
* ``entropy_share``: the largest exponent at which the entropy of the weights
  reaches that share of the most it can be.

Without a budget the mix is the smallest one that reads every document at least
once. A source's budget of tokens is met by whole passes and a part of one. Each
pass permutes the source's blocks and the documents of each block anew; the
part takes blocks in that order, and of its last block the documents that fit.

A source is dealt in blocks of about ``BLOCK_ROWS`` documents, so a source that
holds a third of all rows is many groups. Only DataFrame functions run on rows.

Defined cases: rows without a source are a source of their own; a text without
words has no tokens and is taken in every pass that reaches it; sources without
tokens are read once; repeated rows are rows like others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.session import cut_lineage

REPEAT_LIMIT = 1.5
BLOCK_ROWS = 1024
BROADCAST_ROWS = 50_000         # tables of sources or blocks up to this are broadcast (a few MB)
LEVELS, ROUNDS = 15, 8          # 15 exponents a job are four halvings; eight jobs are 32
SEED = 17

WORD = r"[^\x20\x09-\x0D]+"


def word_tokens(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _source(source_col: str) -> Column:
    name = F.col(source_col).cast("string")
    return F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), name))


def _measure(totals: DataFrame, exponents: list[float], budget: int | None) -> list[tuple[float, float]]:
    """(most passes, entropy) of the mix at each exponent; one aggregation over the sources."""
    t = F.col("tokens").cast("double")
    columns = []
    for a in exponents:
        p = F.pow(t, F.lit(a))
        columns += [F.sum(p), F.sum(p * F.log(p)), F.max(p / t), F.max(t / p)]
    row = totals.filter("tokens > 0").agg(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    out = []
    for k in range(len(exponents)):
        z, zl, most, least = row[4 * k : 4 * k + 4]
        scale = budget / z if budget is not None else least     # passes of a source: scale * p / t
        out.append((scale * most, math.log(z) - zl / z))
    return out


def fit_exponent(totals: DataFrame, repeat_limit: float | None, entropy_share: float | None, budget: int | None) -> float:
    """Bisection over [0, 1]. Passes fall and entropy falls as the exponent grows."""
    n = totals.filter("tokens > 0").count()
    if n < 2:
        return 1.0
    target = (entropy_share or 0) * math.log(n)
    fits = (lambda m: m[0] <= repeat_limit + 1e-12) if repeat_limit is not None else (lambda m: m[1] < target)
    low, high = 0.0, 1.0
    if fits(_measure(totals, [0.0], budget)[0]):
        return 0.0
    for _ in range(ROUNDS):
        inner = [low + (high - low) * (k + 1) / (LEVELS + 1) for k in range(LEVELS)]
        held = [fits(m) for m in _measure(totals, inner, budget)]
        first = held.index(True) if True in held else LEVELS
        low, high = ([low] + inner)[first], (inner + [high])[first]
    return high if repeat_limit is not None else low


def mix(docs: DataFrame, repeat_limit: float | None = REPEAT_LIMIT, entropy_share: float | None = None, budget: int | None = None,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` and mix_tokens, mix_pass (from 0), mix_block, mix_position: a row for
    each time that a document is read. ``mix_position`` runs from 0 to 1 over a source's
    budget; sorted by it, the sources interleave at their weights. Columns of these names are
    replaced."""
    columns = [c for c in docs.columns if c not in ("mix_tokens", "mix_pass", "mix_block", "mix_position")]
    rows = docs.withColumns({"__src": _source(source_col), "mix_tokens": tokens if tokens is not None else word_tokens(text_col)})
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), "mix_tokens")
    totals = cut_lineage(rows.groupBy("__src").agg(F.count("*").alias("rows"), F.sum("mix_tokens").alias("tokens")))
    alpha = fit_exponent(totals, repeat_limit if entropy_share is None else None, entropy_share, budget)

    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha))).otherwise(0.0)
    whole = totals.filter("tokens > 0").agg(F.sum(power).alias("z"), F.max(F.col("tokens") / power).alias("least")).first()
    scale = (budget / whole.z if budget is not None else whole.least) if whole.z else 0.0
    share = F.round(F.lit(scale) * power).cast("long")
    plan = totals.select("__src", F.col("rows").alias("__rows"), F.col("tokens").alias("__tokens"), F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("__blocks"), share.alias("__share"))
    plan = plan.withColumn("__passes", F.when(F.col("__tokens") > 0, F.floor(F.col("__share") / F.col("__tokens"))).otherwise(1).cast("int"))
    plan = cut_lineage(plan.withColumn("__part", F.when(F.col("__tokens") > 0, F.col("__share") - F.col("__passes") * F.col("__tokens")).otherwise(0)))

    # A row for each source: broadcast if there are few enough of them, else joined.
    counts = plan.agg(F.count("*").alias("sources"), F.sum(F.col("__blocks") * (F.col("__passes") + 1)).alias("blocks")).first()
    small = lambda df, n: F.broadcast(df) if (n or 0) <= BROADCAST_ROWS else df
    dealt = rows.join(small(plan.select("__src", "__blocks", "__passes", "__part", "__share", "__tokens"), counts.sources), "__src")
    dealt = dealt.withColumn("mix_block", F.pmod(key, F.col("__blocks")).cast("int"))
    last = F.col("__passes") - F.when(F.col("__part") > 0, 0).otherwise(1)
    block_sizes = dealt.groupBy("__src", "mix_block").agg(F.sum("mix_tokens").alias("__block_tokens"), F.first("__passes").alias("__passes"), F.first("__part").alias("__part"), F.first("__tokens").alias("__tokens"))
    passes = block_sizes.filter(last >= 0).withColumn("mix_pass", F.explode(F.sequence(F.lit(0), last)))
    order = F.xxhash64(F.lit(seed), "mix_pass", "mix_block")
    before = F.sum("__block_tokens").over(Window.partitionBy("__src", "mix_pass").orderBy(order, "mix_block").rowsBetween(Window.unboundedPreceding, -1))
    room = F.when(F.col("mix_pass") < F.col("__passes"), F.col("__tokens")).otherwise(F.col("__part"))
    # A whole pass reads every block; the part reads those that begin inside it.
    reached = (passes.withColumn("__before", F.coalesce(before, F.lit(0))).withColumn("__room", room)
               .filter((F.col("mix_pass") < F.col("__passes")) | (F.col("__before") < F.col("__room"))).select("__src", "mix_block", "mix_pass", "__before", "__room"))

    met = dealt.join(small(reached, counts.blocks), ["__src", "mix_block"])
    inside = Window.partitionBy("__src", "mix_pass", "mix_block").orderBy(F.xxhash64(F.lit(seed), "mix_pass", F.col(id_col).cast("string")), F.col(id_col), "mix_tokens")
    end = F.col("__before") + F.sum("mix_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    position = (F.col("mix_pass") * F.col("__tokens") + F.col("__end") - F.col("mix_tokens")) / F.greatest(F.col("__share"), F.lit(1))
    return (met.withColumn("__end", end).filter(F.col("__end") <= F.col("__room"))
            .select(*columns, "mix_tokens", "mix_pass", "mix_block", position.alias("mix_position")))
