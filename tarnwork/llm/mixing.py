"""Mixing sources to target shares of the tokens.

The mixture is made of blocks of equal size. Sainte-Laguë apportionment gives the blocks to sources, one after the other to
the highest quotient of target share and 2 * blocks + 1, a source whose allowed repeats are used up dropping out; the same
method divides a source's blocks among its shards by their tokens. A shard's documents, in a seeded order, are a circle of
blocks: whole rounds of it first, then the leading blocks of a further one.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.llm.tokens import token_count
from tarnwork.session import cut


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), at most ``caps`` each; ties go to the first. Fewer seats are given if
    the caps do not allow more; weights of 0 get none.

    All quotients above a divisor found by bisection are taken at once, the last few seats one by one, so the time does not
    depend on the number of seats.
    """
    caps = [seats] * len(weights) if caps is None else [min(c, seats) for c in caps]
    caps = [c if w > 0 else 0 for w, c in zip(weights, caps)]
    seats = min(seats, sum(caps))
    # the quotients of w that are greater than d: those with 2 k + 1 < w / d
    above = lambda d: [min(c, max(0, math.ceil((w / d - 1) / 2))) if w > 0 else 0 for w, c in zip(weights, caps)]
    lo, hi = 0.0, max(weights, default=0.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (lo, mid) if sum(above(mid)) <= seats else (mid, hi)
    got = above(hi) if hi else [0] * len(weights)
    heap = [(-w / (2 * g + 1), i) for i, (w, g) in enumerate(zip(weights, got)) if g < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def shard_quotas(held: DataFrame, seats: DataFrame) -> DataFrame:
    """(source, shard, blocks): Sainte-Laguë apportionment of each source's ``seats`` (source, blocks) among its shards,
    ``held`` (source, shard, tokens, cap), by the quotients tokens / (2 k + 1), at most ``cap`` blocks each.

    Rounding a shard's exact share gives nearly all of its blocks; the sum can be off by half a block a shard, so only the
    quotients of that many blocks around it are ranked, in proportion to the shard's tokens. What a task has to rank is a few
    rows a shard of one source; shards are of ``shard_tokens``, so that is a few rows per sixteen million tokens.
    """
    own = W.partitionBy("source")
    s = held.join(seats, "source").withColumn("__all", F.sum("tokens").over(own)).withColumn("__n", F.count(F.lit(1)).over(own))
    exact = F.col("tokens").cast("double") * F.col("blocks") / F.col("__all")
    near = F.ceil(F.col("tokens").cast("double") * F.col("__n") / (2.0 * F.col("__all"))) + 2
    q = s.withColumn("__q", F.ceil(exact - 0.5)).withColumn("__lo", F.greatest(F.lit(0), F.least(F.col("__q") - near, F.col("cap")))).withColumn("__hi", F.least(F.col("__q") + near, F.col("cap")))
    q = q.withColumn("__left", F.col("blocks") - F.sum("__lo").over(own))
    more = q.where("__hi > __lo").select("source", "shard", "tokens", "__left", F.explode(F.sequence(F.col("__lo"), F.col("__hi") - 1)).alias("__k"))
    order = own.orderBy(F.desc(F.col("tokens").cast("double") / (2 * F.col("__k") + 1)), "shard", "__k")
    won = more.withColumn("__rank", F.row_number().over(order)).where("__rank <= __left").groupBy("source", "shard").agg(F.count(F.lit(1)).alias("__won"))
    return q.join(won, ["source", "shard"], "left").select("source", "shard", "tokens", (F.col("__lo") + F.coalesce("__won", F.lit(0))).alias("blocks"))


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """(source, share, cap) in the order of sources; as many as there are sources."""
    rows = targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats").collect()
    return sorted((r.source, r.target_share or 0.0, r.max_repeats if r.max_repeats is not None else 1) for r in rows)


def source_quotas(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 64) -> list[tuple[str, float, int, int, int]]:
    """(source, target_share, max_repeats, available_tokens, blocks) for each source of ``targets``, on the driver."""
    want = _targets(targets)
    have = {r.source: r.t for r in docs.where(F.col("source").isin([w[0] for w in want]) & (F.col("n_tokens") > 0)).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    avail = [have.get(s, 0) for s, _, _ in want]
    caps = [-(-a * c // block_tokens) if c > 0 else 0 for a, (_, _, c) in zip(avail, want)]
    total = total_tokens if total_tokens is not None else sum(avail)
    blocks = sainte_lague([w if a else 0.0 for (_, w, _), a in zip(want, avail)], total // block_tokens, caps)
    return [(s, w, c, a, b) for (s, w, c), a, b in zip(want, avail, blocks)]


def mix_sources(
    docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 64, shard_tokens: int = 1 << 24, seed: int = 11
) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, n_tokens, repeats) and its shares (source, target_share, max_repeats, available_tokens,
    quota_tokens, mixed_tokens, share).

    ``docs``: doc_id, source, n_tokens. ``targets``: source, target_share, max_repeats, as many rows as there are sources;
    null caps count as 1. ``total_tokens``: size of the mixture; without it, the tokens that the listed sources hold. A source
    at its cap leaves its blocks to the others by their quotients. Sources without target, and documents without tokens or
    with a null source, are not mixed; a target without documents is reported with a share of 0. ``shard_tokens`` bounds what
    one task has to order; a source of any size is split by a hash of doc_id.

    The driver sees one row per source. What the mixture holds of a shard differs from its quota by at most half a document.
    """
    spark = docs.sparkSession
    plan = source_quotas(docs, targets, total_tokens, block_tokens)
    per_source = spark.createDataFrame([(s, c, b, max(1, math.ceil(a / shard_tokens))) for s, _, c, a, b in plan if b > 0], "source string, cap int, blocks long, shards int")
    mine = docs.where("n_tokens > 0").select("doc_id", "source", "n_tokens").join(F.broadcast(per_source.select("source", "shards")), "source")
    mine = mine.select("doc_id", "source", "n_tokens", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")).cast("int").alias("shard"))
    held = mine.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens")).join(F.broadcast(per_source.select("source", F.col("cap").alias("__c"))), "source")
    full = F.ceil(F.col("tokens") * F.col("__c") / F.lit(block_tokens))
    quotas = shard_quotas(held.select("source", "shard", "tokens", full.alias("cap")), per_source.select("source", "blocks"))
    # a source at its cap gives all of every shard: its blocks are those of its shards' caps, or nearly
    quotas = quotas.join(F.broadcast(spark.createDataFrame([(s, c, b >= -(-a * c // block_tokens)) for s, _, c, a, b in plan], "source string, __c int, __all boolean")), "source")
    limit = F.col("tokens") * F.col("__c")
    quotas = quotas.select("source", "shard", F.col("tokens").alias("held"), F.when(F.col("__all"), limit).otherwise(F.least(F.col("blocks") * block_tokens, limit)).alias("quota"), F.col("__c").alias("cap"))
    order = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = mine.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(quotas, ["source", "shard"])
    rounds = F.expr("quota DIV held")
    extra = F.expr("2 * before + n_tokens <= 2 * (quota - (quota DIV held) * held)").cast("int")
    mixed = placed.select("doc_id", "source", "n_tokens", F.least(rounds + extra, F.col("cap")).cast("int").alias("repeats")).where("repeats > 0")
    per = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"))
    known = spark.createDataFrame([(s, w, c, a, b * block_tokens) for s, w, c, a, b in plan], "source string, target_share double, max_repeats int, available_tokens long, quota_tokens long")
    full_report = known.join(per, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    share = F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.sum("mixed_tokens").over(W.partitionBy())), F.lit(0.0))
    return mixed, full_report.withColumn("share", share)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, n_tokens, written once: every later step reads the counts, not the texts."""
    return cut(docs.select("doc_id", "source", token_count("text", path).alias("n_tokens")), "tokens")
