"""Temperature mixing of sources, realised as budgeted block permutations.

Source i with token share p_i gets the weight p_i^a / sum_j p_j^a. The exponent a in [0, 1] is bisected: the smallest a
(the flattest mix) whose entropy is at most ``entropy`` times the largest possible, and under which no source is
repeated more than ``max_repeats`` times. A token budget then gives every source a quota; the default budget is the
smallest one that shows each document of each source at least once, so nothing is lost to mixing.

A quota of e whole epochs and a rest is realised over blocks: documents are dealt into blocks of about
``block_tokens`` tokens by a hash, each epoch visits the blocks of a source in an order of its own, and the last,
partial epoch takes whole blocks in that order and of one more block the documents that begin within the quota.
``mixed_rows`` writes the permutation out: a block stands at (epoch + its place in the epoch) / (epochs of its source)
of the whole, so that blocks stay together, epochs follow one another, and every stretch has the sources in their weights.

Scale: two aggregates (tokens per source, tokens per block) and, for the one boundary block of each source, a running
sum within that block. Blocks have a bounded size whatever share of the rows a source has, so no task ever holds a
source. The driver sees one row per source (``max_sources`` is checked). Documents are repeated by ``explode``, not by a
join. ``mixed_rows`` moves the texts once, to sort them by place; places are spread evenly, whatever the sources' sizes.

Defined results: a null source is a source of its own; null or wordless text has no tokens and is shown in whole epochs
only. Rows that repeat an id are separate documents, and in the same block if they repeat the text too. Extra columns
are kept; ``mix`` and ``ordered`` replace ones that have the names of their own (MIX_COLUMNS), ``mixed_rows`` keeps those too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.llm.common import WHITE, cut, text_of

BLOCK_TOKENS = 1_000_000
MIX_COLUMNS = ("mix_epochs", "mix_tokens", "mix_block", "mix_key", "mix_passes", "mix_epoch", "mix_order", "mix_place")


def word_tokens(text_col: str = "text") -> Column:
    """Tokens of a text as words; a cheap, language-blind stand-in for a tokenizer's count."""
    return F.regexp_count(text_of(text_col), F.lit(WHITE.replace("[", "[^") + "+")).cast("long")


@dataclass
class Mix:
    exponent: float
    weights: dict
    quotas: dict


def _weights(tokens: dict, a: float) -> dict:
    total = sum(tokens.values())
    power = {k: (t / total) ** a for k, t in tokens.items()}
    z = sum(power.values())
    return {k: x / z for k, x in power.items()}


def _entropy(w: dict) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def solve(tokens: dict, entropy: float | None = None, max_repeats: float | None = 2.0, budget: float | None = None, steps: int = 60) -> Mix:
    """The mix of sources with these token counts; sources without tokens get no weight and one epoch."""
    have = {k: t for k, t in sorted(tokens.items(), key=lambda x: (x[0] is None, x[0] or "")) if t > 0}
    if not have:
        return Mix(1.0, {}, {})

    def spent(w: dict) -> float:
        return budget if budget is not None else max(have[k] / w[k] for k in have)

    def fits(a: float) -> bool:
        w = _weights(have, a)
        flat = entropy is None or len(have) < 2 or _entropy(w) <= entropy * math.log(len(have)) + 1e-12
        return flat and (max_repeats is None or max(spent(w) * w[k] / have[k] for k in have) <= max_repeats + 1e-12)

    low, high = 0.0, 1.0
    if fits(low):
        high = low
    else:
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (low, mid) if fits(mid) else (mid, high)
    w = _weights(have, high)
    total = spent(w)
    quotas = {}
    for k in have:
        q = total * w[k]
        quotas[k] = int(round(q)) if abs(q / have[k] - round(q / have[k])) > 1e-9 else round(q / have[k]) * have[k]
    return Mix(high, w, quotas)


def _mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens: Column | None = None, entropy: float | None = None, max_repeats: float | None = 2.0,
    budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 0, max_sources: int = 100_000,
) -> DataFrame:
    """``row`` (the row of ``docs``), s (its source), and mix_epochs, mix_tokens, mix_block, mix_key, mix_passes (epochs of the source, the partial one as a fraction)."""
    n_tokens = tokens if tokens is not None else word_tokens(text_col)
    by_source = docs.select(F.col(source_col).cast("string").alias("s"), n_tokens.alias("n")).groupBy("s").agg(F.sum("n").alias("n"))
    found = by_source.limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r.s: int(r.n or 0) for r in found}
    plan = solve(sizes, entropy, max_repeats, budget)
    rows = [(k, int(plan.quotas.get(k, 0) // t) if t else 1, int(plan.quotas.get(k, 0) % t) if t else 0, max(1, -(-t // block_tokens)), max(plan.quotas.get(k, 0) / t, 1e-9) if t else 1.0) for k, t in sizes.items()]
    # For each source: whole epochs, tokens of the partial epoch, blocks, all epochs. One row a source, max_sources at most.
    quota = F.broadcast(docs.sparkSession.createDataFrame(rows, "q_s string, q_epochs long, q_rest long, q_blocks long, q_passes double"))

    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source_col).cast("string").alias("s"), n_tokens.alias("n"), F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col)).alias("h"))
    own = own.join(quota, F.col("s").eqNullSafe(F.col("q_s"))).withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), "q_blocks"))
    order = F.xxhash64(F.lit(seed + 2), "s", "block", "q_epochs")  # the order of the blocks in the partial epoch

    light = own.where("q_rest > 0 and n > 0").select("s", "block", "h", "n", "q_rest", order.alias("o"))
    blocks = light.groupBy("s", "block", "o", "q_rest").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("o", "block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = cut(blocks.withColumn("before", F.coalesce(before, F.lit(0))).where("before < q_rest"))
    edge = blocks.where("before + n > q_rest").select(F.col("s").alias("e_s"), F.col("block").alias("e_b"), "before")
    inside = light.join(F.broadcast(edge), F.col("s").eqNullSafe(F.col("e_s")) & (F.col("block") == F.col("e_b")))
    same = inside.groupBy("s", "block", "q_rest", "before", "h").agg(F.sum("n").alias("n"))  # repeated rows go together
    so_far = F.sum("n").over(Window.partitionBy("s", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    last = same.withColumn("p", F.col("before") + F.coalesce(so_far, F.lit(0))).where("p < q_rest").groupBy("s").agg(F.max("h").alias("last_h"))
    taken = blocks.groupBy("s").agg(F.max(F.struct("o", "block")).alias("edge"))
    ends = taken.join(last.withColumnRenamed("s", "l_s"), F.col("s").eqNullSafe(F.col("l_s")), "left").select(F.col("s").alias("t_s"), F.col("edge.o").alias("edge_o"), F.col("edge.block").alias("edge_b"), "last_h")
    own = own.withColumn("o", order).join(F.broadcast(ends), F.col("s").eqNullSafe(F.col("t_s")), "left")
    at, edge_at = F.struct("o", "block"), F.struct("edge_o", "edge_b")
    more = F.when(F.col("q_rest") == 0, False).when(at < edge_at, True).when(at == edge_at, F.col("last_h").isNull() | (F.col("h") <= F.col("last_h"))).otherwise(False)
    more = F.coalesce(more, F.lit(False)) & (F.col("n") > 0)
    return own.select("row", "s", (F.col("q_epochs") + more.cast("long")).alias("mix_epochs"), F.col("n").alias("mix_tokens"), F.col("block").alias("mix_block"), F.col("h").alias("mix_key"), F.col("q_passes").alias("mix_passes"))


def _shown(mixed: DataFrame, seed: int) -> DataFrame:
    """``mixed`` exploded to one row per showing, with mix_epoch, mix_order and mix_place."""
    shown = mixed.where("mix_epochs > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_epochs") - 1)))
    of_block = F.xxhash64(F.lit(seed + 2), "s", "mix_block", "mix_epoch")
    order = F.struct(of_block.alias("of_block"), F.xxhash64(F.lit(seed + 3), "mix_key", "mix_epoch").alias("in_block"))
    place = (F.col("mix_epoch") + of_block / F.lit(2.0**64) + 0.5) / F.col("mix_passes")
    return shown.withColumn("mix_order", order).withColumn("mix_place", place)


def _named(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in MIX_COLUMNS), *(c for c in MIX_COLUMNS if c in found.columns))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``mix_epochs``: how often each row is shown, and mix_tokens, mix_block, mix_key, mix_passes.

    Options: id_col, text_col, source_col, tokens, entropy, max_repeats, budget, block_tokens, seed, max_sources.
    """
    return _named(_mixed(docs, **options), docs)


def ordered(docs: DataFrame, **options) -> DataFrame:
    """One row per showing: as ``mix``, with ``mix_epoch``; ``mix_order``, by which an epoch of a source is sorted block after block; ``mix_place``, where its block stands in the whole."""
    return _named(_shown(_mixed(docs, **options), options.get("seed", 0)), docs)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix shows them, in its order: each as often as it has epochs, with the columns of ``docs`` only."""
    shown = _shown(_mixed(docs, **options), options.get("seed", 0))
    return shown.orderBy("mix_place", "s", "mix_block", "mix_order.in_block", "mix_key").select("row.*")
