"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree (DataFrame code only).

1. A hash permutes each source's documents and cuts them into disjoint blocks; a source of more words
   has more blocks (at least 1024). Nothing depends on how the rows are stored or on the number of sources.
2. Each source's target decides how many whole passes its blocks make and how many blocks of the
   permuted order make one more, so that the words taken come within half a block of the target.
3. The tree hands the taken block quotas of all sources down to the output shards: at each node a
   multivariate-hypergeometric draw splits the node's quotas exactly between its two halves. The
   draws need the quotas only (one number per source), so they are made on the driver, down to as many
   subtrees as it may plan. Within a subtree of several shards a hash permutes the block copies and
   equal cuts of that order are the shards, which is the same draw made in Spark.
4. Each source's block copies, in permuted order, are dealt to the subtrees by these quotas, disjointly.
   Within a shard, a hash of document and copy gives the order (a local shuffle).

Documents meet the block plan in one broadcast or shuffled join by (source, block), never in a
window over documents; a source that holds a third of all rows is spread over its blocks. Each source is
one row on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, unit_hash

LEAST_BLOCKS, LEAST_SHARDS = 1024, 4
#: Words of a block and of an output shard, about.
BLOCK_WORDS, SHARD_WORDS = 2_000_000, 20_000_000
#: Quotas (a number for each source and subtree) that the driver plans at most.
MOST_QUOTAS = 2_000_000
#: Rows of the block plan up to which it is broadcast (about 40 bytes each).
BROADCAST_ROWS = 200_000
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def count_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares of the total of ``sizes`` by weight, none above ``most`` times its size; the excess of
    those that reach it is shared again among the others by weight."""
    total, capped = float(sum(sizes)), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in sorted(capped))
        weight = sum(weights[i] for i in free)
        share = {i: left * weights[i] / weight for i in free} if weight else {}
        over = {i for i in free if share[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in capped else share.get(i, 0.0) for i in range(len(sizes))]
        capped |= over


def split_quotas(quotas: np.ndarray, shards: int, seed: int, groups: int | None = None) -> np.ndarray:
    """(groups, sources) counts: exact multivariate-hypergeometric splits down a binary tree. A group has an
    equal number of the shards, but for one; without ``groups`` each shard is one."""
    groups = groups or shards
    begin = [g * shards // groups for g in range(groups + 1)]
    out = np.zeros((groups, len(quotas)), np.int64)

    def descend(node: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1 or not node.sum():
            out[lo] += node
            return
        mid = (lo + hi) // 2
        n = int(round(int(node.sum()) * (begin[mid] - begin[lo]) / (begin[hi] - begin[lo])))
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(node, n, method="marginals")
        descend(left, lo, mid)
        descend(node - left, mid, hi)

    descend(np.asarray(quotas, np.int64), 0, groups)
    return out


def blocks_for(words: int) -> int:
    return max(LEAST_BLOCKS, 1 << max(0, int(words) // BLOCK_WORDS - 1).bit_length())


def plan_mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    shards: int | None = None,
    seed: int = 11,
    keep_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: its columns (the text only with ``keep_text``), size, source_size,
    target and copies, an array of (copy, shard, rank) with one entry for each time it is taken.

    Sources are ordered by code point, null last (null is a source of its own); ``weights`` repeat
    along that order. Size: runs of non-white-space characters, of the whole text however long; null and empty
    texts have size 0 and may be taken like any other. Repeated rows (same id and text) fall into one block and are
    taken together; rows with a null id share a block by their text. Blocks of a source whose order ties go by
    number. Reruns agree: all draws are hashes or seeded. An empty table gives an empty table. Input columns
    named like an output column are replaced.
    """
    spark = docs.sparkSession
    outputs = ("size", "source_size", "target", "copies")
    base = docs.drop(*outputs)
    columns = base.columns if keep_text else [c for c in base.columns if c != text_col]
    key = F.concat_ws("\u0001", F.col(f"`{id_col}`").cast("string"), F.when(F.col(f"`{id_col}`").isNull(), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)))
    sized = docs.select(
        *[docs[f"`{c}`"] for c in columns],
        count_words(docs[f"`{text_col}`"]).alias("size"),
        docs[f"`{source_col}`"].cast("string").alias("__source"),
        unit_hash(key, seed).alias("__u"),
        F.xxhash64(F.lit(seed + 1), key).alias("__key"),
    )
    slim = materialize(sized.select("__source", "__u", "size") if keep_text else sized, "sizes")
    totals = slim.groupBy("__source").agg(F.sum("size").alias("source_size")).collect()  # one row per source
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    targets = water_fill([r[1] for r in totals], [weights[i % len(weights)] for i in range(len(totals))], most_repeats)
    shards = shards or max(LEAST_SHARDS, -(-sum(r[1] for r in totals) // SHARD_WORDS))
    groups = min(shards, max(LEAST_SHARDS, MOST_QUOTAS // max(1, len(totals))))
    n_blocks = [blocks_for(r[1]) for r in totals]
    source_rows = [(r[0], i, r[1], float(t), n) for i, (r, t, n) in enumerate(zip(totals, targets, n_blocks, strict=True))]
    per_source = spark.createDataFrame(source_rows, "__named string, __nr int, source_size long, target double, __blocks int")
    if len(totals) <= BROADCAST_ROWS:
        per_source = F.broadcast(per_source)

    def in_blocks(rows: DataFrame) -> DataFrame:
        met = rows.join(per_source, F.col("__source").eqNullSafe(F.col("__named"))).drop("__source", "__named")
        return met.withColumn("__block", F.floor(F.col("__u") * F.col("__blocks")).cast("int")).drop("__blocks", "__u")

    # passes: whole ones over all blocks, then the permuted prefix whose words come nearest to the rest
    blocks = in_blocks(slim.select("__source", "__u", "size")).groupBy("__nr", "__block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    blocks = materialize(blocks, "blocks")
    goal = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    in_order = W.partitionBy("__nr").orderBy(F.xxhash64(F.lit(seed + 2), "__block"), "__block")  # a row for each block
    ranked = blocks.select("*", goal.alias("goal"), F.row_number().over(in_order).alias("at"), F.sum("words").over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("upto"))
    whole = F.floor("goal")
    rest = F.col("target") - whole * F.col("source_size")
    before = F.col("upto") - F.col("words")
    extra = (F.col("words") > 0) & (rest - before >= F.col("upto") - rest)
    taken = materialize(ranked.select("__nr", "__block", "at", F.least((whole + extra.cast("int")).cast("int"), F.lit(most_repeats)).alias("times")), "taken")
    quotas = np.zeros(len(totals), np.int64)
    for r in taken.groupBy("__nr").agg(F.sum("times")).collect():
        quotas[r[0]] = r[1]
    tree = split_quotas(quotas, shards, seed, groups)
    ends = np.cumsum(tree, axis=0)
    group, source = np.nonzero(tree)
    quota_rows = zip(source.tolist(), group.tolist(), (ends[group, source] - tree[group, source] + 1).tolist(), ends[group, source].tolist(), strict=True)
    quota = spark.createDataFrame(list(quota_rows), "q_nr int, subtree int, lo long, hi long")
    deal = quota.select("q_nr", "subtree", F.explode(F.sequence("lo", "hi")).alias("q_place"))

    # the source's block copies in permuted order, pass by pass, meet the subtrees' quotas
    each = taken.select("*", F.explode(F.when(F.col("times") > 0, F.sequence(F.lit(1), F.col("times"))).otherwise(F.array().cast("array<int>"))).alias("copy"))
    place = F.row_number().over(W.partitionBy("__nr").orderBy("copy", "at"))  # a row for each block copy
    placed = each.select("__nr", "__block", "copy", place.alias("place")).join(deal, (F.col("__nr") == F.col("q_nr")) & (F.col("place") == F.col("q_place")))
    first, past = ((F.col("subtree").cast("long") + k) * shards for k in (0, 1))
    first, past = F.floor(first / groups), F.floor(past / groups)
    if groups < shards:
        cut = W.partitionBy("subtree")
        nr = F.row_number().over(cut.orderBy(F.xxhash64(F.lit(seed + 3), "__nr", "__block", "copy"), "__nr", "__block", "copy")) - 1
        placed = placed.withColumn("__k", nr).withColumn("__of", F.count("*").over(cut))
        first = first + F.floor(F.col("__k") * (past - first) / F.col("__of"))
    dealt = placed.withColumn("shard", first.cast("int")).groupBy(F.col("__nr").alias("__pn"), F.col("__block").alias("__pb")).agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("__dealt"))
    plan = materialize(dealt, "plan")
    met = in_blocks(sized if keep_text else slim)
    met = met.join(F.broadcast(plan) if sum(n_blocks) <= BROADCAST_ROWS else plan, (F.col("__nr") == F.col("__pn")) & (F.col("__block") == F.col("__pb")), "left")
    copies = F.transform(
        F.coalesce("__dealt", F.array().cast("array<struct<copy:int,shard:int>>")),
        lambda x: F.struct(x["copy"].alias("copy"), x["shard"].alias("shard"), F.xxhash64("__key", x["copy"]).alias("rank")),
    )
    out = met.select(*[F.col(f"`{c}`") for c in columns], "size", "source_size", "target", copies.alias("copies"))
    out._tidemark_shards = shards
    return out


def mix(planned: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix itself: one row per copy (columns of ``planned`` but copies, with copy, shard and rank),
    a shard's rows together and in shuffled order. A shard holds whole blocks of all sources, so no
    source or document makes one shard large. An empty plan gives no rows; rows of equal rank (repeated rows)
    stand in any order; columns of ``planned`` named copy, shard or rank are replaced.

    ``shards``: as planned; needed if ``planned`` is not the table that plan_mixture returned."""
    shards = shards or planned._tidemark_shards
    one = planned.drop("copy", "shard", "rank").select("*", F.explode("copies").alias("__c")).drop("copies")
    rows = one.select("*", "__c.copy", "__c.shard", "__c.rank").drop("__c")
    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "rank")
