"""Mixing sources to target weights: exact block quotas, split over output shards by a hypergeometric tree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.once import computed_once
from tidemark.llm.texts import WORD, saved


@dataclass(frozen=True)
class Plan:
    """Parameters of a mix.

    Sources in code point order, null last, have the ``weights`` in turn. They share ``share`` times
    all words, each at most ``most`` times its own. Blocks have ``block_words`` words, or more
    if there would be over ``max_blocks``; a shard has about ``shard_blocks`` blocks.
    """

    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block_words: int = 256
    max_blocks: int = 1 << 16
    shard_blocks: int = 64
    bucket_rows: int = 50_000
    seed: int = 7


@dataclass(frozen=True)
class Mix:
    """``documents``: a row per document with the words taken of it. ``pieces``: the runs of words in each shard."""

    documents: DataFrame
    pieces: DataFrame


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``number``, ``weight`` and ``target`` to one row per source (source, source_size).

    With the sources in order of size over weight, those that reach their most come first; the
    first that does not sets the level for itself and the rest.
    """
    by_name = W.orderBy(F.asc_nulls_last("source"))
    weights = F.array(*[F.lit(float(w)) for w in plan.weights])
    number = F.row_number().over(by_name) - 1
    rows = sources.select("*", number.cast("long").alias("number"))
    rows = rows.withColumn("weight", weights[(F.col("number") % len(plan.weights)).cast("int")])
    rows = rows.withColumn("cap", (plan.most * F.col("source_size")).cast("double"))
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "number")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    after = by_cap.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = plan.share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    rows = rows.withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    level = F.max("level").over(every)
    target = F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))
    return rows.select("source", "source_size", "number", target.alias("target"))


def split(quotas: Column, shard: Column, seed: int) -> Column:
    """Blocks of each source that go to the left half of a shard: multivariate hypergeometric, half of all in sum.

    One block after the other goes left with the probability that is due: places left over blocks left.
    """
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    begin = F.struct(
        total.alias("rest"), F.floor(total / 2).alias("open"), F.expr("cast(array() as array<bigint>)").alias("out")
    )

    def source(state: Column, quota: Column) -> Column:
        def block(drawn: Column, i: Column) -> Column:
            chance = uniform(F.lit(seed), shard, F.size(state["out"]), i)
            return drawn + F.when(chance * (state["rest"] - i) < state["open"] - drawn, 1).otherwise(0)

        units = F.when(quota > 0, F.sequence(F.lit(0).cast("long"), quota - 1)).otherwise(
            F.expr("cast(array() as array<bigint>)")
        )
        left = F.aggregate(units, F.lit(0).cast("long"), block)
        # A one-element array holds the count, so that it is not drawn three times.
        return F.element_at(
            F.transform(
                F.array(left),
                lambda x: F.struct(
                    (state["rest"] - quota).alias("rest"),
                    (state["open"] - x).alias("open"),
                    F.concat(state["out"], F.array(x)).alias("out"),
                ),
            ),
            1,
        )

    return F.aggregate(quotas, begin, source, lambda state: state["out"])


def shard_quotas(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """Rows (shard, number, quota) of 2 ** depth shards, from one row per source (number, quota)."""
    root = F.transform(F.array_sort(F.collect_list(F.struct("number", "quota"))), lambda s: s["quota"])
    nodes = quotas.agg(root.alias("quotas")).select(F.lit(1).cast("long").alias("shard"), "quotas")
    for _ in range(depth):
        nodes = computed_once(nodes, "left", split(F.col("quotas"), F.col("shard"), seed))
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        halves = F.array(
            F.struct((2 * F.col("shard")).alias("shard"), F.col("left").alias("quotas")),
            F.struct((2 * F.col("shard") + 1).alias("shard"), right.alias("quotas")),
        )
        nodes = nodes.select(F.inline(halves))
    first = 1 << depth
    return nodes.select((F.col("shard") - first).alias("shard"), F.posexplode("quotas").alias("number", "quota"))


def numbers(id_column: str, text: str, source: str) -> list[Column]:
    """What the mix reads of a document: id, source and size."""
    names = [F.col(f"`{id_column}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source")]
    return [*names, word_count(F.col(f"`{text}`")).alias("size")]


def counted_through(rows: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, source, size, and columns that order rows of equal id and size) with the words of their source
    before them (``begin``); the sources; the words of a block."""
    seed = plan.seed
    n, words = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(plan.block_words, -(-plan.most * words // plan.max_blocks))
    buckets = max(1, -(-n // plan.bucket_rows))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(buckets)).cast("int")
    names, rows = rows.columns, rows.withColumn("bucket", bucket)

    by_bucket = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sources = targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), plan)
    sources = saved(sources, "targets")
    so_far = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = by_bucket.select("source", "bucket", F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("offset"))

    # Words of a source counted through: the bucket's offset, and the words before in the bucket.
    same = ["source", "bucket"]
    order = W.partitionBy(*same).orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id", "size", *names[3:])
    counted = rows.select(
        "*",
        F.row_number().over(order).alias("row"),
        (F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("begin"),
    )
    known = starts.alias("a").join(sources.alias("b"), F.expr("a.source <=> b.source"))
    known = known.select("a.source", "bucket", "offset", "source_size", "number", "target")
    placed = counted.alias("c").join(known.alias("k"), F.expr("c.source <=> k.source AND c.bucket = k.bucket"))
    placed = placed.select(
        *[f"c.{name}" for name in names], "source_size", "target", "number", "c.bucket", "row",
        (F.col("begin") + F.col("offset")).alias("begin"),
    )
    return placed, sources, block


def mix_sources(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", plan: Plan = Plan()
) -> Mix:
    """The mix of all documents, the same in every run.

    The documents of a source stand in an order of hashes, and their words are counted through, so that
    a block is a run of words. The blocks of ``most`` passes over the source are permuted within
    each pass, and the first that make up the target are taken, the last in part. The tree deals out
    how many blocks of each source a shard gets; it draws these from a second permutation, without
    overlap, and puts its pieces in random order.

    Null texts have no words and none are taken; a null source is a source of its own. Null ids and repeated
    rows are documents of their own. An empty table gives no rows. Other columns are not read.
    """
    rows = saved(docs.select(*numbers(id_column, text, source)), "sizes")
    placed, sources, block = counted_through(rows, plan)
    drawn = blocks_drawn(sources, equal_blocks(sources, block), plan)
    spread = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(plan.most - 1))).alias("turn"))
    covered = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))
    spread = spread.select("*", F.explode_outer(F.when(F.col("size") > 0, covered)).alias("block"))
    met = spread.join(drawn, ["number", "turn", "block"], "left")
    low = F.greatest(F.col("begin"), F.col("block") * block)
    high = F.least(F.col("begin") + F.col("size"), F.col("block") * block + F.col("words"))
    # least() leaves nulls out, so that blocks that were not drawn are told by their words.
    overlap = F.when(F.col("words").isNotNull(), F.greatest(high - low, F.lit(0)))
    met = met.withColumn("n_words", F.coalesce(overlap, F.lit(0)))

    place = ["number", "bucket", "row", "begin", "id", "source", "size", "source_size", "target"]
    documents = met.groupBy(*place).agg(F.sum("n_words").alias("taken"))
    pieces = met.where("n_words > 0").select(
        "shard", "id", "source", "turn", (low - F.col("begin")).alias("from_word"), "n_words"
    )
    shuffled = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(plan.seed + 2), "id", "turn", "from_word"), "id", "turn")
    return Mix(
        documents.select(F.col("id").alias(id_column), *place[5:], "taken"),
        pieces.withColumn("position", F.row_number().over(shuffled)),
    )


def equal_blocks(sources: DataFrame, block: int) -> DataFrame:
    """The words of each source in blocks of that many, the last of a source with the rest."""
    last = F.floor((F.col("source_size") - 1) / block)
    rows = sources.where("source_size > 0").select(
        "number", "source_size", "target", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")
    )
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    return rows.select("number", "target", "block", length.alias("length"))


def blocks_drawn(sources: DataFrame, blocks: DataFrame, plan: Plan) -> DataFrame:
    """Of the ``blocks`` (number, target, block, length) those that the mix takes (number, turn, block, words, shard);
    at most about ``max_blocks`` rows."""
    seed = plan.seed
    rows = blocks.select(
        "number",
        F.round("target").cast("long").alias("wanted"),
        F.explode(F.sequence(F.lit(0), F.lit(plan.most - 1))).alias("turn"),
        "block",
        "length",
    )
    key = ["number", "turn", "block"]
    order = W.partitionBy("number").orderBy("turn", F.xxhash64(F.lit(seed + 3), *key), "block")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("words", F.least(F.col("length"), F.col("wanted") - before)).where("words > 0")
    again = W.partitionBy("number").orderBy(F.xxhash64(F.lit(seed + 4), *key), "turn", "block")
    rows = saved(rows.select(*key, "words", F.row_number().over(again).cast("long").alias("rank")), "blocks")

    quotas = sources.join(rows.groupBy("number").agg(F.count("*").alias("quota")), "number", "left")
    quotas = quotas.select("number", F.coalesce("quota", F.lit(0)).alias("quota"))
    depth = max(0, (rows.count() // plan.shard_blocks).bit_length() - 1)
    leaves = shard_quotas(quotas, depth, seed + 5)
    by_shard = W.partitionBy("number").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    leaves = leaves.withColumn("to", F.sum("quota").over(by_shard)).where("quota > 0")
    ranks = F.explode(F.sequence(F.col("to") - F.col("quota") + 1, F.col("to"))).alias("rank")
    dealt = leaves.select(F.col("number").cast("long"), "shard", ranks)
    return rows.join(dealt, ["number", "rank"]).select(*key, "words", "shard")


def whole_documents(rows: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The mix in whole documents (key, number, size, turn, block, shard, position), from rows (id, source, size, print, key).

    A document belongs to the block that its middle word lies in, whatever its length, and is taken in each pass
    in which this block is drawn; its shard is the one the tree deals the block to. Of the last block of a source the
    documents are taken whose middle comes before the target's end, so that a source has its target but for half
    a document at most. Documents without words belong to no block.
    """
    placed, sources, block = counted_through(rows, plan)
    middle = F.floor((F.col("begin") + F.floor(F.col("size") / 2)) / block)
    placed = placed.where("size > 0").select("key", "number", "target", "size", "begin", middle.alias("block"))
    placed = saved(placed, "placed")
    blocks = placed.groupBy("number", "target", "block").agg(F.sum("size").alias("length"))
    drawn = blocks_drawn(sources, blocks, plan)
    before = W.partitionBy("number", "block").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    met = inside.join(drawn, ["number", "block"]).where(F.col("offset") + F.col("size") / 2 < F.col("words"))
    unit = ["number", "begin", "turn"]
    shuffled = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(plan.seed + 2), *unit), *unit)
    return met.select("key", "number", "size", "turn", "block", "shard", F.row_number().over(shuffled).alias("position"))


def repeated(docs: DataFrame, names: Sequence[str] = ("doc_id", "text", "source"), plan: Plan = Plan()) -> DataFrame:
    """The documents as the mix takes them, whole, as often as their block is drawn: see :func:`whole_documents`.

    The rows come shard by shard, each shard in one partition and in its random order. Repeated rows are documents of
    their own. Of rows of equal id, source and size, the hash of the text says which comes first.
    """
    id_column, text, source = names
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keys = [F.xxhash64(F.col(f"`{text}`")).alias("print"), F.monotonically_increasing_id().alias("key")]
    # Keys hold for what a task wrote, so they are used only once written.
    rows = saved(docs.select(whole, *numbers(id_column, text, source), *keys), "numbered")
    dealt = whole_documents(rows.select("id", "source", "size", "print", "key"), plan)
    rows = rows.select("doc", "key").join(dealt.select("key", "shard", "position"), "key")
    return rows.repartition("shard").sortWithinPartitions("shard", "position").select("doc.*")
