"""Near-duplicates by bottom-k sketches of one hash function.

1. Documents with equal shingle sets are one node.
2. Retained values, rarest first, make inverted lists. Two sets that are near enough share so many
   retained values that they meet in the lists of their rarest ones, so only these are made.
3. In each list every node is compared with the list's first; links join nodes to groups.
4. Pairs of a list that are still in different groups are compared: those of short lists where the lists
   that they share are enough, those of long lists in blocks around the group that most of a list belongs to.
5. Of the pairs, those whose union sketch says that they may be near are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.texts import arrow, per_text, saved

CACHED = 1_000_000
TOP = np.iinfo(np.int64).max
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass(frozen=True)
class Nearness:
    """Links are pairs with 100 * intersection >= ``percent`` * union over shingles of ``words`` words.

    A sketch keeps ``k`` values. Of the k least values of the union of two linked sets, ``least`` or more are
    in both but for a chance of about 1 in 200,000 at exactly 80 percent. Lists of up to ``short`` nodes are
    joined as pairs of ids, and ``shared`` such lists are asked of a pair; longer ones are compared in blocks
    of ``block`` nodes or ``block_values`` shingles.
    """

    words: int = 2
    percent: int = 80
    k: int = 64
    least: int = 36
    shared: int = 4
    short: int = 16
    block: int = 2048
    block_values: int = 1 << 20
    broadcast_rows: int = 1_000_000


def shingler(words: int) -> Callable[[bytes], np.ndarray]:
    """A function from a text to the sorted distinct 64-bit hashes of its shingles; fewer words are one shingle."""
    known: dict[bytes, int] = {}

    def number(word: bytes) -> int:
        value = known.get(word)
        if value is None:
            value = known[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def shingles(text: bytes) -> np.ndarray:
        if len(known) > CACHED:
            known.clear()
        split = text.translate(LOWER).split()
        one = np.fromiter(map(number, split), np.uint64, len(split))
        width = min(words, len(one))
        if width == 0:
            return one
        out = np.full(len(one) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + one[i : len(one) - width + 1 + i]
            out ^= out >> np.uint64(32)
            out *= np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(29)
        return np.unique(out)

    return shingles


def arrays(rows: Sequence[np.ndarray]) -> pa.Array:
    """Unsigned values as signed ones of the same order."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *rows])
    return pa.ListArray.from_arrays(ends, (flat ^ np.uint64(1 << 63)).view(np.int64))


SKETCH = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType())]
    + [T.StructField("sketch", T.ArrayType(T.LongType()))]
)


def sketches(words: int, k: int | None) -> Callable[[], Callable]:
    def start() -> Callable:
        shingles = shingler(words)

        def make(texts: Sequence[bytes | None]) -> list:
            sets = [shingles(t or b"") for t in texts]
            turned = [s * np.uint64(0xC2B2AE3D27D4EB4F) for s in sets]
            return [
                np.array([len(s) for s in sets], dtype=np.int64),
                np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64),
                np.array([(t ^ (t >> np.uint64(31))).sum(dtype=np.uint64) for t in turned], np.uint64).view(np.int64),
                arrays([s[:k] for s in sets]),
            ]

        return make

    return start


SET = T.StructType([*SKETCH.fields[1:3], T.StructField("full", T.ArrayType(T.LongType()))])


def full_sets(words: int) -> Callable[[], Callable]:
    """The digests of a set as in its sketch, and the set: a sketch of as many values as there are."""
    every = sketches(words, None)

    def start() -> Callable:
        make = every()
        return lambda texts: make(texts)[1:]

    return start


def least_shared(n: Column, how: Nearness) -> Column:
    """Retained values that a set of n shingles shares with any set linked to it: of whole sets, or of sketches."""
    whole = F.ceil(n * how.percent / 100)
    return F.when(n * 100 <= how.k * how.percent, whole).otherwise(F.least(whole, F.lit(how.least)))


# What a set is found by again.
NAME = ["id", "k1", "k2"]


def rarest(nodes: DataFrame, how: Nearness) -> DataFrame:
    """Inverted lists (value, node, n): of each node the retained values it can be found by.

    With c values shared by any linked set, all but c - 1 of the values are enough to share one, and
    ``shared`` - 1 more to share so many. Values of one node alone use up a place each but make no list.
    """
    each = nodes.select("node", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    each = each.withColumn("nodes", F.count("*").over(W.partitionBy("value"))).where("nodes > 1")
    lists = each.groupBy("node", "n", "kept").agg(
        F.array_sort(F.collect_list(F.struct("nodes", "value"))).alias("values")
    )
    c = least_shared(F.col("n"), how)
    places = F.col("kept") - c + F.least(c, F.lit(how.shared)) - (F.col("kept") - F.size("values"))
    found = F.slice("values", F.lit(1), F.greatest(places, F.lit(0)).cast("int"))
    return lists.select("node", "n", F.explode(found).alias("v")).select(F.col("v.value"), "node", "n")


def near_enough(a: str, b: str, how: Nearness) -> Column:
    """Sizes of two linked sets."""
    return (F.col(a) * 100 >= F.col(b) * how.percent) & (F.col(b) * 100 >= F.col(a) * how.percent)


def rare(df: DataFrame, how: Nearness) -> DataFrame:
    """A table of ids that is sent to all executors if its rows, which are counted, are few."""
    return F.broadcast(df) if df.count() <= how.broadcast_rows else df


def with_sets(rows: DataFrame, texts: DataFrame, how: Nearness) -> DataFrame:
    """``rows`` with the full set as an array ``full``, made anew from the text.

    A row names its set by an id that has it and by the digests of the set, as an id may have several texts.
    """
    wanted = texts.join(rare(rows.select("id").distinct(), how), "id")
    return per_text(wanted, "text", ["id"], SET, full_sets(how.words)).join(rare(rows, how), ["id", "k1", "k2"])


def grouped(
    keys: Sequence[str], work: Callable[[Iterator[tuple[bool, pa.RecordBatch]]], Iterator[pa.RecordBatch]]
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives ``work`` the rows of a task in runs of equal keys: pairs of whether a new group begins, and a part of it."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
        last = None
        for batch in batches:
            values = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(values)], strict=True):
                if start < stop:
                    key = tuple(values[start])
                    yield key != last, batch.slice(start, stop - start)
                    last = key

    return lambda batches: work(parts(batches))


def pairs_of(a: Sequence[int], b: Sequence[int]) -> pa.RecordBatch:
    columns = [pa.array(np.array(x, dtype=np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def near_leader(how: Nearness) -> Callable:
    """Pairs of a group's leader, its first row, and the members that are near it. Rows are held one batch at a time."""

    def work(parts: Iterator[tuple[bool, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        leader, one = 0, np.zeros(0, dtype=np.int64)
        for begins, rows in parts:
            node, (flat, ends) = rows.column("node").to_numpy(), flat_lists(rows.column("full"))
            if begins:
                leader, one = int(node[0]), flat[ends[0] : ends[1]]
            found = []
            for i in range(int(begins), len(node)):
                two = flat[ends[i] : ends[i + 1]]
                low = np.union1d(one[: how.k], two[: how.k])[: how.k]
                shared = np.isin(low, one[: how.k]) & np.isin(low, two[: how.k])
                if len(low) < how.k or shared.sum() >= how.least:
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    if 100 * both >= how.percent * (len(one) + len(two) - both):
                        found.append(node[i])
            yield pairs_of([leader] * len(found), found)

    return grouped(["a", "part"], work)


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists after one another, and where each begins."""
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), ends - ends[0]


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, how: Nearness) -> DataFrame:
    """The pairs (a, b) whose union sketch says that they may be near, and whose full sets are.

    Sets travel once, to the group of their a; a group of many is split and its leader goes to each part.
    """
    parts = F.ceil(F.count("*").over(W.partitionBy("a")) / how.block).cast("int")
    rows = pairs.select("a", "b", parts.alias("parts"))
    members = rows.select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("turn"), F.col("b").alias("node"))
    leaders = members.select("a", "part", F.lit(0).alias("turn"), F.col("a").alias("node")).distinct()
    asked = saved(members.union(leaders).join(nodes.select("node", *NAME), "node"), "pairs")
    keys = ["a", "part", "turn"]
    dealt = with_sets(asked, texts, how).repartition("a", "part").sortWithinPartitions(*keys)
    return arrow(dealt.select(*keys, "node", "full"), near_leader(how), "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """Least node reachable (node, label) of all nodes that have a link; links may repeat.

    Each round takes the least label among the neighbours, then the label of that label.
    """
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = links.select(F.inline(F.array(F.struct("a", "b"), turned)))
    edges = saved(both.distinct(), "links")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "label"), "b")
        low = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        step = labels.join(low, "node").select("node", F.least("label", "low").alias("new"), "label")
        ahead = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        step = saved(step.join(ahead, "new").select("node", F.least("new", "jump").alias("new"), "label"), "labels")
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("new < label").isEmpty():
            return labels


def union_sketch(one: np.ndarray, many: np.ndarray, how: Nearness) -> np.ndarray:
    """Whether each of ``many`` sketches (rows of sorted values, filled up with the largest) may be near ``one``.

    The k least values of the union show the similarity of the sets: ``least`` of them or more are in both.
    A union of fewer values is all there is of both sets.
    """
    one = one[one < TOP]
    at = np.minimum(np.searchsorted(one, many), len(one) - 1)
    common = (one[at] == many) & (many < TOP)
    union = len(one) + (many < TOP).sum(axis=1) - common.sum(axis=1)
    # Distinct values of both up to each value of the other.
    seen = np.arange(1, many.shape[1] + 1) + np.searchsorted(one, many, side="right") - np.cumsum(common, axis=1)
    shared = (common & (seen <= how.k)).sum(axis=1)
    return np.where(union < how.k, shared * 100 >= how.percent * union, shared >= how.least)


class Block:
    """Nodes of one list: their groups, sketches, and their full sets as inverted lists of local numbers."""

    def __init__(self, rows: pa.Table, how: Nearness):
        self.node, label, self.n = (rows.column(c).to_numpy() for c in ("node", "label", "n"))
        column = rows.column("full").combine_chunks()
        flat, begin = flat_lists(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
        length = np.diff(begin)
        _, self.value = np.unique(flat, return_inverse=True)
        self.begin = begin
        holder = np.repeat(np.arange(len(length)), length)
        order = np.argsort(self.value, kind="stable")
        self.holder = holder[order]
        self.first = np.searchsorted(self.value[order], np.arange(self.value.max(initial=-1) + 2))
        self.sketch = np.full((len(length), how.k), TOP, dtype=np.int64)
        inside = np.arange(how.k) < length[:, None]
        self.sketch[inside] = flat[(begin[:-1, None] + np.arange(how.k))[inside]]
        _, self.group, sizes = np.unique(label, return_inverse=True, return_counts=True)
        self.largest = int(np.argmax(sizes))
        self.how = how

    def common(self, x: int) -> np.ndarray:
        """Size of the intersection of the x-th set with each."""
        own = self.value[self.begin[x] : self.begin[x + 1]]
        many = self.first[own + 1] - self.first[own]
        ends = np.cumsum(many)
        at = np.arange(ends[-1]) + np.repeat(self.first[own] - (ends - many), many)
        return np.bincount(self.holder[at], minlength=len(self.node))

    def links(self) -> tuple[list[int], list[int]]:
        """Confirmed links that join all nodes of the block which any confirmed links join.

        A link joins two groups at once, so that no more links leave the block than it has groups.
        """
        how, n, a, b = self.how, self.n, [], []
        group, largest = self.group.copy(), self.group == self.largest
        for x in np.flatnonzero(~largest):
            # Pairs outside the largest group are met from both sides: the smaller node leads.
            other = (group != group[x]) & (largest | (self.node > self.node[x]))
            y = np.flatnonzero(other & (n * 100 >= n[x] * how.percent) & (n[x] * 100 >= n * how.percent))
            if len(y):
                y = y[union_sketch(self.sketch[x], self.sketch[y], how)]
            if len(y):
                both = self.common(x)[y]
                y = y[100 * both >= how.percent * (n[x] + n[y] - both)]
                joined, first = np.unique(group[y], return_index=True)
                for z in y[first]:
                    a.append(min(self.node[x], self.node[z]))
                    b.append(max(self.node[x], self.node[z]))
                group[np.isin(group, joined)] = group[x]
        return a, b


def cross_links(how: Nearness) -> Callable:
    """Links between different groups of one block, which is held as a whole."""

    def work(parts: Iterator[tuple[bool, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for begins, rows in parts:
            if begins and held:
                yield pairs_of(*Block(pa.Table.from_batches(held), how).links())
                held = []
            held.append(rows)
        if held:
            yield pairs_of(*Block(pa.Table.from_batches(held), how).links())

    return grouped(["hub", "i", "j"], work)


def links_of(nodes: DataFrame, texts: DataFrame, how: Nearness) -> DataFrame:
    """Confirmed links (a, b) that join all nodes which any links join.

    ``nodes``: (node, id, n, k1, k2, sketch), one per set. ``texts``: (id, text) of all documents.
    """
    lists = rarest(nodes, how)
    lists = saved(lists.withColumn("nodes", F.count("*").over(W.partitionBy("value"))).where("nodes > 1"), "lists")
    ahead = lists.groupBy("value").agg(F.min_by(F.struct("node", "n"), "node").alias("first"))
    star = lists.join(ahead, "value").where("node > first.node").withColumn("m", F.col("first.n"))
    star = star.where(near_enough("n", "m", how)).groupBy(F.col("first.node").alias("a"), F.col("node").alias("b"))
    star = star.agg(F.count("*").alias("met"), F.min(F.least("n", "m")).alias("n"))
    star = star.where(F.col("met") >= F.least(F.lit(how.shared), least_shared(F.col("n"), how))).select("a", "b")
    links = saved(confirmed(star, nodes, texts, how), "star")

    labels = connected(links)
    marked = lists.join(labels, "node", "left").select("value", "node", "n", "nodes", F.coalesce("label", "node").alias("label"))
    every = W.partitionBy("value")
    marked = marked.withColumn("low", F.min("label").over(every)).withColumn("high", F.max("label").over(every))
    marked = saved(marked.where("low < high").drop("low", "high"), "mixed")

    short = marked.where(F.col("nodes") <= how.short)
    one, two = short.alias("x"), short.alias("y")
    met = one.join(two, F.expr("x.value = y.value AND x.node < y.node AND x.label <> y.label"))
    met = met.where(near_enough("x.n", "y.n", how)).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    met = met.agg(F.count("*").alias("met"), F.max(F.greatest("x.n", "y.n")).alias("n"))
    met = met.where(F.col("met") >= F.least(F.lit(how.shared), least_shared(F.col("n"), how))).select("a", "b")

    # Long lists of one group come together: the group that most of a list belongs to is its hub, and a node
    # goes to a hub once, however many lists they share.
    long = marked.where(F.col("nodes") > how.short)
    counts = long.groupBy("value", "label").agg(F.count("*").alias("members"))
    hubs = counts.groupBy("value").agg(F.max_by("label", F.struct("members", "label")).alias("hub"))
    gathered = long.join(hubs, "value").select("hub", "node", "n", "label").distinct()
    gathered = gathered.join(nodes.select("node", *NAME), "node")
    # Blocks of so many nodes, or so many values, that two of them fit in memory.
    whole = W.partitionBy("hub")
    nodes_of, values = F.count("*").over(whole), F.sum("n").over(whole)
    gathered = gathered.withColumn("blocks", F.ceil(F.greatest(nodes_of / how.block, values / how.block_values)).cast("int"))
    gathered = gathered.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    gathered = gathered.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("theirs"))
    keys = [F.least("mine", "theirs").alias("i"), F.greatest("mine", "theirs").alias("j")]
    gathered = saved(gathered.select("hub", *keys, "node", *NAME, "n", "label"), "hubs")
    dealt = with_sets(gathered, texts, how).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    cross = arrow(dealt.select("hub", "i", "j", "node", "n", "label", "full"), cross_links(how), "a long, b long")
    return links.union(confirmed(met, nodes, texts, how)).union(cross)


def numbered_sets(read: DataFrame) -> DataFrame:
    """One row (node, id, n, k1, k2, sketch) per set that is not empty; ``id`` is the least that has it.

    The number is given once and written, so that it stands for the set whatever ids share it or have others.
    """
    by_set = read.where("n > 0 AND id IS NOT NULL").groupBy("n", "k1", "k2")
    sets = by_set.agg(F.min("id").alias("id"), F.min_by("sketch", "id").alias("sketch"))
    return saved(sets.withColumn("node", F.monotonically_increasing_id()), "sets")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Columns (n, k1, k2, first) of every set: the name of the set with the least id that links lead to."""
    name = F.struct(*NAME)
    joined = connected(links)
    first = joined.join(nodes.select("node", *NAME), "node").groupBy("label").agg(F.min(name).alias("first"))
    found = joined.join(first, "label").select("node", "first")
    return nodes.join(found, "node", "left").select("n", "k1", "k2", F.coalesce("first", name).alias("first"))


def several_sets(read: DataFrame) -> DataFrame:
    """Ids with texts of different sets, the empty one included."""
    key = F.struct("n", "k1", "k2")
    ids = read.where("id IS NOT NULL").groupBy("id").agg(F.min(key).alias("least"), F.max(key).alias("most"))
    return saved(ids.where("least <> most").select("id"), "several-sets")


def own_links(read: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of one id: from the first to each other one."""
    rows = read.join(several_sets(read), "id").where("n > 0").select("id", "n", "k1", "k2").distinct()
    held = rows.join(nodes.select("node", "n", "k1", "k2"), ["n", "k1", "k2"]).select("id", "node")
    first = held.groupBy("id").agg(F.min("node").alias("a"))
    return held.join(first, "id").where("a < node").select("a", F.col("node").alias("b"))


def sketched(docs: DataFrame, id_column: str, text: str, how: Nearness) -> tuple[DataFrame, DataFrame]:
    """The (id, text) of every row, and its (id, n, k1, k2, sketch)."""
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows, saved(per_text(rows, "text", ["id"], SKETCH, sketches(how.words, how.k)), "sketches")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", how: Nearness = Nearness()
) -> DataFrame:
    """Columns (id, n_shingles, component_id, kept) of every row.

    Null texts and texts without words have an empty set, which is linked with nothing. A row whose id
    is null has no component and is kept. Rows that repeat an id are rows of one document: what is
    linked with one of its texts is linked with the others, an empty one excepted. All rows of the least id
    of a component are kept. Ids must fit a long. An empty table gives no rows, and other columns are not read.
    """
    rows, read = sketched(docs, id_column, text, how)
    same = ["n", "k1", "k2"]
    nodes = numbered_sets(read)
    links = links_of(nodes, rows.where("id IS NOT NULL"), how).union(own_links(read, nodes))
    labels = components(nodes, links).select(*same, F.col("first.id").alias("component_id"))
    full = read.select("id", *same).where("n > 0 AND id IS NOT NULL").join(labels, same)
    bare = read.select("id", *same).where("n = 0 OR id IS NULL").withColumn("component_id", F.col("id"))
    out = full.select("id", "n", "component_id").union(bare.select("id", "n", "component_id"))
    return out.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, id_column: str = "doc_id", text: str = "text", how: Nearness = Nearness()) -> DataFrame:
    """One row of ``docs`` of each group of near texts, all columns: one of the least id in the group.

    Texts decide, not ids: an id with texts of several groups may stay for each of them, and no group is lost. Of
    the rows without words one of each id stays. Rows without an id stay. An empty table gives none.
    """
    rows, read = sketched(docs, id_column, text, how)
    nodes = numbered_sets(read)
    firsts = components(nodes, links_of(nodes, rows.where("id IS NOT NULL"), how)).select("first.*").distinct()
    bare = read.where("n = 0 AND id IS NOT NULL").select(*NAME).distinct()
    names = {"id": "kept id", "k1": "kept k1", "k2": "kept k2"}
    kept = saved(firsts.union(bare).withColumnsRenamed(names), "firsts")
    same = F.col(f"`{id_column}`").cast("long") == F.col("`kept id`")
    mixed = several_sets(read).withColumnRenamed("id", "kept id")
    # An id of one set needs no second look at its texts.
    plain = docs.join(kept, same, "left_semi").join(mixed, same, "left_anti").dropDuplicates([id_column])
    digests = T.StructType([T.StructField(f"kept {f.name}", f.dataType) for f in SET.fields])
    doubtful = docs.join(mixed, same, "left_semi")
    doubtful = per_text(doubtful.withColumn("kept text", F.col(f"`{text}`")), "kept text", docs.columns, digests, full_sets(how.words))
    doubtful = doubtful.withColumn("kept id", F.col(f"`{id_column}`").cast("long")).join(kept, list(names.values()), "left_semi")
    doubtful = doubtful.dropDuplicates(list(names.values())).select(*[F.col(f"`{c}`") for c in docs.columns])
    return plain.union(doubtful).union(docs.where(F.col(f"`{id_column}`").isNull()))
