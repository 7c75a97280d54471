"""Phrase collocations by exact counts in counting quotient filters.

Texts are read once into blocks of word numbers. Words that are frequent enough get small global numbers; two or three
of these, packed, are the key of a phrase. A key goes through an invertible permutation and splits into a quotient, the
slot, and the whole remainder, so that a filter holds exact counts of exact keys in little more space than the
remainders. Filters of blocks are sorted, cut by ranges of slots, and merged range by range over all blocks. Keys of
frequent phrases are permuted back to word numbers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import batched, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.texts import arrow, saved, utf8
from tidemark.session import session_settings

# A-Z are lower-cased, these end a piece; words of a piece are parted by spaces and tabs.
ENDS = b".,;:!?\n\x0b\x0c\r"
CUT = 0xFF  # never a byte of UTF-8
# Blocks and filters are large rows, of which each task holds a batch, in the JVM and in Python.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
TABLE = bytes(CUT if b in ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Mining(NamedTuple):
    """``least``: a candidate's occurrences; ``cover_percent``: share of a phrase's occurrences inside a longer one
    that drops it; ``top``: phrases per language. The rest bounds memory: bytes of a block of texts and of all open
    blocks of a task, keys of a filter, keys of a merged range."""

    least: int = 10
    cover_percent: int = 50
    top: int = 2_000
    block_bytes: int = 4 << 20
    open_bytes: int = 32 << 20
    filter_keys: int = 2 << 20
    range_keys: int = 1 << 20
    fan_bits: int = 12


# Keys


def half_width(id_bits: int) -> int:
    """Bits of each half of a key, which is three word numbers wide."""
    return (3 * id_bits + 1) // 2


ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray, salt: int, bits: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (x ^ (x >> np.uint64(29))) & np.uint64((1 << bits) - 1)


def permuted(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of pairs of numbers of that many bits each: a Feistel network, so :func:`restored` undoes it."""
    for salt in ROUNDS:
        high, low = low, high ^ _mixed(low, salt, bits)
    return high, low


def restored(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    for salt in reversed(ROUNDS):
        high, low = low ^ _mixed(high, salt, bits), high
    return high, low


def packed(words: Sequence[np.ndarray], id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves of the keys of three columns of word numbers; a phrase of two words has 0 as its first."""
    a, b, c = (np.asarray(w, dtype=np.uint64) for w in words)
    bits = half_width(id_bits)
    one, half = np.uint64(id_bits), np.uint64(bits)
    # b lies across the halves: its upper bits end the high one, its lower bits start the low one.
    below = np.uint64(bits - id_bits)
    low = (c | (b << one)) & ((np.uint64(1) << half) - np.uint64(1))
    return (a << np.uint64(2 * id_bits - bits)) | (b >> below), low


def unpacked(high: np.ndarray, low: np.ndarray, id_bits: int) -> list[np.ndarray]:
    bits = half_width(id_bits)
    mask, below = np.uint64((1 << id_bits) - 1), bits - id_bits
    b = ((high << np.uint64(below)) | (low >> np.uint64(id_bits))) & mask
    return [high >> np.uint64(2 * id_bits - bits), b, low & mask]


# Filters


class Counts(NamedTuple):
    """Permuted keys in order, without repeats, and their counts."""

    high: np.ndarray
    low: np.ndarray
    counts: np.ndarray


def joined(parts: Sequence[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([*parts, np.zeros(0, dtype=kind)])


def summed(columns: Sequence[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted columns without repeats; counts of equal rows are added."""
    first = np.ones(len(counts), dtype=bool)
    first[1:] = columns[0][1:] != columns[0][:-1]
    for column in columns[1:]:
        first[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(first)
    return [c[starts] for c in columns], np.add.reduceat(counts, starts) if len(starts) else counts


def split_keys(whole: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return whole >> np.uint64(bits), whole & np.uint64((1 << bits) - 1)


def merged(parts: list[Counts], bits: int = 64) -> Counts:
    """One run of keys out of several; counts of equal keys are added. The list is emptied on the way, and columns
    are put in order one at a time, so that little more than the parts is held. Halves that fit 64 bits together
    are sorted as one number."""
    if 2 * bits <= 64:
        n = at = sum(len(p.low) for p in parts)
        whole, counts = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.int64)
        while parts:  # each part goes as soon as it is copied
            high, low, of_part = parts.pop()
            here, at = slice(at - len(low), at), at - len(low)
            np.left_shift(high, np.uint64(bits), out=whole[here])
            whole[here] |= low
            counts[here] = of_part
        high = low = of_part = None
        order = np.argsort(whole, kind="stable")
        whole = whole[order]
        counts = counts[order]
        del order
        (whole,), counts = summed([whole], counts)
        return Counts(*split_keys(whole, bits), counts)
    high, low = joined([p.high for p in parts], np.uint64), joined([p.low for p in parts], np.uint64)
    counts = joined([p.counts for p in parts], np.int64)
    parts.clear()
    order = np.lexsort((low, high))
    high = high[order]
    low = low[order]
    counts = counts[order]
    del order
    (high, low), counts = summed([high, low], counts)
    return Counts(high, low, counts)


SLICE = 1 << 16


def phrase_keys(words: np.ndarray, id_bits: int) -> Counts:
    """Permuted keys of the phrases of two and three words in a run of word numbers, where 0 parts phrases. They are
    made a slice at a time, so that only the keys are held for the whole run."""
    bits = half_width(id_bits)
    two = (words[:-1] > 0) & (words[1:] > 0)
    three = two[:-1] & two[1:]
    n, one_number = np.count_nonzero(two) + np.count_nonzero(three), 2 * bits <= 64
    halves = [np.empty(n, dtype=np.uint64) for _ in range(1 if one_number else 2)]
    at = 0
    for start in range(0, len(two), SLICE):
        pair = start + np.flatnonzero(two[start : start + SLICE])
        triple = start + np.flatnonzero(three[start : start + SLICE])
        a = np.concatenate([np.zeros(len(pair), dtype=np.uint64), words[triple]])
        b = np.concatenate([words[pair], words[triple + 1]])
        c = np.concatenate([words[pair + 1], words[triple + 2]])
        high, low = permuted(*packed((a, b, c), id_bits), bits)
        for half, made in zip(halves, [(high << np.uint64(bits)) | low] if one_number else [high, low]):
            half[at : at + len(made)] = made
        at += len(high)
    if not one_number:
        return merged([Counts(*halves, np.ones(n, dtype=np.int64))], bits)
    whole, half = halves.pop(), None
    whole.sort()
    first = np.ones(n, dtype=bool)
    first[1:] = whole[1:] != whole[:-1]
    starts = np.flatnonzero(first)
    whole, counts = whole[starts], np.diff(starts, append=n)
    del first, starts
    return Counts(*split_keys(whole, bits), counts)


def bytes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of that many bits as rows of as few bytes."""
    size = -(-bits // 8)
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :]


def values_of(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), 8), dtype=np.uint8)
    wide[:, 8 - rows.shape[1] :] = rows
    return wide.view(">u8").ravel().astype(np.uint64)


class Filter(NamedTuple):
    """Counting quotient filter over the slots of one range: ``runs`` has a 1 for each key and a 0 for the end of
    each slot, ``remainders`` the rest of each key in as many bytes as it needs, ``small`` its count in a byte, where
    255 stands for the next of ``large``."""

    range: int
    slot_bits: int
    runs: bytes
    remainders: bytes
    small: bytes
    large: bytes


FILTER = "range long, slot_bits int, keys long, runs binary, remainders binary, small binary, large binary"


def filters(found: Counts, bits: int, range_bits: int) -> Iterator[Filter]:
    """Sorted keys as filters, one for each range (the first bits of the permuted key) that has keys."""
    ranges = (found.high >> np.uint64(bits - range_bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(ranges, prepend=-1))
    for start, stop in zip(starts, [*starts[1:], len(ranges)]):
        high, low, counts = (c[start:stop] for c in found)
        # About one key a slot, out of the bits of the high half that the range leaves.
        slot_bits = max(0, min(int(stop - start).bit_length() - 1, bits - range_bits))
        rest = bits - range_bits - slot_bits
        slots = ((high >> np.uint64(rest)) & np.uint64((1 << slot_bits) - 1)).astype(np.int64)
        runs = np.zeros((1 << slot_bits) + len(slots), dtype=np.uint8)
        runs[slots + np.arange(len(slots))] = 1
        remainders = np.hstack([bytes_of(high & np.uint64((1 << rest) - 1), rest), bytes_of(low, bits)])
        small = np.minimum(counts, 255).astype(np.uint8)
        yield Filter(
            int(ranges[start]),
            slot_bits,
            np.packbits(runs).tobytes(),
            remainders.tobytes(),
            small.tobytes(),
            counts[small == 255].astype("<i8").tobytes(),
        )


def opened(f: Filter, bits: int, range_bits: int) -> Counts:
    """The sorted keys and counts of a filter; nothing is lost."""
    counts = np.frombuffer(f.small, np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(f.large, "<i8")
    n, rest = len(counts), bits - range_bits - f.slot_bits
    runs = np.unpackbits(np.frombuffer(f.runs, np.uint8), count=n + (1 << f.slot_bits))
    slots = (np.flatnonzero(runs) - np.arange(n)).astype(np.uint64)
    rows = np.frombuffer(f.remainders, np.uint8).reshape(n, -(-rest // 8) + -(-bits // 8))
    high, low = values_of(rows[:, : -(-rest // 8)]), values_of(rows[:, -(-rest // 8) :])
    top = (np.uint64(f.range) << np.uint64(f.slot_bits)) | slots
    return Counts((top << np.uint64(rest)) | high, low, counts)


# Passes


BLOCK = "block long, lang string, n_words long, words array<string>, counts array<long>, codes binary"


def blocks_of_words(docs: DataFrame, text: str, lang: str, how: Mining) -> DataFrame:
    """Texts of one language each as blocks: the distinct words with their counts, and the texts as numbers of these
    words from 1, in 32 bits, with 0 between pieces. No order of texts matters and no phrase reaches over a piece."""
    rows = docs.select(
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang")
    )

    def cut(raw: bytes) -> Iterator[bytes]:
        """A long text in parts of about a block, cut between pieces."""
        at = 0
        while len(raw) - at > how.block_bytes:
            end = raw.rfind(CUT, at, at + how.block_bytes)
            end = raw.find(CUT, at + how.block_bytes) if end <= at else end
            if end < 0:
                break
            yield raw[at:end]
            at = end
        yield raw[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, numbers = TaskContext.get().partitionId(), count()
        held: dict[str, list[bytes]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)

        def block(name: str) -> pa.RecordBatch:
            raw = bytes([CUT]).join(held.pop(name))
            sizes.pop(name)
            tokens = raw.replace(bytes([CUT]), b" \xff ").split()
            seen = defaultdict(count(1).__next__, {b"\xff": 0})
            codes = np.fromiter(map(seen.__getitem__, tokens), dtype="<i4", count=len(tokens))
            counts = np.bincount(codes, minlength=len(seen))[1:]
            words = pa.array([w.decode() for w in seen if w != b"\xff"], pa.string())
            values = ([(task << 32) + next(numbers)], [name], [int(counts.sum())], [words], [counts], [codes.tobytes()])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds)], names=[f.split()[0] for f in BLOCK.split(", ")]
            )

        for batch in batches:
            for raw, name in zip(utf8(batch.columns[0]), batch.columns[1].to_pylist()):
                for part in cut(raw.translate(TABLE)):
                    held[name].append(part)
                    sizes[name] += len(part) + 1
                    if sizes[name] >= how.block_bytes:
                        yield block(name)
                while sum(sizes.values()) > how.open_bytes:
                    yield block(max(sizes, key=sizes.__getitem__))
        for name in list(held):
            yield block(name)

    return arrow(rows, run, BLOCK)


def numbered_words(blocks: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id) of the words with enough occurrences; ids are from 1, small and without repeats."""
    counted = blocks.select("lang", F.inline(F.arrays_zip("words", "counts")))
    counted = counted.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f"))
    row = F.monotonically_increasing_id()
    places = counted.where(F.col("f") >= least).select(
        "*", F.shiftright(row, 33).alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")
    )
    # Row numbers of a task hold for what that task wrote, so they are used only once written.
    kept = saved(places, "words")
    parts = (kept.agg(F.max("part")).first()[0] or 0) + 1
    return kept.select("lang", "word", "f", (F.col("row") * parts + F.col("part") + 1).alias("id"))


NAMES = [f.split()[0] for f in FILTER.split(", ")]
KINDS = [pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * 4
Rows = Iterator[pa.RecordBatch]


def as_rows(found: Counts, bits: int, range_bits: int) -> Rows:
    for made in batched(filters(found, bits, range_bits), 64):
        rows = [(f.range, f.slot_bits, len(f.small), *f[2:]) for f in made]
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), KINDS)]
        yield pa.RecordBatch.from_arrays(columns, names=NAMES)


def from_rows(batch: pa.RecordBatch, bits: int, range_bits: int) -> Iterator[tuple[int, Counts]]:
    for i in range(batch.num_rows):
        row = batch.slice(i, 1).to_pylist()[0]
        f = Filter(row["range"], row["slot_bits"], *(row[n] for n in NAMES[3:]))
        yield f.range, opened(f, bits, range_bits)


def phrase_counts(blocks: DataFrame, words: DataFrame, how: Mining, id_bits: int, range_bits: int) -> DataFrame:
    """(a, b, c, f): word numbers of the phrases with enough occurrences, with a = 0 for those of two words."""
    bits = half_width(id_bits)
    local = blocks.select("block", "lang", F.posexplode("words").alias("at", "word"))
    known = local.join(words.hint("merge"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("ids"))
    coded = blocks.select("block", F.size("words").alias("size"), "codes").join(known, "block")
    coded = coded.select("size", "codes", F.col("ids.at").alias("at"), F.col("ids.id").alias("id"))
    cuts = [*range(how.fan_bits, range_bits, how.fan_bits), range_bits]

    def build(batches: Rows) -> Rows:
        """Filters of the blocks of a task; those of several blocks are merged up to a bound."""
        held: list[Counts] = []
        for batch in batches:
            for i in range(batch.num_rows):
                size, codes, at, ids = (column[i] for column in batch.columns)
                lookup = np.zeros(size.as_py() + 1, dtype=np.uint64)
                lookup[at.values.to_numpy(zero_copy_only=False) + 1] = ids.values.to_numpy(zero_copy_only=False)
                held.append(phrase_keys(lookup[np.frombuffer(codes.as_buffer(), "<i4")], id_bits))
                if sum(len(c.low) for c in held) > how.filter_keys:
                    yield from as_rows(merged(held, bits), bits, cuts[0])
        if held:
            yield from as_rows(merged(held, bits), bits, cuts[0])

    def finer(coarse: int, fine: int) -> Callable[[Rows], Rows]:
        def run(batches: Rows) -> Rows:
            """Filters of a range merged up to a bound and cut into narrower ranges."""
            held: dict[int, list[Counts]] = defaultdict(list)
            sizes: dict[int, int] = defaultdict(int)
            for batch in batches:
                for place, found in from_rows(batch, bits, coarse):
                    held[place].append(found)
                    sizes[place] += len(found.low)
                    if sum(sizes.values()) > how.filter_keys:
                        most = max(sizes, key=sizes.__getitem__)
                        sizes.pop(most)
                        yield from as_rows(merged(held.pop(most), bits), bits, fine)
            for place in list(held):
                yield from as_rows(merged(held.pop(place), bits), bits, fine)

        return run

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [merged([])]
        for batch in batches:
            for _, found in from_rows(batch, bits, range_bits):
                held.append(found)
                if sum(len(c.low) for c in held[1:]) > max(how.range_keys // 2, len(held[0].low)):
                    held.append(merged(held, bits))
        run = merged(held, bits)
        often = run.counts >= how.least
        high, low = restored(run.high[often], run.low[often], bits)
        columns = [*(w.astype(np.int64) for w in unpacked(high, low, id_bits)), run.counts[often]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "c", "f"])

    made = arrow(coded, build, FILTER)
    for coarse, fine in zip(cuts, cuts[1:]):
        made = arrow(made.repartition("range"), finer(coarse, fine), FILTER)
    return made.groupBy("range").applyInArrow(merge, "a long, b long, c long, f long")


def scored(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact in decimals of 38 digits."""
    whole = [c.cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", whole[0] * whole[0] * F.lit(1_000_000).cast("decimal(7,0)"), whole[1] * whole[2])


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", how: Mining = Mining(), id_bits: int = 2
) -> DataFrame:
    """Best phrases of two and three words per language: (lang, rank, phrase, a, l, r, n, score).

    Null texts are empty, null languages ``und``; repeated rows count each time; other columns are not read; an empty
    table gives no rows. ``id_bits`` is the least width of a word number; more words make it wider. Up to 2^42
    frequent words fit a key.
    """
    spark = docs.sparkSession
    with session_settings(spark, BATCHES):
        made = saved(blocks_of_words(docs, text, lang, how), "blocks", large_rows=True)
    words = numbered_words(made, how.least)
    top_id, total = words.agg(F.max("id")).first()[0] or 0, made.agg(F.sum("n_words")).first()[0] or 0
    id_bits = max(id_bits, top_id.bit_length(), 2)
    if id_bits > 42:
        raise ValueError(f"{top_id} word numbers do not fit three to a key")
    # Every word starts at most two phrases, so this bounds the keys of a range, of which each block has one at most.
    range_bits = min(max(0, (2 * total // how.range_keys)).bit_length(), half_width(id_bits))
    with session_settings(spark, BATCHES):
        phrases = saved(phrase_counts(made, words, how, id_bits, range_bits), "phrases")

    def named(column: str, rows: DataFrame) -> DataFrame:
        names = words.select(
            F.col("id").alias(column), F.col("word").alias(f"word_{column}"), F.col("f").alias(f"f_{column}"), "lang"
        )
        return rows.join((names.drop("lang") if "lang" in rows.columns else names).hint("merge"), column)

    pairs = phrases.where("a = 0").select("b", "c", "f")
    triples = phrases.where("a > 0")
    covers = triples.select(F.inline(F.array(F.struct("a", "b", "f"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), "f"))))
    covers = covers.groupBy(F.col("a").alias("b"), F.col("b").alias("c")).agg(F.max("f").alias("longer"))
    kept = pairs.join(covers, ["b", "c"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < how.cover_percent * F.col("f"))
    )
    two = named("c", named("b", kept)).select(
        "lang",
        F.concat_ws(" ", "word_b", "word_c").alias("phrase"),
        F.col("f").alias("a"),
        F.col("f_b").alias("l"),
        F.col("f_c").alias("r"),
        scored(F.col("f"), F.col("f_b"), F.col("f_c")).alias("score"),
    )
    front = pairs.select(F.col("b").alias("a"), F.col("c").alias("b"), F.col("f").alias("f_ab"))
    back = pairs.select("b", "c", F.col("f").alias("f_bc"))
    three = triples.join(front, ["a", "b"]).join(back, ["b", "c"])
    three = named("c", named("b", named("a", three)))
    first, second = scored(F.col("f"), F.col("f_a"), F.col("f_bc")), scored(F.col("f"), F.col("f_ab"), F.col("f_c"))
    three = three.select("*", first.alias("s_1"), second.alias("s_2")).select(
        "lang",
        F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"),
        F.col("f").alias("a"),
        F.when(F.col("s_1") <= F.col("s_2"), F.col("f_a")).otherwise(F.col("f_ab")).alias("l"),
        F.when(F.col("s_1") <= F.col("s_2"), F.col("f_bc")).otherwise(F.col("f_c")).alias("r"),
        F.least("s_1", "s_2").alias("score"),
    )
    found = two.unionByName(three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The best of a language are among the best of each of its parts, so that no task sorts a whole language.
    for keys in (["lang", "salt"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("rank", place).where(F.col("rank") <= how.top)
    sizes = made.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return found.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
