"""URL filters: rules by host and path, and a Bloom filter cascade for exact membership of hosts."""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import arrow, saved

MAX_LEVELS = 64
# Filters beyond this are not sent to the executors; the keys are joined instead.
MAX_FILTER_BYTES = 32 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


@dataclass(frozen=True)
class Rule:
    """Verdict for a host with its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, both null if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        name = F.when(rule.fits(host, path), F.lit(rule.name)).otherwise(name)
        verdict = F.when(rule.fits(host, path), F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Bloom:
    """One level: ``bits`` positions, ``hashes`` of them per key, drawn anew on each level."""

    level: int
    bits: int
    hashes: int
    words: np.ndarray | None = None

    def positions(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Row i: the i-th position of each key, from its two 64-bit hashes."""
        one = mixed(one.view(np.uint64) + np.uint64((self.level * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        two = mixed(two.view(np.uint64) ^ one) | np.uint64(1)
        steps = np.arange(self.hashes, dtype=np.uint64)[:, None]
        return (one + steps * two) % np.uint64(self.bits)

    def holds(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        at = self.positions(one, two)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def sized(level: int, keys: int, others: int) -> Bloom:
    """A filter for ``keys`` that few of the ``others`` pass: so few on the first level that the rest stays small."""
    wrong = min(0.5, keys * 0.5**0.5 / max(others, 1)) if level == 0 else 0.5
    hashes = max(1, round(-np.log2(wrong)))
    return Bloom(level, max(64, int(np.ceil(keys * hashes / np.log(2)))), hashes)


def hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))


def filled(keys: DataFrame, plan: Bloom) -> Bloom:
    """The filter with the bits of all keys. Each task joins its own bits first; the driver gets the words."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = plan.positions(*hashes(batch)).ravel()
            word, which = np.unique(at >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(word), dtype=np.uint64)
            np.bitwise_or.at(value, which, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "bits"]
            )

    found = arrow(keys.select("h1", "h2"), bits, "word long, bits long")
    rows = found.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(plan.bits // 64 + 1, dtype=np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return Bloom(plan.level, plan.bits, plan.hashes, words.view(np.uint64))


def passing(keys: DataFrame, bloom: Bloom) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.holds(*hashes(batch))))

    return arrow(keys, run, keys.schema)


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")]


def cascade(universe: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> tuple[Bloom, ...] | None:
    """Levels for a universe of distinct keys (key, listed); None if they would exceed ``max_bytes``.

    Level 0 encodes the listed keys, level 1 the others that pass it, level 2 the listed keys that
    pass level 1, and so on until none pass.
    """
    rows = saved(universe.select("listed", *hashed(F.col("key"))), "keys")
    sides = [rows.where("listed"), rows.where("NOT listed")]
    counts = [side.count() for side in sides]
    levels: list[Bloom] = []
    while counts[0]:
        if len(levels) == MAX_LEVELS:
            raise ValueError("two keys of the universe have equal hashes")
        plan = sized(len(levels), *counts)
        if sum(level.bits for level in [*levels, plan]) > 8 * max_bytes:
            return None
        levels.append(filled(sides[0], plan))
        # Those that pass are the next level's keys; the keys just encoded are then the others.
        sides = [saved(passing(sides[1], levels[-1]), "keys"), sides[0]]
        counts = [sides[0].count(), counts[0]]
    return tuple(levels)


def listed(levels: Sequence[Bloom], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Membership of keys of the universe: decided by the first level that does not hold the key."""
    out = np.full(len(one), len(levels) % 2 == 1)
    rest = np.arange(len(one))
    for level in levels:
        holds = level.holds(one[rest], two[rest])
        out[rest[~holds]] = level.level % 2 == 1
        rest = rest[holds]
    return out


def url_filter(
    pages: DataFrame,
    blocked: DataFrame,
    rules: Sequence[Rule] = (),
    id_column: str = "page_id",
    url: str = "url",
    max_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """Columns (id, host, path, rule, verdict) of every page.

    The longest rule that fits decides; else a host is blocked if it is in ``blocked`` (one column of
    hosts). The filters are built over all hosts of ``pages``, so that they make no mistake for
    these. They are sent to the executors; lists that would need more than ``max_bytes`` are joined
    instead, with the same result. Null urls and urls without ``://`` have an empty host, which is
    allowed unless listed. Null and repeated rows of ``blocked`` do not matter, repeated pages each
    give a row, a null id stays null, and an empty table gives no rows.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{id_column}`").alias(id_column), host.alias("host"), path.alias("path"))
    listing = blocked.select(F.col(blocked.columns[0]).alias("key")).where("key IS NOT NULL").distinct()
    hosts = pages.select(host.alias("key")).distinct()
    universe = hosts.join(listing.withColumn("listed", F.lit(True)), "key", "left").select(
        "key", F.coalesce("listed", F.lit(False)).alias("listed")
    )
    levels = cascade(universe, max_bytes)
    if levels is None:
        marked = rows.join(listing.select(F.col("key").alias("host"), F.lit(True).alias("in_list")), "host", "left")
    else:
        marked = rows.select("*", *hashed(F.col("host")))
        sent = pages.sparkSession.sparkContext.broadcast(levels)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(listed(sent.value, *hashes(batch)))],
                    names=[*batch.schema.names[:3], "in_list"],
                )

        fields = rows.schema.fields
        marked = arrow(marked, run, type(rows.schema)(fields).add("in_list", "boolean"))
    name, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    method = F.when(F.coalesce("in_list", F.lit(False)), F.lit("block")).otherwise("allow")
    return marked.select(
        f"`{id_column}`", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict")
    )
