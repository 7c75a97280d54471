"""Phrase collocations against a plain count; filters against dictionaries."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.dataset as ds
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import phrases

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, word string, phrase string, n long"


def plain(rows, least=10, cover=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score), straight from the definition."""
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            longer = [q for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(2))]
            if any(100 * found[q] >= cover * a for q in longer):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def got(df):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert df.columns == names
    return sorted(tuple(r) for r in df.collect())


ODD = [
    (None, "en"), ("", None), (" \t ", "en"), ("one two three. ONE Two three! one two\tthree\none two three" * 5, None),
    ("a b " * 300, "en"), ("ä Ä ß 漢 字 " * 20, "de"), ("x\x00y z\x00 " * 15, "de"), ("\x1c\x85  w " * 12, "fr"),
    ("same same same same " * 30, "fr"), ("word" * 5_000, "en"), (" ".join(f"w{i % 7}" for i in range(40_000)), "long"),
    ("no.words,here;or:there!and?so\rit\x0bgoes\x0con " * 12, "en"), ("tie a tie b tie c " * 10, ""),
]


@pytest.mark.parametrize(
    "how, id_bits",
    [
        (phrases.Mining(), 2),
        (phrases.Mining(least=2, top=5, block_bytes=300, open_bytes=500, filter_keys=100, range_keys=40, fan_bits=2), 2),
        (phrases.Mining(block_bytes=2_000, filter_keys=500, range_keys=100, fan_bits=1), 33),
        (phrases.Mining(block_bytes=2_000, filter_keys=500, range_keys=100), 42),
    ],
)
def test_odd_texts(spark, how, id_bits):
    rows = ODD + ODD[3:6]
    df = spark.createDataFrame([(i, t, lang, "w", "p", 1) for i, (t, lang) in enumerate(rows)], SCHEMA)
    made = phrases.collocations(df.repartition(3), how=how, id_bits=id_bits)
    assert got(made) == plain(rows, how.least, how.cover_percent, how.top)
    assert all(t == "bigint" for name, t in made.dtypes if name not in ("lang", "phrase"))


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert got(phrases.collocations(df)) == []
    assert got(phrases.collocations(spark.createDataFrame([(1, None, None, "", "", 1)], SCHEMA))) == []


def test_test_table_against_definition(spark):
    from tidemark.llm.queries import QUERIES

    rows = duckdb.connect().execute(f"SELECT text, lang FROM '{SF}/documents.parquet'").fetchall()
    assert got(QUERIES["op13_phrases"](spark, SF)) == plain(rows)


@settings(max_examples=40, deadline=None)
@given(
    st.integers(2, 42),
    st.lists(st.tuples(st.integers(0, 1 << 42), st.integers(0, 1 << 42), st.integers(0, 1 << 42), st.integers(1, 10**12)), max_size=80),
    st.integers(0, 6),
)
def test_filters_lose_nothing(id_bits, entries, range_bits):
    bits = phrases.half_width(id_bits)
    range_bits = min(range_bits, bits)
    want = Counter()
    for *key, n in entries:
        want[tuple(k & ((1 << id_bits) - 1) for k in key)] += n
    parts = []
    for *key, n in entries:
        columns = [np.array([k & ((1 << id_bits) - 1)], dtype=np.uint64) for k in key]
        parts.append(phrases.Counts(*phrases.permuted(*phrases.packed(columns, id_bits), bits), np.array([n])))
    made = list(phrases.filters(phrases.merged(parts), bits, range_bits))
    assert [f.range for f in made] == sorted({f.range for f in made})
    whole = phrases.merged([phrases.opened(f, bits, range_bits) for f in made])
    words = phrases.unpacked(*phrases.restored(whole.high, whole.low, bits), id_bits)
    assert Counter(dict(zip(zip(*(w.tolist() for w in words)), whole.counts.tolist()))) == want


def test_filters_are_compact():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 200_000, dtype=np.uint64))
    high, low = phrases.permuted(keys >> np.uint64(24), keys & np.uint64((1 << 24) - 1), 24)
    found = phrases.merged([phrases.Counts(high, low, np.ones(len(keys), dtype=np.int64))])
    size = sum(len(f.runs) + len(f.remainders) + len(f.small) + len(f.large) for f in phrases.filters(found, 24, 3))
    assert size < 6 * len(keys)  # a key and a count as they are take 16 bytes


@pytest.mark.parametrize("id_bits", [18, 30])
def test_merging_holds_little_more_than_the_keys(id_bits):
    """Bytes at most, a key that comes in: 24 for the key itself, and what merging holds beside."""
    rng = np.random.default_rng(2)
    bits = phrases.half_width(id_bits)

    def part():
        high, low = rng.integers(0, 1 << bits, (2, 250_000), dtype=np.uint64)
        order = np.lexsort((low, high))
        return phrases.Counts(high[order], low[order], np.ones(len(high), dtype=np.int64))

    tracemalloc.start()
    try:
        parts = [part() for _ in range(4)]
        tracemalloc.reset_peak()
        # As a task does: the filters are made a few at a time from the merged keys.
        n = sum(b.column("keys").to_numpy().sum() for b in phrases.as_rows(phrases.merged(parts, bits), bits, 12))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 1_000_000 and peak <= 62 * n


def test_keys_of_a_block_hold_little():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 18, 500_000, dtype=np.uint64)
    words[rng.random(len(words)) < 0.2] = 0
    tracemalloc.start()
    try:
        made = phrases.phrase_keys(words, 18)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    n = sum(made.counts)
    w = words.tolist()
    want = Counter((0, *p) for p in zip(w, w[1:]) if all(p)) + Counter(p for p in zip(w, w[1:], w[2:]) if all(p))
    columns = phrases.unpacked(*phrases.restored(made.high, made.low, phrases.half_width(18)), 18)
    assert Counter(dict(zip(zip(*(c.tolist() for c in columns)), made.counts.tolist()))) == want
    assert n == sum(want.values()) and peak <= 64 * n


def test_blocks_are_read_a_few_at_a_time(spark, monkeypatch):
    """A row of a block has megabytes; readers hold a row group, and a page twice."""
    kept, write = {}, phrases.saved

    def saved(df, name, **how):
        kept[name] = write(df, name, **how)
        return kept[name]

    monkeypatch.setattr(phrases, "saved", saved)
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(3_000)}" for _ in range(700_000))
    df = spark.createDataFrame([(i, text, "en", "w", "p", 1) for i in range(9)], SCHEMA).coalesce(1)
    made = phrases.collocations(df, how=phrases.Mining(block_bytes=3 << 20))
    n = 9 * len(text.split())
    assert made.agg({"n": "max"}).first()[0] == n and kept["blocks"].agg({"n_words": "sum"}).first()[0] == n
    files = [f for path in kept["blocks"].inputFiles() for f in ds.dataset(path.removeprefix("file:")).get_fragments()]
    sizes = [g.total_byte_size for f in files for g in f.row_groups]
    assert sum(sizes) > 20 << 20 and max(sizes) < 12 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b"  # the session has its own again
