"""Operators on whole tables, against brute force; the pipeline and its stages."""

from __future__ import annotations

import math
from collections import defaultdict
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import connect, difference
from tidemark.llm import mixing, near, urls, vectors
from tidemark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, n string"


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    assert difference(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) is None


def docs(spark, rows):
    """(id, text, source) with further columns, some named like those that operators make."""
    return spark.createDataFrame([(i, t, None, s, None, "s", "k", "n") for i, t, s in rows], DOCS)


# Mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
            left -= target[s] if full else 0
        open_ = open_ - full if full else set()
    return target


def test_mix(spark):
    rows = QUERIES["op4_source_mix"](spark, SF).collect()
    tables = spark.read.parquet(f"{SF}/documents.parquet").collect()
    source = {r.doc_id: r.source for r in tables}
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len(next(t.text for t in tables if t.doc_id == r.doc_id).encode().split())
        assert 0 <= r.taken <= 2 * r.size
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    target = plain_targets(size)
    for r in rows:
        assert r.source_size == size[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]])
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    again = QUERIES["op4_source_mix"](spark, SF).collect()
    assert sorted(rows) == sorted(again)


def test_mix_pieces_are_the_taken_words(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    mix = mixing.mix_sources(table, plan=mixing.Plan(shard_blocks=16))
    pieces = mix.pieces.collect()
    taken, runs = defaultdict(int), defaultdict(list)
    for p in pieces:
        taken[p.id] += p.n_words
        runs[p.id, p.turn].append((p.from_word, p.from_word + p.n_words))
    assert {r.doc_id: r.taken for r in mix.documents.collect() if r.taken} == dict(taken)
    for found in runs.values():
        assert all(a[1] <= b[0] for a, b in zip(sorted(found), sorted(found)[1:], strict=False))
    by_shard = defaultdict(list)
    for p in pieces:
        by_shard[p.shard].append(p)
    words = [sum(p.n_words for p in shard) for shard in by_shard.values()]
    # Shards have equal numbers of blocks but for one; the last block of a source is shorter.
    assert len(by_shard) > 8 and max(words) - min(words) <= 0.25 * max(words)
    assert all(sorted(p.position for p in s) == list(range(1, len(s) + 1)) for s in by_shard.values())


def test_hypergeometric_split(spark):
    quotas = [30, 0, 7, 13]
    one = spark.range(2000).select("id", mixing.split(F.array(*[F.lit(q).cast("long") for q in quotas]), F.col("id"), 1).alias("x"))
    rows = [r.x for r in one.collect()]
    assert all(sum(x) == 25 and all(0 <= a <= q for a, q in zip(x, quotas, strict=True)) for x in rows)
    n = sum(quotas)
    for k, q in enumerate(quotas):
        mean = sum(x[k] for x in rows) / len(rows)
        spread = sum((x[k] - mean) ** 2 for x in rows) / len(rows)
        assert mean == pytest.approx(q / 2, abs=0.15)
        assert spread == pytest.approx(q / 4 * (n - q) / (n - 1), rel=0.15, abs=0.05)


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x y z", None), (3, "x y z", None), (None, "w " * 40_000, "b"), (5, "one", "é")]
    table = docs(spark, rows)
    found = mixing.mix_sources(table).documents.collect()
    assert len(found) == len(rows) and all(r.taken <= 2 * r.size for r in found)
    assert sum(r.taken for r in found) == pytest.approx(1.5 * 40_007, abs=4)
    kept = mixing.repeated(table)
    assert kept.columns == table.columns and kept.filter("text IS NULL OR text = ''").count() == 0
    assert mixing.mix_sources(table.limit(0)).documents.collect() == []
    assert mixing.repeated(table.limit(0)).collect() == []


@pytest.mark.parametrize("words", [100, 6000])
def test_repeated_documents_meet_the_targets(spark, words):
    n = 240_000 // words
    table = docs(spark, [(i * 3 + k, f"w{i} " * words, s) for i in range(n) for k, s in enumerate("abc")])
    found, target = defaultdict(int), plain_targets(dict.fromkeys("abc", n * words))
    for r in mixing.repeated(table).collect():
        found[r.source] += words
    assert all(abs(found[s] - target[s]) <= words / 2 + 1 for s in "abc"), (found, target)


def test_repeated_documents_come_as_the_tree_deals_them(spark, monkeypatch):
    plan = mixing.Plan(block_words=64, shard_blocks=8)
    table = spark.read.parquet(f"{SF}/documents.parquet")
    found = mixing.repeated(table, plan=plan).collect()
    keyed = table.select("doc_id", *mixing.numbers("doc_id", "text", "source"), F.xxhash64("text").alias("print"))
    keyed = keyed.select("id", "source", "size", "print", F.col("doc_id").alias("key"))
    dealt = mixing.whole_documents(keyed, plan).collect()
    assert sorted(r.doc_id for r in found) == sorted(r.key for r in dealt)

    # Each shard stands in the rows in one piece and in its order.
    by_shard = defaultdict(list)
    for r in sorted(dealt, key=lambda r: (r.shard, r.position)):
        by_shard[r.shard].append(r.key)
    assert len(by_shard) >= 64 and [len(s) for s in by_shard.values()] == [
        max(r.position for r in dealt if r.shard == k) for k in by_shard
    ]
    text = ",".join(str(r.doc_id) for r in found) + ","
    assert all(",".join(map(str, s)) + "," in text for s in by_shard.values())
    # A block's documents go together; shards have equal numbers of blocks but for one or two without documents.
    homes, blocks = defaultdict(set), defaultdict(set)
    for r in dealt:
        homes[r.number, r.turn, r.block].add(r.shard)
        blocks[r.shard].add((r.number, r.turn, r.block))
    assert all(len(s) == 1 for s in homes.values())
    assert max(map(len, blocks.values())) - min(map(len, blocks.values())) <= 2

    # Another tree deals the same documents to other shards.
    monkeypatch.setattr(mixing, "split", lambda quotas, shard, seed: F.transform(quotas, lambda q: F.floor(q / 2)))
    again = mixing.repeated(table, plan=plan).collect()
    assert sorted(again) == sorted(found) and again != found


def test_repeated_documents_of_one_id_are_their_own(spark):
    """Rows of one id, source and size with several texts, and rows equal but for another column."""
    rows = [(None if i % 2 else 7, f"t{i} " * 100, s) for i in range(60) for s in "abc"]
    table = docs(spark, rows).withColumn("n", F.col("text"))
    table = table.unionByName(table.withColumn("n", F.lit("other")))
    once = mixing.repeated(table).collect()
    sizes = defaultdict(int)
    for r in once:
        sizes[r.source] += 100
    target = plain_targets(dict.fromkeys("abc", 12_000))
    assert all(abs(sizes[s] - target[s]) <= 51 for s in "abc")
    times = defaultdict(int)
    for r in once:
        times[r.source, r.doc_id, r.text, r.n] += 1
    # The first source reaches its most, twice its words; so all of its rows are there.
    assert all(n <= 2 for n in times.values()) and len({k for k in times if k[0] == "a"}) == 120
    assert [r.text for r in mixing.repeated(table.repartition(5, "text")).collect()] == [r.text for r in once]


# URLs


def test_url_parts_and_rules(spark):
    given = [
        "HTTP://Example.COM:80/de/x?q#f", "http://a.net", "http://a.net/", "x://net?y/z", "no scheme", None, "", "a://b://c/d",
        "http://sub.example.net/en/1", "http://notexample.net/en/1", "http://Ü.org/fr/", "http://org/fr",
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)], "page_id long, url string, host string")
    rules = (urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("org", "/fr/", "allow"))
    listed = spark.createDataFrame([("a.net",), (None,), ("a.net",), ("absent",)], "host string")
    rows = {r.page_id: r for r in urls.url_filter(df, listed, rules).collect()}
    parts = [(r.host, r.path) for _, r in sorted(rows.items())]
    assert parts == [
        ("example.com:80", "/de/x"), ("a.net", ""), ("a.net", "/"), ("net", ""), ("", ""), ("", ""), ("", ""), ("b:", "//c/d"),
        ("sub.example.net", "/en/1"), ("notexample.net", "/en/1"), ("Ü.org", "/fr/"), ("org", "/fr"),
    ]
    assert [rows[i].rule for i in (1, 2, 8, 9, 10, 11)] == [None, "net/", "example.net/en/", "net/", "org/fr/", None]
    assert [rows[i].verdict for i in (1, 2, 3, 8, 9, 11)] == ["block", "block", "allow", "allow", "block", "allow"]
    joined = {r.page_id: r for r in urls.url_filter(df, listed, rules, max_bytes=0).collect()}
    assert joined == rows
    assert urls.url_filter(df.limit(0), listed, rules).collect() == []
    assert {r.verdict for r in urls.url_filter(df, listed.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(6000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 9 == 4).alias("listed"))
    levels = urls.cascade(universe)
    assert len(levels) > 2 and sum(level.bits for level in levels) < 6000 * 4
    rows = universe.select("listed", *urls.hashed(F.col("key"))).toPandas()
    assert (urls.listed(levels, rows.h1.to_numpy(), rows.h2.to_numpy()) == rows.listed.to_numpy()).all()


# Vectors


def test_top_k_of_odd_vectors(spark):
    rows = [(i, [float(i % 7), -1.0]) for i in range(0, 60)] + [
        (60, None), (61, [None, 1.0]), (62, [math.nan, 1.0]), (63, [math.inf, 0.0]), (None, [1.0, 1.0]), (0, [0.0, -1.0]),
        (80, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (120, []),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    found = vectors.top_k(df, F.col("vec_id") % 20 == 0, k=5, candidate_block=16, query_block=2).collect()
    good = {i: [math.floor(64 * x) for x in v] for i, v in dict(rows[:60] + rows[66:68]).items()}
    expected = []
    for q, v in good.items():
        if q % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good.items() if i != q and len(w) == len(v)]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])]
    assert sorted(tuple(r) for r in found) == sorted(expected)
    assert vectors.top_k(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_top_k_with_coarse_cells(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    fine, coarse = (
        {tuple(r) for r in vectors.top_k(table, F.col("vec_id") % 20 == 0, bits=b, candidate_block=100).collect()} for b in (8, 2)
    )
    assert fine == coarse


def test_top_k_of_repeated_ids(spark):
    """Different vectors of one id are rows of their own; copies of one vector are no hot group."""
    rows = [(20, [1.0, 0.0]), (21, [1.0, 0.0]), (21, [3.0, 0.0]), (22, [-1.0, 0.0]), (40, [0.0, 1.0]), (40, [0.0, 2.0])]
    rows += [(i, [0.5, 0.25]) for i in range(1001, 1200) if i % 20]
    good = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows)]
    expected = []
    for n, i, v in good:
        if i % 20 == 0:
            scores = sorted((-(v[0] * w[0] + v[1] * w[1]), j) for m, j, w in good if m != n)[:4]
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    for bits in (1, 6):
        found = vectors.top_k(df, F.col("vec_id") % 20 == 0, k=4, bits=bits, candidate_block=9)
        assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_few_exact_vectors_are_read(spark):
    """The cells of the query leave less than a tenth of all pairs to exact vectors."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.whole_numbers(table, F.col("vec_id") % 20 == 0, "vec_id", "embedding", 64)
    (known,) = vectors.passes(rows, 1000)
    pairs = vectors.candidates(vectors.approximations(rows, 20, 6), spark.sparkContext.broadcast(known), 20, 8192)
    n = sum(len(numbers) for numbers, _, _ in known.values())
    assert n * 20 <= pairs.count() < 0.1 * n * table.count()


# Near-duplicates


def plain_components(rows, words=2):
    def shingles(text):
        split = (text or "").encode().translate(near.LOWER).split()
        width = min(words, len(split))
        return {tuple(split[i : i + width]) for i in range(len(split) - width + 1)} if width else set()

    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in sets}
    links = [
        (i, j) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :]
        if a and b and 100 * len(a & b) >= 80 * len(a | b)
    ]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return {i: (len(s), label[i]) for i, s in sets}


def check(spark, rows, how):
    found = near.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows]), how=how).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_components(rows, how.words)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("how", [near.Nearness(), near.Nearness(short=2, block=3), near.Nearness(words=5, block_values=1)], ids=str)
def test_near_duplicates(spark, how):
    base = [f"w{i}" for i in range(60)]
    rows, n = [], 0
    for k in range(40):  # a chain of edits, so that far ends are joined by links between
        text = base[: 60 - k // 2] + [f"x{k}_{i}" for i in range(k // 2)]
        rows.append((n := n + 3, " ".join(text)))
        rows.append((n := n + 3, " ".join(text).upper()))
    rows += [(n + 1, ""), (n + 2, None), (n + 3, " \n"), (n + 4, "One"), (n + 5, "one"), (n + 6, "one two"), (n + 7, "ONE two")]
    rows += [(n + 8 + i, " ".join(f"c{j % (5 + i % 4)}" for j in range(30))) for i in range(30)]
    rows += [(n + 50 + i, "the same line of words " * 3 + f"then y{i} z{i} " * 20) for i in range(25)]
    check(spark, rows, how)


def test_links_of_a_block_join_each_group_once():
    """All nodes of a block are near each other: as many links as groups but one, whatever the pairs."""
    rows = pa.table(
        {"node": list(range(50)), "label": [0] * 10 + list(range(10, 50)), "n": [40] * 50, "full": [sorted([*range(39), 100 + i]) for i in range(50)]}
    )
    a, b = near.Block(rows, near.Nearness()).links()
    joined = near.Block(rows, near.Nearness()).group
    for x, y in zip(a, b, strict=True):
        joined[joined == joined[y]] = joined[x]
    assert len(a) == 40 and len(set(joined)) == 1


def test_near_duplicates_of_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op10_near_duplicates"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_components([tuple(r) for r in table])


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c", "s"), (None, "a b c", "s"), (7, "a b c", "s"), (7, "a b c", "s"), (9, "A b c", "s"), (8, "z " * 50_000, "s")]
    table = docs(spark, rows)
    found = near.near_duplicates(table).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found) == [
        (0, 0, True), (0, 0, True), (7, 7, True), (7, 7, True), (8, 8, True), (9, 7, False)
    ]
    kept = near.keep_first(table)
    assert kept.columns == table.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 7, 8]
    assert near.near_duplicates(table.limit(0)).collect() == [] and near.keep_first(table.limit(0)).collect() == []


def test_near_duplicates_of_repeated_ids(spark):
    """An id on different texts joins what is near either; the stage goes by texts and loses none."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(1, a), (2, a + " x"), (2, b), (3, b), (4, c), (4, ""), (5, None), (5, "")]
    rows = [(i, t, "s") for i, t in rows]
    found = near.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [
        (1, 29, 1), (2, 29, 1), (2, 30, 1), (3, 29, 1), (4, 0, 4), (4, 29, 4), (5, 0, 5), (5, 0, 5)
    ]
    kept = near.keep_first(docs(spark, rows))
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, a), (2, b), (4, ""), (4, c), (5, "")]
    assert kept.columns == docs(spark, rows).columns


def test_one_id_on_many_texts_joins_no_strangers(spark):
    """Groups of near texts under one id stay groups for the stage; in the query all are one document."""
    texts = [" ".join(f"t{k}_{i}" for i in range(20 + k % 7)) for k in range(60)]
    rows = [(7, t, "s") for t in texts] + [(100 + k, t.upper(), "s") for k, t in enumerate(texts)]
    rows += [(1, texts[5] + " more", "s"), (2, texts[9], "s")]
    found = near.near_duplicates(docs(spark, rows)).collect()
    assert {r.component_id for r in found} == {1} and len(found) == len(rows)
    kept = near.keep_first(docs(spark, rows)).collect()
    expected = {(7, t) for k, t in enumerate(texts) if k not in (5, 9)} | {(1, texts[5] + " more"), (2, texts[9])}
    assert {(r.doc_id, r.text) for r in kept} == expected and len(kept) == len(texts)


# Pipeline


def test_stages(spark, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "near-duplicates", "source mix", "SentencePiece"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows, ids = table, {r.doc_id for r in table.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, rows, SF)
        made.write.parquet(f"{tmp_path}/{k}")
        made = spark.read.parquet(f"{tmp_path}/{k}")
        left = {r.doc_id for r in made.select("doc_id").collect()}
        assert left <= ids and left
        if k < 4:
            assert made.columns == table.columns
            assert made.join(table, table.columns, "left_semi").count() == made.count()
        if name == "near-duplicates":
            found = plain_components([(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()], 5)
            assert left == {label for _, label in found.values()} and made.count() == len(left)
        rows, ids = made, left
    assert made.filter("NOT same").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.collect())) == sorted(map(str, made.collect()))


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null, empty, wordless and repeated documents, null ids and sources; then no documents at all."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    good = table.where("n_chars BETWEEN 400 AND 4000").orderBy("doc_id").limit(40)
    none = F.lit(None)
    odd = [good.limit(3), good.withColumn("text", none.cast("string")).limit(2), good.withColumn("text", F.lit("")).limit(2)]
    odd += [good.withColumn("text", F.lit(" \n ")).limit(1), good.withColumn("doc_id", none.cast("long")).limit(2)]
    odd += [good.withColumn("source", none.cast("string")).withColumn("doc_id", F.col("doc_id") + 10**9).limit(2)]
    rows = good
    for part in odd:
        rows = rows.unionByName(part)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, docs_, marks in (("odd", rows, labels), ("none", rows.limit(0), labels.limit(0))):
        folder = tmp_path / name
        docs_.write.parquet(f"{folder}/documents.parquet")
        marks.write.parquet(f"{folder}/labels.parquet")
        made = corpus_pipeline.run(spark, str(folder)).collect()
        # Nothing but documents with words comes out, and each text decodes to itself.
        known = {r.doc_id for r in good.collect()}
        assert {r.doc_id for r in made} <= known | {i + 10**9 for i in known} | {None} and all(r.same for r in made)
        assert bool(made) == (name == "odd")


def test_entry_lists_every_operator(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names and len(QUERIES) == 13
    assert set(entry.oracle_sql()) <= names
    assert Path(corpus_pipeline.__file__).name == "corpus_pipeline.py"
