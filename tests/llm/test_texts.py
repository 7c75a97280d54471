"""Operators on single texts, against plain versions and the libraries they follow."""

from __future__ import annotations

import html
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, compression, discriminant, pages, pieces, toxicity
from tidemark.llm.labels import sampled_texts
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BPE, PIECES = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    None, "", " ", "\n\n", "a", "a\x00b", "x" * 30_000, "ab " * 9_000, "  a  b\n c\t ", "é漢▁x\x00y ▁", "\x1c\x85 \u2028z",
    "<|endoftext|>x<|endoftext|><|endoftext|>", "<s> </s> <0x0A>", "😀😀 ħé", "'s I'll ٣² !!", "same\nsame\n\nsame", "aaaabaaaab" * 30,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, label long"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, some ids null or repeated, with columns named like those that operators make."""
    rows = [(i if i % 5 else None, t, None, None, None, "w", "k", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + rows[:4], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    found = duckdb.connect().execute(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()
    return [t for (t,) in found]


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_compression_bands(spark, odd, texts):
    made = compression.judge()()([t.encode() for t in texts])
    for i, text in enumerate(texts):
        counts = plain_counts(text)
        assert tuple(int(column[i]) for column in made[:5]) == counts
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert bool(made[5][i]) == failed and not (failed and made[6][i])
        raw = text.encode()
        assert made[7][i] == pytest.approx(len(raw) / len(zstandard.compress(raw, 3)))
    rows = compression.compression_bands(odd).collect()
    assert len(rows) == odd.count()
    for row in rows:
        if row.n_words == 0:
            assert row.base_failed and not row.kept and row.word_chars == 0
    kept = compression.keep_quality(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert compression.compression_bands(odd.limit(0)).collect() == []


def test_compression_bands_reject_noise_and_repetition():
    noise = bytes(np.random.default_rng(1).integers(33, 127, 9000).astype(np.uint8))
    noise = b" ".join(noise[i : i + 9] for i in range(0, 9000, 9))
    half = b" ".join(b"%d" % i for i in range(3000)) + b" " + b"abc " * 8000
    words = np.random.default_rng(2).integers(0, 3000, 2000)
    clean = " ".join(f"w{chr(97 + w % 26)}{chr(97 + w // 26 % 26)}{chr(97 + w // 676)}ing" for w in words).encode()
    verdict = compression.judge()()([noise, half, clean])
    assert verdict[6].tolist() == [False, False, True]


def test_token_counts(spark, odd, texts):
    library = Tokenizer.from_file(BPE)
    some = [t or "" for t in ODD] + texts
    made = bpe.counter(BPE, 1024)()([t.encode() for t in some])
    expected = [len(library.encode(t, add_special_tokens=False).ids) for t in some]
    assert made[1].tolist() == expected
    assert made[0].tolist() == [len(t.encode()) for t in some] and made[2].tolist() == [n > 1024 for n in expected]
    rows = bpe.token_counts(odd, BPE).collect()
    assert len(rows) == odd.count() and Counter(r.n_tokens for r in rows) == Counter(expected[: len(ODD)] + expected[:4])
    assert bpe.token_counts(odd.limit(0), BPE).collect() == []


def test_sentencepiece(spark, odd, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = pieces.encode_texts(odd, PIECES, ["text"]).collect()
    assert len(rows) == odd.count()
    for row in rows:
        assert row.ids == (None if row.text is None else library.encode(row.text))
        assert row.n_ids == (None if row.text is None else len(row.ids))
    decoded = pieces.decode_ids(pieces.encode_texts(odd, PIECES, ["text"]), PIECES).collect()
    for row in decoded:
        assert row.decoded == (None if row.ids is None else library.decode(row.ids))
        # The mark for a space in a text becomes a space.
        assert row.decoded == (None if row.text is None else row.text.replace(pieces.SPACE, " "))
    encode = pieces.Encoder(PIECES)
    ids, many = encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])] == library.encode(texts)
    trip = QUERIES["op5_sentencepiece"](spark, SF)
    assert trip.filter("NOT same").count() == 0 and trip.count() == len(texts)
    assert pieces.round_trip(odd.limit(0), PIECES).collect() == []
    assert pieces.round_trip(odd, PIECES).filter("same IS NULL").count() == 2


def plain_main_text(page):
    inner = re.search("<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br|article)>", inner)
    found = [" ".join(html.unescape(re.sub("<[^>]*>", "", part)).split()) for part in parts]
    return "\n".join(filter(None, found))


def test_page_texts(spark):
    rows = duckdb.connect().execute("SELECT page_id, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    found = {r.page_id: r for r in QUERIES["op2_template_text"](spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == len(rows)
    for page_id, page in rows:
        assert found[page_id].text == plain_main_text(page)
        assert found[page_id].n_chars == len(found[page_id].text)


def test_page_texts_learn_a_template_without_named_parts(spark):
    def page(i):
        body = f"<p>Story {i} first.<p>And <b>more</b> of {i} &amp; so on.</p>"
        return f"<div><div>Home</div><div>Contact us</div></div><div><h1>Title {i}</h1>{body}</div><div>All rights kept</div>"

    rows = [(i, f"http://a.b/{i}", page(i)) for i in range(12)]
    found = pages.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for row in found:
        i = row.page_id
        assert row.text == f"Title {i}\nStory {i} first.\nAnd more of {i} & so on."
    # Too few pages for a template.
    few = pages.page_texts(spark.createDataFrame(rows[:2], "page_id long, url string, html string")).collect()
    assert all(r.text.startswith("Home\nContact us\nTitle") for r in few)


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article>a<!-- <p>x --> b</article>", "a b"),
        ("<header>top</header><article><header>head</header>a</article><footer>f</footer>", "head\na"),
        ("<article>a<script>if (a</b) '</p>'</script>b<style>p{}</style></article>", "ab"),
        ("<article>a<div class='post-comments'>c</div><aside>s</aside><form>f</form>b</article>", "a\nb"),
        ("<p class=cookie-notice>n<p>kept", "kept"),
        ("<article>unclosed <b>bold <p>x&nbsp;&lt;y&#33;", "unclosed bold\nx <y!"),
        ("<article><ul><li>one<li>two</ul>", "one\ntwo"),
        ("plain & bare < text", "plain & bare < text"),
        ("", ""),
        ("<", "<"),
    ],
)
def test_main_text(page, text):
    assert pages.main_text(page) == text


def test_page_texts_odd_rows(spark):
    rows = [(1, None, None), (None, "", ""), (3, "no host", "<p>x"), (3, "no host", "<p>x"), (4, "http://h", "<p>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    found = sorted((r.page_id or 0, r.text) for r in pages.page_texts(df).collect())
    assert found == [(0, ""), (1, ""), (3, "x"), (3, "x"), (4, "deep")]
    assert pages.page_texts(df.limit(0)).collect() == []


def texts_of_pages(spark, bodies, host="http://a.b"):
    rows = [(i, f"{host}/{i}", body) for i, body in enumerate(bodies)]
    found = pages.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(found)]


def test_page_texts_of_copies(spark):
    def page(i, story, k):
        text = "".join(f"<p>Story {story} part {j}." for j in range(k))
        return f"<link href={i}><div>Home</div><div>{text}</div><div>All rights kept</div>"

    def told(story, k):
        return [f"Story {story} part {j}." for j in range(k)]

    # A host of copies alone, and one with a group of copies of 40 percent that is longer than the other pages.
    for text in texts_of_pages(spark, [page(i, 0, 20) for i in range(5)]):
        assert [line for line in text.split("\n") if line.startswith("Story")] == told(0, 20)
    mixed = [(0, 20)] * 4 + [(i, 5 + i) for i in range(1, 7)]
    for text, (story, k) in zip(texts_of_pages(spark, [page(i, *m) for i, m in enumerate(mixed)]), mixed, strict=True):
        assert text.split("\n") == told(story, k)


@pytest.mark.parametrize("name", ["div", "section", "article"])
def test_page_texts_of_siblings(spark, name):
    def body(i):
        one, two = f"The longer part of story {i} stands here.", f"And {i} ends here."
        front = "<div>New</div>" if i % 4 == 0 else ""
        return f"{front}<div><{name} class=a><p>{one}</{name}><{name} class=b><p>{two}</{name}></div>", f"{one}\n{two}"

    bodies = [body(i) for i in range(12)]
    for text, (_, wanted) in zip(texts_of_pages(spark, [page for page, _ in bodies]), bodies, strict=True):
        assert text.removeprefix("New\n") == wanted


@pytest.mark.parametrize("start", ["<div class='content with-sidebar'>", "<div class='no-comments post'>", "<div id=search-and-article>", "<form>"])
def test_page_texts_in_named_wrappers(spark, start):
    end = start[1:].split(" ")[0].split(">")[0]

    def page(i):
        return f"<body>{start}<p>Story {i} is told here.<p>And it ends {i}.<div class=sidebar>See {i}</div></{end}>"

    wanted = [f"Story {i} is told here.\nAnd it ends {i}." for i in range(8)]
    assert texts_of_pages(spark, [page(i) for i in range(8)]) == wanted
    assert pages.main_text(page(3)) == wanted[3]
    # Beside the teaser of another article, what most pages hold there decides.
    told = texts_of_pages(spark, [page(i).replace("<body>", f"<body><article>T{i}</article>") for i in range(8)])
    assert told == [f"T{i}\n{text}" for i, text in enumerate(wanted)]
    # A name beside a short article still rules out.
    assert pages.main_text("<article>ok</article><div class=ad>much longer than it</div>") == "ok"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def accuracy(spark, name, label, sf):
    scored = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    known = duckdb.connect().execute(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall()
    tested = [(scored[i].predicted, y) for i, y in known if held_out(i)]
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 for i, r in scored.items())
    return sum(p == y for p, y in tested) / len(tested)


def test_toxicity_on_held_out_documents(spark):
    assert accuracy(spark, "op6_toxicity", "toxic", "/root/testdata/sf0.1") > 0.97


def test_toxicity_is_the_noisy_or_of_the_model(spark):
    """Scores of the query, sentence by sentence in plain Python from the weights of the model."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels, "doc_id", "text", "toxic")
    assert len(model.weights) > 20

    def plain(text):
        clean, words, some = 1.0, set(), False

        def ended():
            odds = model.prior + sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(toxicity.normal(w)[0]))
            return 1.0 if not some or odds <= model.level else 1 / (1 + math.exp(odds))

        for line in text.replace("\x1e", " ").split("\n"):
            for word in line.encode().split():
                bare, end = toxicity.normal(word)
                words.add(word)
                some = some or bare != b""
                if end:
                    clean, words, some = clean * ended(), set(), False
            clean, words, some = clean * ended(), set(), False
        return 1 - clean

    scored = {r.doc_id: r.score for r in QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    wanted = {r.doc_id: plain(r.text or "") for r in docs.select("doc_id", "text").collect()}
    assert scored == pytest.approx(wanted, abs=1e-9) and sum(x > 0.5 for x in wanted.values()) > 20


def test_sample_of_labelled_texts(spark):
    """Only ids that have a text that is short enough take a place; an id takes one, with its least text."""
    docs = [(i, f"text {i}", "x") for i in range(50)] + [(7, f"again {i}", "x") for i in range(3000)]
    docs += [(i, "long" * 100, "x") for i in range(50, 60)] + [(None, "none", "x"), (61, None, "x"), (11, "long" * 100, "x")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, label string")
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    known = [i for i in range(50) if not held_out(i)]
    found = sampled_texts(docs, labels, "doc_id", "text", "toxic", 40, 100).collect()
    assert sorted(map(tuple, found)) == sorted((i % 2, "again 0" if i == 7 else f"text {i}") for i in known)
    few = sampled_texts(docs, labels, "doc_id", "text", "toxic", 5, 100).collect()
    assert sorted(r.label for r in few) == [0] * 5 + [1] * 5 and set(few) <= set(found)


def test_quality_on_held_out_documents(spark):
    assert accuracy(spark, "op7_quality", "quality", "/root/testdata/sf0.1") > 0.98


def test_toxicity_fit_holds_no_table_of_all_features():
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghij", k=8)) for _ in range(5000)]
    texts = [" ".join(draw.choices(words, k=400)).encode() for _ in range(1000)]
    tracemalloc.start()
    try:
        toxicity.fit(texts, [0, 1] * 500, toxicity.Training(steps=1, settled=1))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # About two million features, one for each document that has it, took 8 bytes each several times over.
    assert peak < 12 * sum(map(len, texts))


def test_toxicity_finds_the_sentence():
    clean = [b"The house is tall. We went out there.\nNice and fine", b"Trees are green. Birds sing here."] * 8
    bad = [b"The house is tall. Q%d vile r%d. Birds sing" % (i, i) for i in range(8)]
    bad += [b"Nice trees.\nS%d t%d vile.\nFine" % (i, i) for i in range(8)]
    texts = [t + b" n%d." % i for i, t in enumerate(clean + bad)]
    model = toxicity.fit(texts, [0] * 16 + [1] * 16)
    scored = toxicity.scorer(model)()([b"Fine. A vile house. Birds sing.", b"Birds sing.", None, b""])
    assert scored[1].tolist() == [1, 0, 0, 0]
    assert scored[2].tolist() == [3, 1, 0, 0] and scored[3].tolist() == [1, 0, -1, -1]
    assert scored[5] == ["A vile house.", "Birds sing.", None, None] and scored[0][2] == 0
    # Noisy-or of the sentences.
    one, two = (toxicity.scorer(model)()([t])[0][0] for t in (b"A vile house.", b"Birds sing."))
    both = toxicity.scorer(model)()([b"A vile house. Birds sing."])[0][0]
    assert both == pytest.approx(1 - (1 - one) * (1 - two))


def test_toxicity_of_long_clean_texts():
    clean = [b"The house is tall. We went out there.\nNice and fine", b"Trees are green. Birds sing here."] * 8
    bad = [b"The house is tall. Q%d vile r%d. Birds sing" % (i, i) for i in range(8)]
    bad += [b"Nice trees.\nS%d t%d vile.\nFine" % (i, i) for i in range(8)]
    model = toxicity.fit([t + b" n%d." % i for i, t in enumerate(clean + bad)], [0] * 16 + [1] * 16)
    code = b"\n\n".join(b"x%d = foo(%d) + bar" % (i, i) for i in range(100_000))
    prose = b"\n".join([b"Trees are green.", b"We went out there.", b"It rains."] * 40_000)
    rules = b"----\n\n***\n" * 50_000
    score, predicted, n, worst, _, said = toxicity.scorer(model)()([code, prose, rules, code + b"\nA vile house.\n" + code])
    assert list(predicted) == [0, 0, 0, 1] and list(score[:3]) == [0, 0, 0]
    assert list(n) == [100_000, 120_000, 0, 200_001] and worst[3] == 100_000 and said[3] == "A vile house."
    # Words that lean a little to the toxic side do not add up either.
    leaning = toxicity.Model({b"rains": 2.0, b"vile": 9.0}, -8.0, toxicity.Training().level)
    assert list(toxicity.scorer(leaning)()([b"It rains.\n" * 100_000, b"So vile."])[1]) == [0, 1]


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame(
        [(i, q, q) for i in range(1, 20) for q in (0, 1, None)] + [(None, 1, 1)], "doc_id long, quality int, toxic int"
    )
    none = labels.limit(0)
    for known in (labels, none):
        for rows in (toxicity.toxicity(odd, known), discriminant.quality(odd, known)):
            found = rows.collect()
            assert len(found) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
            assert not any(r.held_out for r in found if r.doc_id is None)
        assert toxicity.toxicity(odd.limit(0), known).collect() == []
        assert discriminant.quality(odd.limit(0), known).collect() == []
    assert toxicity.keep_clean(odd, none).count() == odd.count()


def test_discriminant_is_the_log_density_ratio():
    rng = np.random.default_rng(3)
    d = len(discriminant.NAMES)
    rows = [rng.normal(size=(400, d)), rng.normal(size=(300, d)) * 2 + 1]
    upper = np.triu_indices(d)
    found = [
        {"label": k, "n": len(x), "sums": np.concatenate([x.sum(0), (x.T @ x)[upper]])} for k, x in enumerate(rows)
    ]
    classes = discriminant.fit(found, discriminant.Shrinkage(0, 0))
    x = rng.normal(size=(5, d))
    n, z = 700, (x - classes.center) / classes.scale
    expected = np.zeros(5)
    for sign, k in ((-1, 0), (1, 1)):
        own = (rows[k] - classes.center) / classes.scale
        pooled = sum(len(r) / n * np.cov(((r - classes.center) / classes.scale).T, bias=True) for r in rows)
        lean = d / (len(own) + d)
        cov = (1 - lean) * np.cov(own.T, bias=True) + lean * pooled + 1e-6 * np.eye(d)
        gap = z - own.mean(0)
        distance = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap)
        expected += sign * (np.log((len(own) + 0.5) / (n + 1)) - 0.5 * distance - 0.5 * np.linalg.slogdet(cov)[1])
    assert classes.log_odds(x) == pytest.approx(expected, rel=1e-6)
