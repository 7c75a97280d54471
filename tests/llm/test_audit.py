"""Filter interactions against a plain count in every order, with files in an order that forces retractions."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit
from tidemark.llm.texts import saved

SCHEMA = "doc_id long, text string, lang string, n long, part string, mask string"
LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    """Every order applied to every document, one by one."""
    good, toxic = ({i for i, *flags in labels if flags[k] == 1} - {None} for k in (0, 1))
    least = {}
    for number, text, *_ in rows:
        if number is not None:
            least[text or ""] = min(number, least.get(text or "", number))
    counts, parts, first = {}, {lang or "" for _, _, lang, *_ in rows}, Counter()
    documents = []
    for number, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": re.search("[#$%&*|]", text) is not None,
            "E": number is not None and number > least[text],
        }
        documents.append((lang or "", {x for x, f in fails.items() if f}, number in good, number in toxic))
    for part in parts:
        for order in permutations("ABCDE"):
            left = [d for d in documents if d[0] == part]
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                here = [d for d in documents if d[0] == part]
                first[part, x] += len(gone)
                left = [d for d in left if x not in d[1]]
                redundant = sum(x in d[1] for d in here) - len(gone)
                unique = sum(d[1] == {x} for d in here)
                counts[part, "".join(order), step] = [
                    len(left), len(gone), redundant, unique, sum(d[2] for d in gone), sum(d[3] for d in gone)
                ]
    return {(p, o, s): (*v, first[p, o[s - 1]]) for (p, o, s), v in counts.items()}


def got(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in df.collect()}


def write(spark, rows, path):
    made = [(i, t, lang, 1, "p", "m") for i, t, lang in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(path)


LONG = " ".join(f"w{i}" for i in range(120))
FILES = [
    [(9, "copy", "de"), (8, "copy", "en"), (7, LONG, "en"), (7, LONG, "de"), (None, "copy", "en"), (5, None, None)],
    [(4, "copy", "fr"), (4, "copy", "en"), (6, LONG, "en"), (None, None, None), (10, "copy", "de"), (3, "", "en")],
    [(1, "copy", "en"), (2, LONG + " $", "en"), (2, LONG + " $", "en"), (11, "LOUD " * 100, "en"), (6, LONG, "")],
    [(i, "copy", "en") for i in range(100, 400)] + [(0, "a b " * 60, "en"), (20, "漢字 " * 101, "漢")],
]
MARKS = [(9, 1, 0), (8, 0, 1), (4, 1, 1), (1, 1, None), (1, 0, 1), (7, 1, 0), (150, 1, 1), (999, 1, 1), (None, 1, 1)]


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 2, 1, 0]])
def test_audit_in_any_order_of_files(spark, tmp_path, order):
    path = str(tmp_path / "documents")
    for i in order:
        write(spark, FILES[i], path)
    labels = spark.createDataFrame(MARKS, LABELS)
    want = plain([row for i in order for row in FILES[i]], MARKS)
    made = filter_audit.filter_audit(spark, path, labels, batches=len(order))
    assert got(made) == want and made.count() == 600 * 5


def test_smaller_ids_retract_over_calls(spark, tmp_path):
    """Each call is a new batch over the same state; its changes take back what an earlier one counted."""
    path, root = str(tmp_path / "documents"), str(tmp_path / "audit")
    labels, rows = spark.createDataFrame(MARKS, LABELS), []
    for i in (3, 0, 1, 2):
        write(spark, FILES[i], path)
        rows += FILES[i]
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        counts = filter_audit.count_masks(stream, labels, checkpoint=root)
        assert got(filter_audit.interactions(counts)) == plain(rows, MARKS)
    counters = spark.read.parquet(f"{root}/counters")
    assert counters.where("delta < 0").select("batch").distinct().count() >= 2
    assert counters.agg(F.sum("delta")).first()[0] == len(rows)


def test_one_file_and_an_empty_table(spark, tmp_path):
    labels = spark.createDataFrame([], LABELS)
    write(spark, [], str(tmp_path / "empty"))
    assert filter_audit.filter_audit(spark, str(tmp_path / "empty"), labels).collect() == []
    write(spark, FILES[0], str(tmp_path / "some"))
    (one,) = (tmp_path / "some").glob("*.parquet")
    assert got(filter_audit.filter_audit(spark, str(one), labels)) == plain(FILES[0], [])


def test_copies_of_labels_are_not_sent_through_the_driver(spark):
    """Their file is small, and Spark does not count that each label comes once a salt."""
    flags = saved(filter_audit.label_flags(spark.createDataFrame(MARKS, LABELS)), "label-flags")
    docs = spark.createDataFrame([(i, t, lang, 1, "p", "m") for i, t, lang in FILES[0]], SCHEMA)
    found = filter_audit.arrivals(docs, flags, filter_audit.Thresholds())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.agg(F.sum("documents")).first()[0] == len(FILES[0])
