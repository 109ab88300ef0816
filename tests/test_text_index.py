"""The inverted index against searches that read every text, before and after changes."""

import re

import pytest
from palisade.operators import retrieval, text_index
from pyspark.sql import functions as F

WORDS = "the quick of that red fox jumps over lazy dog and 42".split()


def texts():
    import random

    rng = random.Random(4)
    out = {i: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40))) for i in range(200)}
    return out | {200: None, 201: "", 202: "The THE the, of-that", 203: "the " * 3000 + "of that", 204: "!!! ..."}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "doc_id bigint, text string").withColumn("term", F.lit("clash")).withColumn("tf", F.lit(0)).repartition(3)


def same(index, docs, terms):
    wanted = [tuple(r) for r in retrieval.fulltext_rank(docs, "doc_id", "text", terms, 30).collect()]
    assert [tuple(r) for r in index.rank(terms, 30).collect()] == wanted
    wanted = [tuple(r) for r in retrieval.bm25_rank(docs, "doc_id", "text", terms, 30).collect()]
    found = [tuple(r) for r in index.bm25(terms, 30).collect()]
    assert [r[0] for r in found] == [r[0] for r in wanted] and all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(found, wanted, strict=True))


def phrases(rows, terms, slop):
    out = {}
    for i, text in rows.items():
        w = re.findall("[a-z0-9]+", (text or "").lower())

        def goes(at, k, w=w):
            return k == len(terms) or any(at + 1 + s < len(w) and w[at + 1 + s] == terms[k] and goes(at + 1 + s, k + 1) for s in range(slop + 1))

        starts = [p for p, x in enumerate(w) if x == terms[0] and goes(p, 1)]
        if starts:
            out[i] = (len(starts), starts[0])
    return out


@pytest.fixture(scope="module")
def index(spark):
    return text_index.build(frame(spark, texts()))


@pytest.mark.parametrize("terms", [["the", "that", "of"], ["fox"], ["fox", "fox"], ["nothing"], ["42", "dog"]])
def test_same_rows_as_a_scan_of_texts(spark, index, terms):
    docs = frame(spark, texts())
    if len(set(terms)) == len(terms):
        same(index, docs, terms)
    else:
        assert index.rank(terms, 9).collect() == index.rank(terms[:1], 9).collect()


@pytest.mark.parametrize(("terms", "slop"), [(["the", "quick"], 0), (["the", "the", "the"], 0), (["red", "fox", "dog"], 2), (["of", "that"], 0), (["the", "zebra"], 1)])
def test_phrases(index, terms, slop):
    found = {r.doc_id: (r.n, r["first"]) for r in index.phrase(terms, slop).collect()}
    assert found == phrases(texts(), terms, slop)


def test_queries_read_postings_alone(index, capsys):
    index.rank(["the", "fox"], 5).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [In(term" in plan and "index-segment" in plan and "text" not in re.sub("index-[a-z]+", "", plan).replace("context", "")


def test_add_replace_remove_and_compact(spark, index):
    rows = texts()
    changed = index.add(frame(spark, {5: "a new text of that fox", 900: "the fox of that", 901: None})).remove(spark.createDataFrame([(7,), (12345,), (900,)], "id bigint"))
    rows |= {5: "a new text of that fox", 901: None}
    del rows[7]
    same(changed, frame(spark, rows), ["of", "that"])
    again = changed.add(frame(spark, {900: "the fox is back of that"}))
    rows[900] = "the fox is back of that"
    same(again, frame(spark, rows), ["of", "that"])
    small = again.compact()
    assert len(small.segments) == 1 and not small.removed
    same(small, frame(spark, rows), ["of", "that"])
    assert small.documents().count() == len(rows) and {r.doc_id: (r.n, r["first"]) for r in small.phrase(["fox"]).collect()} == phrases(rows, ["fox"], 0)


def test_repeated_ids_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "three"), (None, "one two"), (None, "four")], "doc_id bigint, text string")
    found = text_index.build(docs)
    got = {(r.term, r.doc_id): (r.tf, r.length) for r in found.postings().collect()}
    assert got[("one", 1)] == (2, 5) and got[("three", 1)] == (1, 5) and got[("four", None)] == (1, 3) and found.documents().count() == 2
    none = text_index.build(docs.where("false"))
    assert none.rank(["one"], 3).collect() == [] and none.phrase(["one", "two"]).collect() == [] and none.bm25(["one"], 3).collect() == []


def test_texts_are_not_shuffled(spark):
    from test_shuffles import shuffled_rows

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(80)), lambda x: F.concat(F.lit("w"), (x * F.col("id") % 97).cast("string")))).alias("text"))
    made = []
    n = shuffled_rows(spark, lambda: made.append(text_index.build(docs)))
    assert n <= made[0].postings().count() + 300 + 30  # postings once, and an id of each document


def test_rows_of_equal_and_missing_ids(spark):
    rows = [(1, "b a"), (1, "a"), (1, None), (None, "c a"), (None, None), (2, None), (3, ""), (4, "a b a")]
    index = text_index.build(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert {(r.doc_id, r.length) for r in index.documents().collect()} == {(1, 3), (None, 2), (2, None), (3, 0), (4, 3)}
    found = {(r.doc_id, r.term): (r.tf, r.length, list(r.positions)) for r in index.postings().collect()}
    assert found[4, "a"] == (2, 3, [0, 2]) and found[None, "c"] == (1, 2, [0]) and len(found) == 6
    assert {tuple(found[1, "a"][2] + found[1, "b"][2])} <= {(0, 2, 1), (1, 2, 0)}
