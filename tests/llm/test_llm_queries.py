"""The registered queries of the llm subpackage and the corpus pipeline."""

import os

import corpus_pipeline
import oracle
import pytest
from palisade.llm import queries
from palisade.llm.common import documents, written
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert not oracle.differences(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_one_query_per_operator():
    assert sorted(int(x[2:].split("_")[0]) for x in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = documents(spark, SF)
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == docs.columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert ids and set(ids) <= before
        if name != "source_mix":
            assert len(ids) == len(set(ids))  # doc_id is a key of documents
        docs, before = out, set(ids)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert tokens.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and tokens.count() == docs.count()
    # a mix repeats whole documents only
    assert tokens.groupBy("doc_id").agg(F.countDistinct("ids_sha256").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("rows", [20, 10_000])
def test_classifier_sample_bound(spark, rows):
    """A smaller labelled sample changes which rows stay, never what they hold."""
    from palisade.llm import classifier

    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    kept = classifier.keep_good(docs, labels, sample_rows=rows)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_as_a_whole(spark, tmp_path, kind):
    """Nulls in every column, repeated rows, an empty and a very long text, clashing extra columns; and no rows at all."""
    import hashlib
    import random

    import numpy as np
    from tokenizers import Tokenizer

    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("tion", "the", "an", "re") for b in ("er", "ing", "ou", "sh") for c in ("a", "e", "d", "st")]
    good = lambda n: ". ".join(" ".join(rng.choices(words, k=9)) for _ in range(n))
    rows = [(i, good(12), "en", f"s{i % 3}") for i in range(90)]
    near = rows[0][1].split(" ")
    rows += [(100 + k, " ".join([*near[: 20 + k], "other", *near[21 + k :]]), "en", "s1") for k in range(4)] + [(110, rows[1][1], "en", None), rows[2], rows[2]]
    rows += [(i, "spam ### %%% " * 40, "en", "s2") for i in range(200, 240)]
    rows += [(None, good(12), None, None), (None, None, None, None), (300, None, "en", "s0"), (301, "", "en", "s0"), (302, good(9000), "en", "s0")]
    schema = "doc_id bigint, text string, lang string, source string"
    df = spark.createDataFrame(rows if kind == "odd" else [], schema)
    clashes = ("row", "fp", "comp", "kept", "words", "mix_size", "palisade_row", "stats", "part", "n")
    df.select("*", *[F.lit("clash").alias(c) for c in clashes]).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 200), 0) for i, *_ in rows if i is not None] + [(None, 1, 0), (5, None, 0)]
    spark.createDataFrame(labels if kind == "odd" else [], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if kind == "empty":
        assert got == []
        return
    ids = [r.doc_id for r in got]
    assert not set(ids) & set(range(200, 240)) and not {300, 301} & set(ids)  # rejected
    assert not {100, 101, 102, 103, 110} & set(ids) and all(ids.count(i) <= 2 for i in set(ids))  # one of a group stays; a mix takes nothing more than twice
    assert len(set(ids)) > 60
    model, text_of = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")), {i: t for i, t, *_ in rows if i is not None}
    for r in got:
        if r.doc_id is not None:
            want = model.encode(text_of[r.doc_id], add_special_tokens=False).ids
            assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_the_pipeline_keeps_what_the_classifier_scores_good(spark):
    """With all labelled ids inside the bound, the stage's rows are those whose own query scores them 0.5 or more."""
    from palisade.llm import classifier

    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    wanted = {r.doc_id for r in classifier.score_documents(docs, labels).where("score >= 0.5").collect()}
    kept = [r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()]
    assert sorted(kept) == sorted(wanted) and 0 < len(kept) < docs.count()


def test_the_mix_holds_each_row_as_often_as_it_is_taken(spark):
    from collections import Counter

    from palisade.llm import mixing

    docs = documents(spark, SF)
    copies = {r.doc_id: r.mix_copies for r in mixing.mix(docs, keep=["doc_id"]).collect()}
    rows = mixing.mixed(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter({i: k for i, k in copies.items() if k})
    whole = {r.doc_id: r for r in docs.collect()}
    assert all(r == whole[r.doc_id] for r in rows)


@pytest.mark.parametrize(("own", "kept"), [("67108864b", 2 << 20), ("1m", 1 << 20)])
def test_the_pipeline_hands_texts_to_python_in_small_batches(spark, own, kept):
    """A batch of a whole split, held several times a task, took an executor beyond its memory."""
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    long = spark.range(3000).repartition(1).select("id", F.repeat(F.lit("x"), 4000).alias("text"))
    try:
        spark.conf.set(key, own)
        corpus_pipeline.STAGES[-1][1](spark, documents(spark, SF), SF)
        got = long.mapInArrow(sizes, "n long, size long").collect()
    finally:
        spark.conf.set(key, before)
    assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < kept + 100_000
