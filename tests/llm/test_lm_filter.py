"""The filter of operator 10 goes to the executors as a file; words are hashed and asked for once."""

import tracemalloc

import numpy as np
from palisade.llm import lm_score


def test_the_driver_never_holds_the_filter(spark):
    segments = lm_score.Segments(16_000_000, 16)  # 32 MB
    size = segments.bits // 8
    assert segments.n * size > 30_000_000
    at = spark.range(segments.n).repartition(8)
    table = at.selectExpr("cast(id as int) segment", f"cast(repeat('a', {size}) as binary) bits")
    tracemalloc.start()
    model = lm_score.Filter(table, segments)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16_000_000, peak
    bits = np.memmap(lm_score.SparkFiles.get(model.name), np.uint8, "r")
    assert len(bits) == segments.n * size and (bits == ord("a")).all()


def test_kept_words(monkeypatch):
    monkeypatch.setattr(lm_score, "KEPT_WORDS", 50)
    asked = []
    words = lm_score.Words(lambda hashes: asked.append(len(hashes)) or (hashes % np.uint64(7)).astype(np.int64))
    for start in (0, 20, 0, 40, 90):  # beyond what is kept, too
        part = [b"w%d" % (start + i % 30) for i in range(75)]
        hashes, levels = words(part)
        want = lm_score.word_hashes(part)
        assert (hashes == want).all() and (levels == (lm_score._mixed(want + lm_score._A) % np.uint64(7)).astype(np.int64)).all()
    assert asked == [30, 20, 20, 30]  # nothing for words that are kept
    assert words([])[0].tolist() == []


def test_filter_of_a_larger_corpus_is_sent():
    from palisade.llm import lm_score

    six_gb = lm_score.Segments(1_230_000_000)  # training tokens of about 6 GB of documents
    assert six_gb.n * six_gb.bits // 8 <= lm_score.BROADCAST_BYTES  # else its n-grams are shuffled
