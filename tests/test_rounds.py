"""Evaluation over rounds 1 to 4."""

import os

from palisade import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_breakdown_shows_four_rounds(spark):
    got = plans.QUERIES["topk_mrr_breakdown"](spark, SF).where("dimension = 'round'").collect()
    assert {r.value for r in got} == {"1", "2", "3", "4"}
