"""Negatives and competition over whole draft years."""

import os

from palisade import plans
from palisade.sources.star import order_picks

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_every_pick_with_a_pool_gets_twelve(spark):
    picks = [r for r in order_picks(spark, SF).where("round <= 4").select("year", "month", "overall_pick", "position").collect()]
    pools = {}
    for r in sorted(picks, key=lambda r: -r.overall_pick):
        seen = pools.setdefault((r.year, r.position), [])
        seen.append((r.year, r.overall_pick, len(seen)))
    want = {(y, p) for v in pools.values() for y, p, pool in v if pool >= 12}
    got = plans.QUERIES["stratified_negatives"](spark, SF).where("stratum = 'position'").collect()
    assert {(r.year, r.overall_pick) for r in got} == want and all(r.n == 12 for r in got)
    assert {r.month for r in picks if (r.year, r.overall_pick) in want} > {1, 2}
