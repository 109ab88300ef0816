"""Every query of the draft domain against its SQL, and the shape of the package."""

import os
import subprocess
import sys
from pathlib import Path

import oracle
import pytest
from palisade import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, name):
    assert not oracle.differences(plans.QUERIES[name](spark, SF), plans.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_without_sql(spark, name):
    df = plans.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_rest_does_not_import_training_data_operators():
    code = "import sys; from palisade import plans; print([m for m in sys.modules if m.startswith('palisade.llm')])"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert said.stdout.strip() == "[]"


def test_seeded_drafts_repeat(spark):
    one, two = (plans.QUERIES["draft_monte_carlo"](spark, SF) for _ in range(2))
    assert oracle.rows_of(one.columns, one.collect()) == oracle.rows_of(two.columns, two.collect())


def test_clusters_cover_every_manager(spark):
    found = plans.QUERIES["archetype_gmm"](spark, SF).collect()
    assert len({r.gm for r in found}) == len(found)
