"""Every registered query against its SQL on the smallest tables.

Model fits and most streams take long and have tests of their own, so they are left to
``tools/compare.py``.
"""

import pytest

from checks import ORACLES, QUERIES
from tools.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
SLOW = {k for k in QUERIES if k.startswith("stream_")} | {"blend_fit"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("key", sorted(set(ORACLES) - SLOW))
def test_matches_sql(spark, con, key):
    ok, text = compare(spark, con, FOLDER, key, QUERIES, ORACLES)
    assert ok, text


def test_every_key_is_registered_once():
    assert set(ORACLES) <= set(QUERIES)
