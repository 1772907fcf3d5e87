import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from nameprice.session import ensure_checkpoint_dir, get_spark

    s = get_spark(master="local[*]", shuffle_partitions=8)
    ensure_checkpoint_dir(s)  # unset in tests: a scratch folder is registered
    yield s
    s.stop()


@pytest.fixture(scope="session")
def names_df(spark):
    """Golden names (FIXTURES.md §4): pytest only, never a registered query."""
    rows = [(1, None), (2, ""), (3, "日本 A　５x-9(克)𠮷ß"), (4, "500g 餅乾"), (5, "水 500ml"),
            (6, "米 2.5kg 12.5"), (7, "99999999999999999999 紙"), (8, "手機")]
    return spark.createDataFrame(rows, "product_id long, name string")
