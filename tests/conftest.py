import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    import check

    return check.session()


@pytest.fixture()
def hot(spark):
    """Force the split path: any group above 3 rows is hot, any neighbour group above 8 rows is cut."""
    spark.conf.set("spark.tidepair.hotGroupRows", "3")
    spark.conf.set("spark.tidepair.knnLeafRows", "8")
    yield spark
    spark.conf.unset("spark.tidepair.hotGroupRows")
    spark.conf.unset("spark.tidepair.knnLeafRows")
