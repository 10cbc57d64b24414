import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from stormcell.session import get_session
    s = get_session("local[4]", app="stormcell-tests", shuffle_partitions=4)
    yield s
    s.stop()


def obs_frame(spark, rows):
    """Hourly table from (city, 'YYYY-MM-DD HH', humidity, temp, precip,
    apparent, wind, suspension) tuples."""
    import datetime as dt

    from stormcell.schema import OBS_SCHEMA
    data = [(c, dt.datetime.strptime(t, "%Y-%m-%d %H"), *rest) for c, t, *rest in rows]
    return spark.createDataFrame(data, OBS_SCHEMA)
