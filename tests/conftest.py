import pytest

from tallyframe.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", shuffle_partitions=4)
    # plans are asserted on, so they are printed whole
    session.conf.set("spark.sql.debug.maxToStringFields", "2000")
    session.conf.set("spark.sql.maxMetadataStringLength", "20000")
    yield session
    session.stop()


def rows(df):
    """Rows as tuples, sorted for comparison with missing values last."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
