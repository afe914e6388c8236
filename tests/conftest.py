import pytest

from flowlens.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    """One session for all tests; the shared folder is set here because no cluster sets it."""
    work = tmp_path_factory.mktemp("flowlens")
    session = local_session(
        4,
        "tests",
        **{
            "spark.checkpoint.dir": str(work / "shared"),
            "spark.sql.warehouse.dir": str(work / "warehouse"),
            "spark.sql.shuffle.partitions": "4",
        },
    )
    yield session
    session.stop()
