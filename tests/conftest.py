import pytest

from tidemark.session import build


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build(4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
