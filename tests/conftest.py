from __future__ import annotations

import pytest

from utterance_guard.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
    }
    session = local_session("tests", "4", **conf)
    yield session
    session.stop()
