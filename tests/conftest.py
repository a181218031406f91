import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from attestry.session import local_session, ship

    s = local_session(4, 4, "4g", **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    ship(s)
    yield s
    s.stop()
