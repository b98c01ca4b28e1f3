import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import build_session, checkpoint_dir
    s = build_session("local[4]", 8, app_name="tidemark-tests",
                      extra={"spark.driver.memory": "4g"})
    # Uses spark.checkpoint.dir when the environment names one; else a scratch folder.
    checkpoint_dir(s)
    yield s
    s.stop()


class FakeTables:
    """Hand-made tables with the same attributes as ``sources.testdata.Tables``."""

    def __init__(self, **dfs):
        self.__dict__.update(dfs)
