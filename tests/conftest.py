import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from suite import ROOT, SF_SMALL  # noqa: E402

sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from vitrine.session import build_session

    ckpt = tempfile.mkdtemp(prefix="vitrine-test-ckpt-")
    s = build_session(app="vitrine-tests", master="local[8]", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": ckpt})
    yield s


@pytest.fixture(scope="session")
def tables_small(spark):
    from vitrine.sources.tables import RetailTables

    return RetailTables.from_tpch(spark, SF_SMALL)
