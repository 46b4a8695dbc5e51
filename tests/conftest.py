import sys
import uuid
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dwell.streaming import sessions as _streams  # noqa: E402

# a stream goes on where the one of its name ended: the names of a test run are its own
_RUN, _location = uuid.uuid4().hex[:12], _streams.checkpoint_location
_streams.checkpoint_location = lambda spark, name: _location(spark, f"{name}-{_RUN}")


@pytest.fixture(scope="session")
def spark():
    from dwell.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="dwell-tests")
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
