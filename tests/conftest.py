import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.oracle import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(cores=4, partitions=4)
    env, root = s.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    from gridpanel.session import tune

    return tune(s)
