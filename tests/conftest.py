import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from notelake.session import build

    return build("local[4]", "notelake-tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
