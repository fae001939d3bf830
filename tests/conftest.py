from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from casework.session import build, ship

    work = tmp_path_factory.mktemp("spark")
    s = build(
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(work), "spark.checkpoint.dir": str(work / "shared")},
    )
    ship(s)
    yield s
    s.stop()
