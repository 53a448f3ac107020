import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from sharpfleet.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def formula(spark):
    """n stacks of 32×32 pixels and five frames from an integer formula."""
    def make(n=1, size=32, frames=5):
        return spark.sql(f"""
            SELECT s.id AS stack_id, CAST(f.id AS INT) AS frame, CAST(y.id AS INT) AS y, CAST(x.id AS INT) AS x, {size} AS h, {size} AS w,
                   CAST((x.id*x.id*7 + y.id*y.id*13 + x.id*y.id*5 + f.id*31*((x.id div 8 + f.id) % 5) + s.id*17) % 256 AS INT) AS v
            FROM range({n}) s, range({frames}) f, range({size}) y, range({size}) x""")
    return make
