import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from poolspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def separable(spark):
    """Two targets, 120 rows each, four features; the label follows the first feature with noise."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = []
    for t in ("A", "B"):
        x = rng.normal(size=(120, 4))
        y = (x[:, 0] + 0.3 * rng.normal(size=120) > 0).astype(int)
        rows += [(t, int(i), [float(v) for v in x[i]], int(y[i])) for i in range(120)]
    return spark.createDataFrame(rows, "target string, mol_id bigint, features array<double>, label int").cache()
