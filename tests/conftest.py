import os
import sys
import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from logvane.operators.forest import IsolationForest  # noqa: E402
from logvane.operators.scaler import BaselineScaler  # noqa: E402
from logvane.operators.scoring import Detector  # noqa: E402
from logvane.schema import FEATURE_COLUMNS  # noqa: E402
from logvane.session import build_session  # noqa: E402

TESTDATA = Path(os.environ.get("TESTDATA_DIR", "/root/testdata")) / "sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.sql.maxMetadataStringLength": "10000",
            "spark.sql.debug.maxToStringFields": "1000",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tests-warehouse-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def testdata():
    if not TESTDATA.exists():
        pytest.skip("test tables are not available")
    return str(TESTDATA)


def normal_frame(rows: int, seed: int = 42) -> pd.DataFrame:
    values = np.random.default_rng(seed).normal(size=(rows, len(FEATURE_COLUMNS)))
    return pd.DataFrame(values, columns=FEATURE_COLUMNS).assign(row=range(rows))


@pytest.fixture(scope="session")
def detector(spark):
    """Fitted on 500 standard normal rows, like a quiet benign baseline."""
    benign = spark.createDataFrame(normal_frame(500))
    scaler = BaselineScaler().fit(benign)
    forest = IsolationForest(["row"], feature_names=FEATURE_COLUMNS).fit(scaler.transform(benign))
    return Detector(scaler, forest)
