import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tickloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


def walk(n: int, seed: int, symbol: str = "EURUSD", step: str = "1h") -> pd.DataFrame:
    """Random-walk bars around 1.10."""
    g = np.random.default_rng(seed)
    close = 1.10 + np.cumsum(g.normal(0, 0.0005, n))
    up, down = g.uniform(0.0001, 0.001, n), g.uniform(0.0001, 0.001, n)
    open_ = np.concatenate([[1.10], close[:-1]])
    return pd.DataFrame({
        "symbol": symbol, "time": pd.date_range("2024-01-01", periods=n, freq=step), "open": open_,
        "high": np.maximum(open_, close) + up, "low": np.minimum(open_, close) - down, "close": close, "volume": 100,
    })


@pytest.fixture(scope="session")
def bars_pd():
    return pd.concat([walk(200, 42), walk(150, 7, "USDJPY")], ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, bars_pd):
    return spark.createDataFrame(bars_pd).cache()
