import contextlib
import io
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check import session  # noqa: E402

from trialforge.operators import skew  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("8")


@pytest.fixture
def small_limits(spark):
    """Send groups of more than a few rows down the hot-group path."""
    spark.conf.set(skew.HOT_ROWS_CONF, "7")
    yield
    spark.conf.unset(skew.HOT_ROWS_CONF)


@pytest.fixture(scope="session")
def plan():
    def text(df, mode: str = "formatted") -> str:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain(mode)
        return out.getvalue()

    return text


def values(df, *columns):
    """Rows as sorted tuples of the columns."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
