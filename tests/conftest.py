from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gridpulse.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def stamp():
    from datetime import datetime, timedelta

    def at(hours: int, start: str = "2024-01-01 00:00:00") -> datetime:
        return datetime.fromisoformat(start) + timedelta(hours=hours)

    return at


@pytest.fixture
def hours_frame(spark, stamp):
    """(grid_id, hour offset, total[, internet]) tuples to a minimal hourly frame."""

    def build(rows):
        data = [(g, stamp(h), float(t), float(rest[0]) if rest else 0.0) for g, h, t, *rest in rows]
        schema = (
            "grid_id int, timestamp timestamp_ntz, total_activity double, internet_activity double"
        )
        return spark.createDataFrame(data, schema)

    return build
