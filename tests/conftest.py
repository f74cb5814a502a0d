import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from playtrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 4)


@pytest.fixture(scope="session")
def make_steps(spark):
    """Steps of the given sessions: {(game, session): "abc" or [activities]}."""

    def build(sessions):
        rows = [(g, s, i, str(a), i * 1000, i) for (g, s), path in sessions.items() for i, a in enumerate(path)]
        return spark.createDataFrame(rows, "game_id string, session_id string, id long, type string, t_ms long, pos long")

    return build
