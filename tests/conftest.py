import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallymill.session import build_session  # noqa: E402

MOVIES = (
    "movie_id bigint, title string, original_title string, year int, rating_score double, "
    "rating_count bigint, genres string, countries string, directors string, collect_count bigint"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": 8,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def dirty(spark):
    """Eleven rows, one defect each where a cleaning step should notice it."""
    nan = float("nan")
    return spark.createDataFrame(
        [
            (7, "Early", "Early", 1871, 6.4, 140, "drama", "US", "Fay", 7),
            (8, "First", "First", 1888, 6.4, 140, "drama", "US", "Fay", 8),
            (1, "Harbour", "Harbour", 1990, 8.2, 1000, "drama/crime", "FR", "Abel", 10),
            (5, "Crowd", "Crowd", 2014, 9.4, 61_500_000, "comedy", "JP", "Eli", 99),
            (2, "Lantern ", " Lantern", 2001, 7.2, 3000, "comedy", "IT/FR", "Bea/Cy", 20),
            (3, "Void", None, None, -2.5, None, None, None, None, None),
            (1, "Harbour", "Harbour", 1990, 8.2, 1000, "drama/crime", "FR", "Abel", 10),
            (None, "Unscored", "Unscored", 2010, nan, 200, "", "US", "Gus", 8),
            (6, None, "Untitled", 2016, 7.8, 7200, None, "SE", None, 30),
            (2, "Lantern", "Lantern", 2001, 7.2, 4000, "comedy", "IT/FR", "Bea/Cy", 20),
            (4, "Dim", "Dim", 2006, 0.7, 35, "drama", "US", "Dee", 5),
        ],
        MOVIES,
    )
