import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from reviewloom.session import build_session

    session = build_session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def root():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small_train(spark):
    """4 users x 5 items, one repeated pair, one user who rates everything alike."""
    rows = [
        ("u1", "a", 5.0), ("u1", "b", 3.0), ("u1", "c", 4.0), ("u1", "a", 4.0),
        ("u2", "a", 4.0), ("u2", "d", 2.0), ("u3", "b", 1.0), ("u3", "c", 5.0), ("u3", "e", 2.0),
        ("u4", "d", 3.0), ("u4", "e", 3.0),
    ]
    rows = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "review_id long, user_id string, item_id string, rating double").cache()
