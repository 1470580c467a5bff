import pytest

from facetline.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 2, {"spark.default.parallelism": "2", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
