import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from gleanery.session import session

    import __spark_entry__ as entry

    s = session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    s.sparkContext.setLogLevel("OFF")
    entry._ready(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def values(spark):
    """Evaluate one Column over a list of inputs, in order."""
    from pyspark.sql import functions as F

    def run(fn, items, schema="string"):
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(items)]
        width = len(rows[0]) - 1
        names = [f"c{k}" for k in range(width)]
        df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} {schema}" for n in names))
        return [r["v"] for r in df.select("i", fn(*[F.col(n) for n in names]).alias("v")).orderBy("i").collect()]

    return run


@pytest.fixture
def parse(spark):
    """HTML texts -> node table, page ids in order."""
    from gleanery.session import written
    from gleanery.sources.nodes import parse_pages

    def run(*htmls):
        pages = spark.createDataFrame([(i, f"http://h{i}.example.com/a/b", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
        return pages, written(parse_pages(pages), "test-nodes")

    return run
