import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fieldloom.session import get_session
    s = get_session("local[4]", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="fieldloom-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf001():
    return "/root/testdata/sf0.001"


def rows(df, *cols):
    """Collect selected columns as a list of tuples ordered by doc_key (if present)."""
    if "doc_key" in df.columns:
        df = df.orderBy("doc_key", *([c for c in ["line_number"] if c in df.columns]))
    return [tuple(r[c] for c in cols) for r in df.collect()]


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_key bigint, text string")
