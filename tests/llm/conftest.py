import random

import pytest
from llm_data import SCHEMA

@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def make_docs(spark):
    def make(texts, sources=None, ids=None):
        rows = [((ids or range(len(texts)))[i], t, None, (sources or ["a"] * len(texts))[i], None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make
