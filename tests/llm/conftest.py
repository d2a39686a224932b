import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_docs import documents, odd_texts  # noqa: E402


@pytest.fixture(scope="session")
def texts():
    return odd_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return documents(spark, texts).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
