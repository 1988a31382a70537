import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from data_llm import SCHEMA, odd_rows  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of all awkward kinds."""
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocabulary_file():
    tokenizers = pytest.importorskip("public_tokenizers")
    return str(tokenizers.path("byte_bpe_50k.json"))
