import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def pieces():
    return public_tokenizers.path("piece_bpe_32k.model")
