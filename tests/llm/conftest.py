import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words over a small vocabulary, the same for a seed."""

    def make(seed: int, words: int, vocabulary: int = 300) -> str:
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(words))

    return make
