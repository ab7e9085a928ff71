"""Invented texts for the tests."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, size=4000):
    return ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) + str(rng.randrange(size) % 7) for _ in range(n)]


def prose(rng, n):
    return " ".join(words(rng, n))
