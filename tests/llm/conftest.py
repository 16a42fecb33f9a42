"""Fixtures of the training-data tests; session and path come from the parent folder."""

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()

#: Names that the operators use for columns of their own.
CLASHING = (
    "_accepted", "_bucket", "_digest", "_doc", "_fp", "_id", "_kept", "_key", "_tie", "at", "group", "id", "label", "line", "n", "node",
    "number", "pos", "rank", "row", "start", "word",
)


@pytest.fixture(scope="session")
def prose():
    """Seeded text of n words."""

    def make(n, seed):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def docs(spark, prose):
    """A documents table of (doc_id, text) pairs, with clashing extra columns."""

    def make(rows):
        full = [(k, t, "en", f"src{(k or 0) % 3}" if k is None or k % 5 else None, len(t or ""), 1, 2, "x", *["y"] * len(CLASHING)) for k, t in rows]
        clashing = ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame(
            full, f"doc_id long, text string, lang string, source string, n_chars long, size int, fp int, `key` string, {clashing}"
        )

    return make


@pytest.fixture(scope="session")
def odd(prose):
    """Nulls, empties, ties, repeated rows, a long text and one without blanks."""
    same = prose(40, 1)
    return [
        (1, same), (2, same), (2, same), (3, None), (4, ""), (5, "  \n\t "), (6, "x"), (7, prose(30_000, 2)),
        (8, "y" * 5_000), (None, prose(20, 3)), (None, prose(20, 3)), (9, "Ünï Çödé ÉÉ é"), (10, "\n".join([same, "", same])),
    ]
