import random

import pytest

SCHEMA = "position_id long, note string, ticker string, entry_at string, n_words int, spans string, row int"


def made_notes(seed=3, n=60):
    """Notes on positions: copies, near copies, shared blocks, odd texts; (position_id, note)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ba", "lo", "om", "ter", "in", "que", "é", "ß"]) for _ in range(r.randint(1, 4)))
    line = lambda k: " ".join(word() for _ in range(k))
    shared = [line(14) for _ in range(4)]
    texts = [None, "", "  \n \t", "one", "one two", "one two", "a" * 3000, "x y " * 400, "\n\n" + shared[0] + "\n"]
    while len(texts) < n:
        kind = r.random()
        if kind < 0.2 and texts:
            texts.append(r.choice(texts))
        elif kind < 0.4:
            base = (r.choice([t for t in texts if t and len(t) > 200] or [line(60)])).split(" ")
            base[r.randrange(len(base))] = word()
            texts.append(" ".join(base))
        else:
            lines = [line(r.randint(3, 18)) for _ in range(r.randint(2, 7))]
            lines.insert(r.randrange(len(lines)), r.choice(shared))
            texts.append(r.choice(["\n", "\n\n", ".\n"]).join(lines))
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return made_notes()


@pytest.fixture(scope="session")
def positions(spark, rows):
    """Extra columns have names that results use."""
    return spark.createDataFrame([(k, t, "S1", None, 7, "x", 5) for k, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """A null key, a row that occurs twice, and one key with two notes."""
    long_ = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi"
    return spark.createDataFrame([(None, long_, *[None] * 5), (5, long_, *[None] * 5), (5, long_, *[None] * 5), (5, None, *[None] * 5),
                                  (9, long_, *[None] * 5), (9, "short note", *[None] * 5)], SCHEMA)
