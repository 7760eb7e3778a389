import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, node string, key int, root double, shard string, "
    "score string, line array<int>, term string, `__llm_note` string"
)


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(WORDS[(x >> 33) % len(WORDS)] + str((x >> 50) % 97))
    return " ".join(out)


def texts() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, copies, repeated rows and near copies."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, prose(2, 80), None, "b"),
        (5, None, "en", "a"), (6, "", "en", None), (7, " \n\t \n", "de", "c"), (None, prose(3, 60), "de", "c"),
        (None, prose(3, 60), "de", "c"), (8, prose(4, 90), "de", None), (8, prose(5, 70), "de", "b"),
        (9, prose(6, 70), "en", "b"), (9, prose(6, 70), "en", "b"), (10, "###", None, None), (11, "word", "en", "a"),
        (12, prose(7, 30_000), "en", "d"), (13, "\U0001f600 Ünï é́ " + prose(8, 55), "fr", "d"),
        (14, "one two three\n" * 40 + "Four FIVE six", "en", "d"), (15, "%% && ## " * 60, "en", "a"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(*r, len(r[1]) if r[1] else None, "x", 1, 0.5, "s", "t", [1], "u", "v") for r in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
