import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    """n invented words that depend on the seed alone."""
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append("".join(chr(97 + (x >> s) % 26) for s in (20, 27, 34, 41, 48)))
    return " ".join(out)


PASSAGE = words(99, 60)
#: Nulls, empty and blank texts, ties, repeated rows, copies and near copies, a long text.
ROWS = [
    (1, words(1, 120), "en", "a", 1),
    (2, words(1, 120), "en", "a", 1),
    (3, words(1, 120).replace(" ", "\n"), "en", None, 1),
    (4, words(1, 119) + " changed", "en", "b", 1),
    (5, None, None, None, None),
    (6, "", "en", "b", 0),
    (7, " \t\n", "en", "b", 3),
    (8, words(2, 80) + " " + PASSAGE + " " + words(3, 80), "en", "c", 1),
    (9, words(4, 30) + " " + PASSAGE, "fr", "c", 1),
    (9, words(4, 30) + " " + PASSAGE, "fr", "c", 1),
    (10, "one two", "en", "d", 7),
    (11, "ONE  two", "en", "d", 8),
    (None, words(6, 40), "en", "d", 1),
    (None, words(6, 40), "en", "d", 1),
    (12, "x" * 30_000 + " " + words(7, 6_000), "en", "d", 1),
    (13, "Écrivez à a.b+c@mail.example.com ou +49 (30) 1234-5678, ip 10.0.0.255, carte 4111 1111 1111 1111.", "fr", "e", 1),
    (14, "1.2.3.4.5.6.7.8 999.1.1.1 @x.y a@b c@@d.e " + "9" * 500, "en", "e", 1),
    (15, "東京 ▁ \u0000 é̂ 😀", "ja", "e", 1),
]


@pytest.fixture(scope="session")
def docs(spark):
    from tabforge.llm.common import prepare
    prepare(spark)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    from tabforge.llm.common import prepare
    prepare(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide_docs(docs):
    """Extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    return docs.withColumns({c: F.lit(7) for c in ("rid", "sig", "n", "score", "body", "shard", "hub", "start", "y", "f", "base", "terms",
                                              "key", "root", "item", "doc", "hit_id")})
