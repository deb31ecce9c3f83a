import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    x, out = seed * 7919 + 17, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[x % 20] + WORDS[x // 20 % 20])
    return " ".join(out)


@pytest.fixture(scope="session")
def prose_of():
    return prose


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, one-word and very long texts, repeated rows, null ids, and extra columns with the operators' own names."""
    a, b = prose(1, 120), prose(2, 30_000)
    rows = [
        (1, None, "en", "s0"), (2, "", "en", "s0"), (3, " \n\t ", None, "s1"), (4, "word", "en", None), (5, a, "en", "s0"), (5, a, "en", "s0"),
        (6, a, "fr", "s0"), (7, b, "fr", "s1"), (None, a, "en", "s0"), (8, a + " more words", "en", "s0"), (9, "!!! 123 ???", "de", "s2"), (10, "Ünïcödé \U0001f600 text", "de", "s2"),
    ]
    extra = ["score", "rank", "node", "block", "key", "n", "copy", "rate", "range", "held_out_", "words", "lang_pred", "p_toxic", "item_id", "hash", "text_key", "_order", "comp", "copies", "phrase_rate", "predicted", "to", "parsed", "own_source", "own_rate", "__p", "__rate"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(extra)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
