import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size long, part int, key string"


def _rows():
    """Nulls in any column, empty and long texts, copies, near copies, ties and repeated rows; columns with clashing names."""
    words = [f"w{i}" for i in range(400)]
    near = " ".join(words[:200])
    texts = {
        1: near, 2: near, 3: near + " tail", 4: None, 5: "", 6: " \t\n", 7: "the one", 8: "the one", 9: "THE ONE", 10: "!!! $$$ %%%",
        11: " ".join(words) * 40, 12: "Der Hund und die Katze sind in dem Haus mit der Frau.", 13: "The dog and the cat are in the house with the woman.",
        14: "x" * 5000, 15: "12345 678", 16: "日本語 テスト", 17: "a  b é", 18: " ".join(words[200:]), 19: " ".join(reversed(words)),
    }
    rows = [(d, t, ("de" if d == 12 else "en") if d % 5 else None, f"s{d % 3}" if d % 4 else None, None if t is None else len(t)) for d, t in texts.items()]
    rows += [(20 + i, f"the quick brown number {i} runs over the lazy field {i * i}", "en", "s1", 40) for i in range(30)]
    rows += [(13, texts[13], "en", "s1", 1), (None, "no id at all", "en", "s0", 12), (None, None, None, None, None)]
    return [(*r, 7, 8, 9, "k") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
