import random

import pytest

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, size long, target string"


def hard_rows():
    """Nulls, empties, ties, repeated rows, a long text, copies and near copies; extra columns named like internal ones."""
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, text(rng.randint(1, 60)), "en", f"s{i % 3}", 1, "t") for i in range(60)]
    base = text(80)
    for i in range(60, 90):  # near copies of one text, one word changed in some
        words = base.split()
        if i % 3:
            words[i % 80] = "changed" + str(i)
        rows.append((i, " ".join(words), "en", "s0", 1, "t"))
    rows += [(90 + i, "the same\n  line\tof all\n" + base, "en", "s1", 1, "t") for i in range(5)]
    rows += [(95, None, None, None, None, None), (96, "", "en", "s2", 1, "t"), (97, " \n\t ", "en", None, 1, "t"), (98, text(5000), "en", "s2", 1, "t")]
    rows += [(99, "a repeated row of the table", "en", "s1", 1, "t")] * 3
    rows += [(None, "a row without an id", "en", "s1", 1, "t"), (100, "é ü – ñ 漢字 </s>[INST]", "de", "s9", 1, "t")]
    rows += [(101, "a\u00a0b c\u2003d\x1ce \\x", "en", "s9", 1, "t")]
    return rows


@pytest.fixture(scope="session")
def hard(spark, tmp_path_factory):
    """The hard rows as a parquet table in several files, so that reads are alike each time."""
    path = str(tmp_path_factory.mktemp("hard") / "documents.parquet")
    spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
