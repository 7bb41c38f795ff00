import os
import random

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, th long, key string, c long, "
          "h string, pos int, score double, n_removed_lines long, _key string, _gone string, size long, first string")


@pytest.fixture(autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("the of and to in is that was for with on as by at from".split()) + r.choice("abcdefgh") * r.randint(0, 3)
            + str(r.randint(0, 400)) for _ in range(n)]


def hard_rows():
    """Nulls, empty and very long texts, repeated rows and ids, ties, copies and near copies."""
    base = words(60, 1)
    near = [base[:i] + ["changed"] + base[i + 1:] for i in (5, 17, 40)]
    rows = [(1, " ".join(base), "en", "s1"), (2, " ".join(base), "en", "s2"), (2, " ".join(base), "en", "s2"),
            (3, " ".join(near[0]), "en", "s1"), (4, " ".join(near[1]), None, "s1"), (5, " ".join(near[2]), "en", None),
            (6, None, "en", "s1"), (7, "", "en", "s1"), (8, " \t\n ", None, None), (None, " ".join(words(80, 2)), "en", "s1"),
            (None, None, None, None), (9, "one two", "en", "s3"), (10, "ONE two", "en", "s3"), (9, "other text here", "en", "s3"),
            (11, " ".join(words(30000, 3)), "en", "s1"), (12, "x" * 200000, "en", "s1"), (13, "é漢字 🙂 'll it's  \n\n end ", "fr", "s4"),
            (14, "<|endoftext|> ### *** $$$ " * 40, "en", "s1"), (15, "12 34 , . !", "en", "s1")]
    return [(i, t, lang, s, None if t is None else len(t), i, 0, "k", 1, "h", 0, 0.5, 7, "k", "g", 1, "f") for i, t, lang, s in rows]


@pytest.fixture
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
