import random

import pytest

WORDS = "the of and to in is it that for was on are with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ly", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text): nulls, empties, very long, repeated, near copies, ties, odd characters."""
    long = prose(1, 4000)
    near = prose(2, 120).split()
    rows = [(0, None), (1, ""), (2, "   "), (3, "\n\n"), (4, "one"), (5, "one"), (6, long), (7, long), (8, "A" * 5000), (9, prose(3, 90)), (10, prose(3, 90)), (10, prose(3, 90)), (11, "É ß ñ " + prose(4, 60)), (None, prose(5, 60)), (12, "\x00 tab\there \x1c \x85 end"), (13, "🎉" * 900)]
    rows += [(20 + i, " ".join([*near[:i], "changed", *near[i + 1 :]])) for i in range(0, 30, 3)]
    rows += [(60 + i, f"own line {i} of this document\n  Shared Line That Recurs Often \t\n" + prose(50 + i, 10)) for i in range(4)]
    rows += [(70 + i, prose(80 + i, 30) + " " + prose(99, 150) + " " + prose(90 + i, 30)) for i in range(3)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, awkward):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, __id int, h1 string, score string, k1 int, kept int"
    rows = [(i, t, None, "s", None, 7, 7, "x", "y", 1, 2) for i, t in awkward]
    return spark.createDataFrame(rows, schema)
