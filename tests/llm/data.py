"""Small tables with the cases every corpus operator must bear."""

import random

WORDS = "alder birch cedar dogwood elm fir gum hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "wood", "leaf", "y"]) for _ in range(n))


def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, ties and columns that clash with results."""
    rng = random.Random(3)
    long = prose(rng, 60_000)
    text = prose(rng, 80)
    rows = [
        (1, text, "en", "a", 5),
        (1, text, "en", "a", 5),
        (2, text, "en", None, None),
        (3, None, None, "b", 0),
        (4, "", "en", "b", 0),
        (5, "   \n\t ", "en", "b", 3),
        (None, prose(rng, 40), "en", "c", 1),
        (None, None, None, None, None),
        (6, long, "en", "a", 9),
        (7, "x" * 300_000, "en", "a", 9),
        (8, "one two", "en", "c", 7),
        (9, "one two", "en", "c", 7),
        (10, "naïve CAFÉ \U0001f600 日本語 mixed", "fr", "z", 7),
    ]
    extra = "size int, shard string, score string, rank int, class_id string, n_tokens string, target string, hash int"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + extra
    return spark.createDataFrame([(*r, 1, "s", "t", 2, "c", "n", "g", 4) for r in rows], schema)


def empty(spark):
    return awkward(spark).limit(0)
