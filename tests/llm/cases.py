"""Odd rows that every operator takes: nulls, empty and long texts, repeats, ties and columns with clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, node string, spans string, row int, id int, label string"
WORDS = "the quick brown fox jumps over the lazy dog while seven wise owls watch from a tall old tree near quiet water".split()


def prose(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", str(rng.randint(0, 9))]) for _ in range(n))


def rows():
    long_text = prose(1, 20_000)
    base = [
        (1, prose(2, 60), "en", "a"),
        (2, prose(2, 60), "en", "a"),
        (2, prose(2, 60), "en", "a"),
        (3, "", "en", "b"),
        (4, None, None, None),
        (None, prose(3, 40), "en", "b"),
        (None, None, None, "b"),
        (5, long_text, "en", "a"),
        (6, " \t\n ", "de", None),
        (7, "one", "de", "c"),
        (8, "😀 é́ ß İΣ \x1c <|endoftext|> 'tis", "fr", "c"),
        (9, "12345 67", "fr", "c"),
        (10, prose(2, 60) + " tail", "en", "a"),
    ]
    return [(*r, None, 0.5, 7, "n", "s", 1, 2, "l") for r in base]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
