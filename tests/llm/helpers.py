"""Documents with every case that the operators define."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, bucket string, h string, keep string"

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def prose(seed: int, n: int) -> str:
    state, out = seed * 7919 + 17, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state >> 8 & 15] + str(state >> 16 & 63))
    return " ".join(out)


def rows():
    """Nulls in each column, empty, blank, very long, tied and repeated rows; clashing extra columns."""
    long = prose(99, 30_000)
    out = [
        (1, prose(1, 120), "en", "a", None, "x", "y", "z"),
        (2, prose(1, 120), "en", "a", 5, None, None, None),
        (3, None, "en", "a", 10, "x", "y", "z"),
        (4, "", "en", "b", 0, "x", "y", "z"),
        (5, " \n\t ", None, None, 4, "x", "y", "z"),
        (6, long, "fr", "b", len(long), "x", "y", "z"),
        (7, prose(7, 60), "de", None, None, "x", "y", "z"),
        (8, prose(8, 2), "en", "b", 12, "x", "y", "z"),
        (8, prose(8, 2), "en", "b", 12, "x", "y", "z"),
        (None, prose(1, 120), "en", "c", 700, "x", "y", "z"),
        (9, prose(1, 119) + " changed", "en", "c", 700, "x", "y", "z"),
        (10, "!!! ... ???", "es", "c", 11, "x", "y", "z"),
    ]
    return out


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def empty(spark):
    return docs(spark, [])
