"""Documents that every operator has to stand: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOWELS = "aeiou"


def word(rng, letters="bcdfghlmnprst"):
    return "".join(rng.choice(letters) + rng.choice(VOWELS) for _ in range(rng.randint(1, 3)))


def prose(rng, words):
    out = [word(rng) for _ in range(words)]
    return " ".join(w.capitalize() if i % 12 == 0 else w + ("." if i % 12 == 11 else "") for i, w in enumerate(out))


def rows(seed=3):
    rng = random.Random(seed)
    base = [prose(rng, 60) for _ in range(20)]
    out = [(i, t, "en" if i % 2 else "fr", "src0" if i % 3 else "src1", len(t)) for i, t in enumerate(base)]
    shared = "A Line That Many Hold"
    out += [(100 + i, f"{prose(rng, 30)}\n  {shared.swapcase() if i % 2 else shared}\t\n{prose(rng, 20)}", "en", "src0", 1) for i in range(12)]
    out += [(200, None, "en", "src0", None), (201, "", "fr", None, 0), (202, "   \n\t\n", None, "src0", 6), (203, "12345 !!! ...", "en", "src0", 13)]
    out += [(300 + i, base[0], "en", "src0", len(base[0])) for i in range(3)]
    out += [(0, base[0], "en", "src1", len(base[0])), (None, base[1], None, None, None), (None, base[1], None, None, None)]
    out += [(400, "\n".join(prose(rng, 40) for _ in range(200)), "fr", "src0", 0), (401, "x" * 70_000, "en", "src0", 70_000), (402, "é😀 ￿ ıİẞ\r\n\x0b\x1c\x85", "fr", "src0", 9)]
    return out


def frame(spark, seed=3, extra=True):
    """The rows, with columns whose names operators themselves use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(seed), SCHEMA)
    names = ("n_lines", "kept_text", "lang_pred", "score", "fp", "rep", "at", "key", "row", "t1", "id", "tie", "batch", "Line") if extra else ()
    return df.withColumns({n: F.lit(n) for n in names})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
