import random

import pytest

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(LOWER) if lower else raw).split()


@pytest.fixture(scope="session")
def documents(spark, sf):
    """(DataFrame, [(doc_id, text)]) of the smallest table."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows, odd characters, and columns whose names clash."""
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(300)]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    passage = " ".join(rng.choice(vocabulary) for _ in range(80))
    texts = [None, "", " \n\t ", "one", long, long + " end", passage, f"x {passage} y", f"A {passage}\nlonger line here\n", "Longer line here \nlonger line here\nélan ÉLAN b\n\n", "don't I'LL  12 3 İ Σ 日本語 😀 <|endoftext|>\x1c\x85", "a" * 5000, passage, "\n".join(["same long line"] * 50)]
    rows = [(k, t, None if k % 3 == 0 else f"s{k % 3}", 7, "x", [1], 0.5, "g") for k, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[1], (None, passage, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long, key string, pos array<int>, length double, id string").repartition(3), [(r[0], r[1]) for r in rows]


def thue_morse(turns):
    """The two complementary Thue-Morse words of 2**turns letters: they collide under any polynomial hash modulo 2**64."""
    x, y = "a", "b"
    for _ in range(turns):
        x, y = x + y, y + x
    return x, y


@pytest.fixture(scope="session")
def alike(spark):
    """Different words, and runs of two words, that weak hashes take for each other; ids from the ends of their range."""
    rng = random.Random(7)
    base = " ".join(f"u{rng.randrange(99)}" for _ in range(49))
    rows = []
    for turns in (10, 11):
        x, y = thue_morse(turns)
        rows += [f"{base} {x}", f"{base} {y}", f"{base} {y}", x, y, f"p {x} r z p {y} r", f"q {x} r", f"q {y} r", f"{x} {x} {x} {x}", f"{y} {y} {y} {y}"]
    for turns in (6, 7, 8):
        x, y = (" ".join(w) for w in thue_morse(turns))
        rows += [x, y, f"{x} {base}", f"{y} {base}", f"{y} {base}"]
    rows += [" ".join(rng.choice("ab") for _ in range(120)) for _ in range(30)]
    rows = list(enumerate(rows, 1)) + [(2**63 - 2, base + " tail"), (-1, base + " tail"), (-(2**63), "x " + base)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows


@pytest.fixture(scope="session")
def empty(odd):
    return odd[0].limit(0)
