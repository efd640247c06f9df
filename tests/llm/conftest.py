import random

import pytest

WORDS = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta9", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "日本", "tau", "you"]


def prose(r, n, lines=True):
    out = []
    for i in range(n):
        out.append("".join(r.choice(WORDS) for _ in range(r.randint(1, 3))))
    text = " ".join(out)
    if lines:
        text = "".join(c if c != " " or r.random() > 0.06 else "\n" for c in text)
    return text


def nasty_texts():
    """Texts with copies, near copies, shared passages and lines, periods, emptiness."""
    r = random.Random(11)
    base = [prose(r, 120) for _ in range(12)]
    shared = prose(r, 60, False)
    out = [None, "", " ", "\n\n", "one", "one two three", "One two, three!", "a" * 1000, "ab" * 700, " " * 500, "x" * 99, "y" * 100, "y" * 101]
    for t in base:
        out.append(t)
        out.append(t)
        words = t.split(" ")
        words[r.randrange(len(words))] = "changed"
        out.append(" ".join(words))
        out.append(prose(r, 20) + "\n" + shared + "\n" + prose(r, 20))
        out.append(prose(r, 15) + " " + shared[: r.randint(100, 300)] + prose(r, 5))
    words = base[0].split(" ")
    for i in range(12):  # a group of near copies
        w = list(words)
        w[(i * 7) % len(w)] = f"edit{i}"
        out.append(" ".join(w))
    out.append(prose(r, 12000))
    out.append(out[-1][2000:9000])
    out += ["the same line\n" * 5, "the same line\nthe same line again and again", "x <|endoftext|> y" * 3, "it's we'll  12 34 \t z"]
    return out


@pytest.fixture(scope="session")
def texts():
    return nasty_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids that aren't in order of rows, and columns whose names the operators use themselves."""
    n = len(texts)
    rows = [((i * 37) % n, t, "en", "s", 1, "z", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, w int").repartition(3).cache()


@pytest.fixture(scope="session")
def by_id(texts):
    n = len(texts)
    return {(i * 37) % n: t for i, t in enumerate(texts)}


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
