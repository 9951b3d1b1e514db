import pytest

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def texts() -> list:
    """Nulls, empty and blank texts, a long text, copies, near copies, a shared passage, personal data."""
    import random

    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)) + "."
    passage, base = prose(60), prose(80)
    words = base.split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    out = [None, "", " \n\t ", "one two", "One  TWO", base, base, near, base.upper(), prose(3000), passage, prose(30) + "\n" + passage + "\n" + prose(30)]
    out += [prose(20) + f" write to Ann.{i}@mail.example.com or 10.0.0.{i} now, +49 (30) 1234567{i}, 4111 1111 1111 1111 bye" for i in range(4)]
    out += [prose(5 + i) + " secretword agent7@corp.example.org keeps " + prose(9) for i in range(5)]
    out += ["a\nb\na\nb c d e f g h i j", "### $$$ %%% &&& " * 30, "x" * 5000, "0" * 3000, "é à ü ñ — “q” don't we'll", "no break space   y"]
    return out + [prose(rng.randrange(5, 200)) for _ in range(30)]


@pytest.fixture(scope="session")
def rows():
    out = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())]
    return [*out, out[5], (None, "a row without id", "en", "s0", 16)]


#: Columns whose names the operators use inside.
CLASH = ("row", "base", "terms", "class", "sig", "block", "n_words", "kept", "file", "part", "words", "h", "doc", "ids")


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.select("*", *[F.lit(1).alias(c) for c in CLASH])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
