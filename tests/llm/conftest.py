import random
import re

import pytest

LOWER = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    """The smallest documents and rows made to be awkward, with extra columns of clashing names."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))
    base = [word() for _ in range(60)]
    rows = [None, "", " \n\t ", "one", "One two three", "a b c d e", "A B  C\tD\nE", "x " * 30, "#$ % | <>", "Ünï cødé ñ 東京 🎉 " * 4]
    rows += [" ".join(base), " ".join(base).upper(), "\n".join(base), " ".join(base[:50] + [word() for _ in range(4)]), " ".join(base + ["tail"])]
    rows += [" ".join(word() for _ in range(20_000)), "same line here\n" * 12 + "other", "a\x1cb\x1d c\x85d\xa0e f\u2028g <|endoftext|> h's 'tis"]
    rows += ["mail Bob.x+1@ex-ample.co.uk, ip 10.0.0.255 not 1.2.3.999 or 1.2.3.4.5", "card 4111 1111 1111 1111 tel +1 (555) 010-9999 @ a@b", "café 4111-1111-1111-1111, é@x.com +44 20 7946 0958"]
    got = [(10_000_000 + i, t, rng.choice(["de", None]), rng.choice(["src0", "src1", None]), len(t or "")) for i, t in enumerate(rows)]
    made = spark.createDataFrame(got, "doc_id long, text string, lang string, source string, n_chars long")
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = real.unionByName(made)
    return both.withColumns({"size": F.lit("x"), "key": F.lit(1), "n": F.lit(2), "bucket": F.lit(None).cast("string"), "stratum": F.lit(3)}).cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
