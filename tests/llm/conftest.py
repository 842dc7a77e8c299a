import random

import pytest

#: Function words and syllables for prose that no document of the test tables holds.
SYLLABLES = "ba ke li mo nu ra se ti vo wu za pe do fi gu".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [r.choice("the of and to in a is that for it".split()) if r.random() < 0.35 else "".join(r.choices(SYLLABLES, k=r.randint(2, 4))) for _ in range(n)]
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))


@pytest.fixture(scope="session")
def write():
    return prose


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows, extra=False):
        """A table of documents from (doc_id, text); with extra, columns of clashing names."""
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(rows, DOCUMENTS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("quality", "language", "shard", "size", "row", "key", "line", "lines", "root", "keys", "b", "h1", "extracted"):
                df = df.withColumn(c, F.lit("own"))
        return df

    return docs
