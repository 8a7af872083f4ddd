import random

import pytest
from pyspark.sql import Row

from archivemill.llm.shared import prepared

WORDS = "the of and in that with for on as by at from which this or an are was be it".split()


@pytest.fixture(autouse=True)
def _prepared(spark):
    prepared(spark)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    """Invented lines of words."""
    pick = random.Random(seed)
    words = [pick.choice(WORDS) if pick.random() < 0.3 else f"w{pick.randrange(vocabulary)}" for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns with clashing names."""
    long = prose(1, 60_000)
    texts = [None, "", " \n\t ", "x", long, long, prose(2, 80), prose(2, 80), "né ö %% <b>\r\n", None]
    rows = [
        Row(doc_id=i if i != 9 else None, text=t, lang=None, source="s", n_chars=None, kept=True, sign=b"x", score=1.5,
            path="a", n_words="w", shard=None, n_tokens=3, vector=[1], key="k", items={"a": 1})
        for i, t in enumerate(texts)
    ]
    rows.append(rows[6])
    schema = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, sign binary, score double, "
        "path string, n_words string, shard int, n_tokens bigint, vector array<int>, key string, items map<string, int>"
    )
    return spark.createDataFrame([tuple(r) for r in rows], schema)
