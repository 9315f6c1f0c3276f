from __future__ import annotations

import random
import re

import pytest

LONG = "long " * 30_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, short, very long, equal, near-equal and repeated rows, a null and a repeated id, and
    columns whose names the operators use themselves."""
    rng = random.Random(3)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    far[10::12] = ["other"] * len(far[10::12])
    rows = [
        (0, None), (1, ""), (2, " \n\t "), (3, "one two"), (4, "ONE two"), (5, base), (6, base), (6, base),
        (7, " ".join(near)), (8, " ".join(far)), (9, LONG), (None, base), (10, prose(rng, 300)),
        (11, "Çà et là\r\n  double  spaces ▁ 日本語 \U0001f600\n"), (12, prose(rng, 80) + "\n" + prose(rng, 80)),
    ]
    rows = [(d, t, "x", i, True, "y", 1.0) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, node int, kept boolean, label string, size double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
