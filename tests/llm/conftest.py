import os
import random
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def worker_path(spark):
    env = spark.sparkContext.environment
    env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ba", "ko", "Li", "nü", "ß", "ter", "x7"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Keys and texts: nulls, empty, one word, copies, near copies, shared passages, control
    strings, odd spaces, a very long text."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    words = base.split()
    passage = sentence(rng, 60)
    near = [*words]
    near[60] = "other"
    return [
        (0, None),
        (1, ""),
        (2, " \t\n\x0b\x0c\r "),
        (3, "word"),
        (4, base),
        (5, base),
        (6, " ".join(near)),
        (7, "A  b\tc\nd e"),
        (8, "a b c d e"),
        (9, f"{sentence(rng, 20)} {passage} {sentence(rng, 30)}"),
        (10, f"{passage}\n{sentence(rng, 12)}"),
        (11, f"{passage} {passage}"),
        (12, "<|endoftext|> <|im_start|> don't İstanbul é   \x1c x\x00y 日本語 ’s 's*** 3½"),
        (13, sentence(rng, 30_000)),
        (14, "the " * 500),
        (15, "퟿\U0001f600 " * 3),
    ]
