"""Small tables and plain versions that the operators are held against."""

from __future__ import annotations

import random
import re
from contextlib import contextmanager

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return BLANK.findall(text or "")


def documents(spark, texts, start=1):
    rows = [(start + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts() -> list[str | None]:
    """Nulls, empty and blank texts, ties, one very long text, other scripts."""
    return [None, "", " \t\n ", "a", "a", "é", "漢字 かな", "…—", "x" * 5000, "word " * 30_000, "A b\x0bc\x0cd", "same text here", "same text here"]


def random_texts(seed: int, n: int, vocabulary: int = 12, longest: int = 90) -> list[str]:
    """Texts of few words, with passages that texts share, so that all kinds of repeats occur."""
    draw = random.Random(seed)
    letters = [f"w{i}" for i in range(vocabulary)]
    passages = [[draw.choice(letters) for _ in range(draw.randint(5, 45))] for _ in range(4)]
    out = []
    for _ in range(n):
        text: list[str] = []
        while len(text) < draw.randint(0, longest):
            kind = draw.random()
            if kind < 0.35:
                text += draw.choice(passages)
            elif kind < 0.45:
                text += [draw.choice(letters)] * draw.randint(1, 30)
            else:
                text += [draw.choice(letters) for _ in range(draw.randint(1, 25))]
        out.append(draw.choice([" ", "  ", "\n", "\t"]).join(text))
    return out


@contextmanager
def parallelism(spark, n):
    """How files are cut while `n` cores are alive: small files together or apart."""
    names = {"spark.sql.leafNodeDefaultParallelism": str(n), "spark.sql.files.openCostInBytes": "1024"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
