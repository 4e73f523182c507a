"""Small tables with everything in them that a corpus may hold, and the plain versions that operators are held against."""

from __future__ import annotations

import random
import re

WORDS = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuvwéü") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


PASSAGE = prose(1, 130)

#: doc_id, text, lang, source, n_chars: nulls, empties, ties, repeated rows, odd white space, copies, a shared passage, a long text.
TEXTS = [
    (1, f"{prose(2, 30)} {PASSAGE} {prose(3, 20)}"),
    (2, f"{prose(4, 10)} {PASSAGE} {prose(5, 60)}"),
    (3, f"{prose(4, 10)} {PASSAGE} {prose(5, 60)}"),
    (4, f"{prose(4, 10)} {PASSAGE} {prose(5, 60)}".upper().swapcase()),
    (5, None),
    (6, ""),
    (7, " \t\n "),
    (8, "One"),
    (9, "a  b\n\n c don't I'll we've <|endoftext|> x!<|endoftext|>"),
    (10, "日本語 テスト 😀 é" * 3),
    (11, "z" * 3000),
    (12, "na " * 900),
    (13, prose(6, 4000)),
    (14, f"{prose(7, 50)} {PASSAGE}"),
    (14, f"{prose(7, 50)} {PASSAGE}"),
    (15, "one"),
    (None, f"{prose(8, 5)} {PASSAGE} {prose(9, 4)}"),
    (None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept string, id string, component_id string"


def documents(spark, texts=None):
    """Extra columns have the names that operators use themselves."""
    rows = [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}" if i != 6 else None, len(t or ""), "x", "y", "z", "w") for i, t in (TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(text):
    return WORDS.findall(text or "")
