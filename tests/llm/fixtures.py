"""Rows with the cases every operator must bear, and plain counterparts of the operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, target string"


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long_text = " ".join(f"word{i % 977} tail{i}" for i in range(20_000))
    base = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s1"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "s1"),
        (3, None, "en", "s1"), (4, "", None, "s2"), (5, " \t\n ", "fr", None), (6, "one", "fr", "s2"), (7, "Two  words", "de", "s2"),
        (8, long_text, "en", "s3"), (9, long_text + " end", "en", "s3"), (10, "mail me at jo@example.com or +1 (555) 123-4567 now please, all of you out there", None, None),
        (None, "a row without an id but with a text of more than ten words in it", "en", "s1"),
        (12, "same id twice, the first of two texts that share nothing else with it", "en", "s4"), (12, "otra cosa distinta del todo para el mismo identificador de antes y ya", "es", "s4"),
        (14, "a part of an address may be long: 1.2.3." + "0" * 6000 + "1 and 1.2.3." + "9" * 6000, "en", "s5"), (15, "one text<|endoftext|>another text of more than ten words that follow an end marker", "en", "s5"),
        (13, "naïve café — “quotes” 漢字 emoji 😀 mixed   spaces and more of the same kind", "fr", "s5"),
    ]
    rows = [(*r, None if r[1] is None else len(r[1]), 7, False, "x") for r in base]
    return rows + [rows[0]]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def some_texts(n: int, seed: int = 5) -> list[tuple[int, str]]:
    """Random texts with exact copies, near copies and shared passages."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "ta") for b in ("ba", "do", "fi", "gu", "ha", "po", "sa")]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts: list[str] = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.45:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        else:
            w = [rng.choice(words) for _ in range(rng.randint(0, 120))]
            if rng.random() < 0.3:
                w.insert(rng.randint(0, len(w)), passage)
            texts.append(" ".join(w))
    return list(enumerate(texts))
