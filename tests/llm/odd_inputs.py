"""Rows that every operator has to take, and made-up prose."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, n long, `od.d` string"


def prose(seed: int, words: int, letters: str = "aeinorst") -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 8))) for _ in range(words))


def odd_rows():
    base = prose(1, 120)
    texts = [
        base,
        base,
        base.replace(base.split()[60], "Zebra", 1),
        None,
        "",
        "   \n\t ",
        "word",
        "ab" * 3000,
        "ünï cödé — 漢字 　 😀 text",
        prose(2, 3000),
        "line one here\n" * 30,
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], None, len(t) if t is not None else None, "k", 7, 1, "x") for i, t in enumerate(texts)]
    rows.append(rows[0])  # a repeated row
    rows.append((None, "a row without a key " * 5, "en", "s", 3, None, None, None, None))
    return rows
