"""Small tables that hold nulls, empty and long texts, repeats and clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, n_words string"


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


def odd_rows(seed: int = 3, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \t\n", "one", "Two words", "a b c", "É ñ ß 日本 語", "x" * 500, "na na na na na na na na na na na na na na"]
    base = prose(rng, 300)
    texts += [base, base, base.upper(), base + " tail", "head " + base, prose(rng, 20_000), base[:900] + prose(rng, 50)]
    texts += ["same line here\n" * 30, "a  b\n\n c\t d", "#$ %& |<> *" * 8]
    texts += [prose(rng, rng.randrange(1, 200)) for _ in range(n)]
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 4}", len(t or ""), 0.5, 1, "x") for i, t in enumerate(texts)]
    return rows + [rows[9], (None, base, "en", "s1", 1, None, None, None), (None, None, None, None, None, None, None, None)]
