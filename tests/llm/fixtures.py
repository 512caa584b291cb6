"""Small corpora with the cases every operator must bear."""

import random

WORDS = "the of and to in is it on by as for was with that this from are be an or red blue stone river cloud iron wheat ocean".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def corpus(seed=0, n=60):
    """(doc_id, text) rows with nulls, empty, short and very long texts, copies and near copies."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(5, 120))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n\t "), (n + 3, "a"), (n + 4, "two words"), (n + 5, "Ünïcödé ß 漢字 😀 é" * 20)]
    rows += [(n + 10 + i, rows[i][1]) for i in range(8)]  # exact copies
    rows += [(n + 30 + i, rows[i][1] + " " + prose(rng, 3)) for i in range(10)]  # near copies
    rows += [(n + 50, prose(rng, 20000)), (n + 51, " ".join(["spam"] * 3000))]
    passage = prose(rng, 30)
    rows += [(n + 60 + i, prose(rng, 12) + " " + passage + " " + prose(rng, 9)) for i in range(5)]
    rng.shuffle(rows)
    return rows
