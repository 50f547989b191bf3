"""Small documents with the cases that operators must stand."""

import random

SCHEMA = "doc_id bigint, text string, n_lines string, rank int"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed=0, n=60):
    """Prose, exact and near copies, shared lines and passages, short, empty, blank and null texts, repeated rows."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = []
    for i in range(n):
        lines = [prose(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 5))]
        if i % 5 == 0:
            lines.append("the shared line of many words that comes again")
        if i % 7 == 0:
            lines[0] = f"{lines[0]} {passage} {prose(rng, 8)}"
        rows.append("\n".join(lines))
    base = prose(rng, 120)
    for k in range(12):
        words = base.split()
        for _ in range(k % 4):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append(" ".join(words))
    rows += [rows[3], rows[3], rows[4].upper(), "", " \t\n", None, "one", "One", "one two three four", "one two three four five", "a b c d e f g h", "a b c d e f g h i", "é ü 日本 😀 x", "y" * 5000, prose(rng, 3000)]
    out = [(i, t, "clash", 1) for i, t in enumerate(rows)]
    rng.shuffle(out)
    return out + [out[0], out[1], (None, "text without an id", None, None), (None, None, None, None)]
