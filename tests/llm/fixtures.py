"""Small tables with the cases that every operator must stand."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("the", "on", "er", "tion", "and", "in", "re", "ou") for b in ("ta", "lo", "mi", "ser", "nd", "q", "vé", "x1")]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus(n=60, seed=3):
    """(doc_id, text) with exact and near copies, nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    texts = [prose(r, r.randint(1, 160)) for _ in range(n)]
    base = prose(r, 120)
    for k in range(12):
        words = base.split()
        for _ in range(k):
            words[r.randrange(len(words))] = f"edit{r.randrange(9999)}"
        texts.append(" ".join(words))
    texts += [base] * 7 + [texts[0], texts[0].upper(), None, None, "", " \n\t ", "one two three", "one  two\nTHREE", "x" * 3000, prose(r, 6000), "\x00nul \x1f words é"]
    rows = list(enumerate(texts))
    return rows + [rows[5]]  # a repeated row


def frame(spark, rows, extra=False):
    made = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], SCHEMA)
    if extra:  # names that the operators use inside
        for name in ("id", "c", "n", "tokens", "size", "kind", "shard", "slot", "score", "spans", "_bucket"):
            made = made.withColumn(name, made.doc_id.cast("string"))
    return made
