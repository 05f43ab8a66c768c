"""Small random corpora with the awkward cases every operator must survive."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, unit string, rid string, marks string"


def prose(rng, n, words=900):
    return " ".join(f"w{min(int(rng.paretovariate(0.6)), words)}" for _ in range(n))


def rows(seed=1, n=60):
    """Documents with copies, near copies, shared passages, runs, a null, an empty, a blank, short and long texts."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    texts += [None, "", " \n\t ", "one two", "A B\nc  D", "x " * 400, texts[0], texts[0], "é ▁ 😀\x0bq", prose(rng, 5000)]
    passage = prose(rng, 40)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(8)]
    for base in texts[1:6]:
        words = base.split(" ")
        for k in range(3):
            changed = list(words)
            changed[(7 * k) % len(changed)] = "new"
            texts.append(" ".join(changed))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(k, texts[j], "en", "s", len(texts[j] or ""), "u", "r", "m") for k, j in enumerate(order)]


def frame(spark, seed=1, n=60):
    return spark.createDataFrame(rows(seed, n), DOCS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], DOCS)
