"""Small adversarial tables for brute-force comparisons."""

import random


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def documents(seed=0, n=40):
    """Near copies, exact copies, chains of copies, shared passages, short, empty, null, very long and odd texts."""
    r = random.Random(seed)
    out = []
    passage = words(r, 30)
    for _ in range(n):
        w = words(r, r.choice((3, 5, 12, 14, 40, 90, 200)))
        if r.random() < 0.3:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage
        out.append(w)
        for _ in range(r.choice((0, 0, 1, 3))):
            x = list(w)
            for _ in range(r.choice((0, 0, 1, 2, 5))):
                x[r.randrange(len(x))] = f"n{r.randrange(1000)}"
            out.append(x)
            w = x if r.random() < 0.5 else w
    texts = [r.choice((" ", "\n", "  ", "\t")).join(w) for w in out]
    texts = [t.upper() if r.random() < 0.1 else t for t in texts]
    texts += [None, "", "   \n", "one", "one two", "ONE  two", "é è ü ß 日本 語", "a " * 500, "a b " * 300, " ".join(words(r, 8000)), " ".join(passage), " ".join(passage), "x" * 5000]
    r.shuffle(texts)
    return list(enumerate(texts, 3))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, **more):
    full = [(i, t, ("en", "de", None)[(i or 0) % 3], ("s1", "s2", None, "s1")[(i or 0) % 4], None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)
