"""Documents with the awkward cases in them: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import string

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pid int, blob string, sig long, node long, component string"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en" if i is None or i % 2 else None, f"s{(i or 0) % 3}" if i is None or i % 5 else None, len(t) if t is not None else None, 1, "x", 2, 3, "c") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice(string.ascii_lowercase + "éß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    write = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, line = write(60), write(12)
    texts = [None, "", " \t\n ", "one", "one two three four", "one two three four", "a b c d e", "A B c d E"]
    for i in range(n):
        body = write(rng.randint(5, 120))
        kind = i % 6
        if kind == 1:
            body = body[: len(body) // 2] + " " + passage + "\n" + body[len(body) // 2 :]
        elif kind == 2:
            body = line + "\n" + body
        elif kind == 3 and len(texts) > 9:
            near = (texts[rng.randrange(8, len(texts))] or "x").split()
            near[rng.randrange(len(near))] = rng.choice(words)
            body = " ".join(near)
        elif kind == 4:
            body = texts[rng.randrange(8, len(texts))] if len(texts) > 9 else body
        texts.append(body)
    texts.append("x" * 5000)
    texts.append("ab " * 3000)
    texts.append(write(6000))
    return texts


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
