"""Small random documents with copies, shared passages and awkward rows."""

import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(seed=0, n=60, vocabulary=30, words=120):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeé", k=r.randint(1, 7))) for _ in range(vocabulary)]
    text = lambda k: "".join(r.choice(vocab) + r.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(k))
    passage = [text(r.randint(14, 60)) for _ in range(4)]
    out = []
    for i in range(n):
        x = text(r.randint(0, words))
        if r.random() < 0.4:
            x += r.choice(passage) + text(r.randint(0, 40))
        if out and r.random() < 0.25:
            x = r.choice(out)[1] or ""
            w = x.split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            x = " ".join(w)
        out.append((i * 3 + 1, x))
    out += [(9001, None), (9002, ""), (9003, "a " * 400), (9004, "ab" * 300), (9005, out[0][1]), (None, out[1][1]), (9006, "É" * 250), (9007, passage[0])]
    r.shuffle(out)
    return out


def frame(spark, rows):
    """doc_id and text beside extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _b int, n_words string")


def thue_morse(n, other=False):
    """Two strings of 2**n letters that polynomial hashes modulo 2**64 take for one."""
    x = "ab"
    for _ in range(n - 1):
        x += x.translate(str.maketrans("ab", "ba"))
    return x.translate(str.maketrans("ab", "ba")) if other else x
