import random
import re
import zlib
from collections import Counter

from galleon.llm import spelling as op

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(docs, least=7, seen=2, every=31, times=10):
    counts = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= seen}
    close = {w: [v for v in words if near(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 5, 1) for i, t in docs], "doc_id long, text string, word string, n int, key long")


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def variants(seed, n):
    r = random.Random(seed)
    letters = "abcdeé"
    base = ["".join(r.choices(letters, k=r.randint(7, 11))) for _ in range(12)] + ["aaaaaaaa", "abababab", "aabbaabb"]
    out = []
    for i in range(n):
        words = []
        for _ in range(r.randint(0, 40)):
            w = base[min(int(r.expovariate(0.5)), len(base) - 1)]
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                j = r.randrange(len(w) + 1)
                w = r.choice([w[:j] + w[j + 1 :], w[:j] + r.choice(letters) + w[j:], w[:j] + r.choice(letters) + w[j + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        out.append((i, r.choice([" ", "-", "1", "\n"]).join(words)))
    return out


def test_against_brute_force(spark):
    docs = variants(0, 250)
    docs += [(None, docs[0][1]), docs[5], docs[5], (700, None), (701, ""), (702, "éèàçùïÿ " * 3 + "×÷aaaaaa " * 2)]
    want = brute(docs)
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want) and max(r[4] for r in want) > 10
    assert found(op.group(frame(spark, docs))) == want


def test_deleted_letters_count(spark):
    docs = variants(3, 120)
    assert found(op.group(frame(spark, docs), every=3, times=2)) == brute(docs, every=3, times=2)


def test_long_words(spark):
    r = random.Random(2)
    word = "".join(r.choices("xyz", k=200))
    edge = "".join(r.choices("xyz", k=65))
    texts = [word] * 30 + [word[:150] + word[151:]] * 2 + [word[:9] + "q" + word[10:]] * 3 + [edge] * 20 + [edge[:-1]] * 2 + [edge[:-2]] * 2 + [edge + "q"] * 2 + ["k" * 3000, "k" * 3001] * 2 + [edge[:30] + edge[31:]] * 2
    docs = list(enumerate(texts))
    want = brute(docs, every=10**9)
    assert max(r[4] for r in want) >= 3
    assert found(op.group(frame(spark, docs), every=10**9)) == want


def test_edges(spark):
    none = frame(spark, [(1, None), (2, "short words only"), (3, "")])
    assert op.group(none).count() == 0 and op.group(none.limit(0)).count() == 0
    assert found(op.group(frame(spark, [(1, "abcdefgh abcdefgh")]))) == brute([(1, "abcdefgh abcdefgh")])
