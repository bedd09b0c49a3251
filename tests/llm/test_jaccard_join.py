import random

import pytest

from galleon.llm import jaccard_join as op

from .samples import WORD, documents, frame, thue_morse


def shingles(t):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if i is not None and j is not None and (a or b) and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return sorted([(i, len(s), None if i is None else root(i)) for i, s in sets], key=str)


def near_copies(seed, n=40, groups=6, words=60):
    """Groups of texts around the threshold, short and long."""
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 6, 9, 14, 30, words, 4 * words]))]
        for _ in range(n):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
            rows.append((len(rows) * 7 % 1009 + g, " ".join(w).upper() if r.random() < 0.2 else "\n".join(w)))
    return list(dict(rows).items())


@pytest.mark.parametrize("seed", [0, 1])
def test_random_documents(spark, seed):
    rows = documents(seed)
    rows += random.Random(seed).sample(rows, 2)
    assert sorted(map(tuple, op.link(frame(spark, rows))[0].collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_near_copies_around_the_threshold(spark, seed):
    rows = near_copies(seed)
    assert sorted(map(tuple, op.link(frame(spark, rows))[0].collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert op.link(frame(spark, []))[0].collect() == []


def test_one_of_each_group_stays(spark):
    rows = near_copies(3)
    kept = {r.doc_id for r in op.keep_one(frame(spark, rows)).collect()}
    assert kept == {c for _, _, c in brute(rows)}


def test_texts_written_to_collide(spark):
    rows = [(1, thue_morse(11)), (2, thue_morse(11, True)), (3, thue_morse(11)), (4, "x y " + thue_morse(12) + " z"), (5, "x y " + thue_morse(12, True) + " z")]
    rows += [(10 + i, " ".join(f"w{i}{j}" for j in range(20)) + " " + thue_morse(11, i % 2 > 0)) for i in range(2)]
    assert sorted(map(tuple, op.link(frame(spark, rows))[0].collect()), key=str) == brute(rows)


@pytest.mark.parametrize("num", [60, 70, 90, 100])
def test_other_similarities(spark, num):
    rows = [(i, t) for i, t in near_copies(5, n=12, groups=4, words=40)]
    sets = {i: shingles(t) for i, t in rows}
    found = {i: c for i, _, c in map(tuple, op.link(frame(spark, rows), num=num)[0].collect())}
    up = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if up[j] < up[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) > 0:
                    up[i], changed = up[j], True
    assert found == up


def test_too_low_a_similarity_is_refused(spark):
    with pytest.raises(ValueError):
        op.link(frame(spark, []), num=50)


def test_a_phrase_in_every_document(spark, monkeypatch):
    """Runs longer than HOT are thinned to documents without surplus, and compared in chunks."""
    monkeypatch.setattr(op, "HOT", 20)
    monkeypatch.setattr(op, "CHUNK", 8)
    r = random.Random(11)
    rows = []
    for g in range(60):
        base = [f"v{r.randint(0, 10**6)}" for _ in range(r.choice([2, 5, 12, 60, 200]))]
        for _ in range(r.choice([1, 1, 3])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
            at = r.randrange(len(w) + 1)
            rows.append((len(rows), " ".join([*w[:at], "this very phrase is in every document", *w[at:]])))
    # and documents of which two thirds are one text
    common = [f"c{i}" for i in range(120)]
    rows += [(1000 + i, " ".join(common + [f"u{i // 2}-{j}-{r.randint(0, 8) // 8}" for j in range(50)])) for i in range(60)]
    assert sorted(map(tuple, op.link(frame(spark, rows))[0].collect()), key=str) == brute(rows)


def test_a_set_that_very_many_share(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT", 10)
    rows = [(i, "one two three four five six" if i % 3 else f"a{i} b c d e f g") for i in range(300)] + [(400, None), (401, "")]
    assert sorted(map(tuple, op.link(frame(spark, rows))[0].collect()), key=str) == brute(rows)


def test_rows_that_repeat_an_id(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text"), (2, "a b c d e f"), (3, "u v w"), (None, "a b c d e f")]
    kept = sorted(((r.doc_id, r.text) for r in op.keep_one(frame(spark, rows)).collect()), key=str)
    assert kept == [(1, "a b c d e f"), (1, "quite another text"), (3, "u v w"), (None, "a b c d e f")]
