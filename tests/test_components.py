import random

from galleon.operators import graph


def brute(pairs):
    at = {}
    for a, b in pairs:
        at.setdefault(a, a)
        at.setdefault(b, b)
    find = lambda x: x if at[x] == x else find(at[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {x: find(x) for x in at}


def test_edges_shrink_from_round_to_round(spark, monkeypatch):
    """A path, a star around its greatest id, hubs between local minima, and random pairs: no round has all edges again."""
    kept = []
    plain = graph.Scratch.write
    monkeypatch.setattr(graph.Scratch, "write", lambda self, df: (out := plain(self, df), kept.append(out.count()) if out.columns == ["src", "dst"] else None)[0])
    r = random.Random(0)
    path = [(i, i + 1) for i in range(200)]
    star = [(999, i) for i in range(300, 400)] + [(300, 999)]
    hubs = [(-1 - i % 7, 1000 + i) for i in range(150)] + [(-1 - i * 3 % 7, 1000 + i) for i in range(0, 150, 2)]
    loose = [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)]
    for pairs in (path, star, hubs, loose, path + star + hubs + loose + [(5, 5)]):
        kept.clear()
        got = {x.id: x.component for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert got == brute([p for p in pairs if p[0] != p[1]])
        assert len(kept) > 1 and kept[-1] == 0 and all(y < x for x, y in zip(kept, kept[1:], strict=False))
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
