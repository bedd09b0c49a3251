import random

import numpy as np
import pytest

from galleon.llm import bwt


@pytest.mark.parametrize("seed", range(30))
def test_classes_are_equal_prefixes(seed):
    r = random.Random(seed)
    unit = bytes(r.choices(range(256), k=r.randint(1, 40)))
    data = b"".join(r.choice([unit, unit[: r.randint(0, len(unit))], bytes(r.choices(b"ab\x00", k=r.randint(0, 60)))]) for _ in range(r.randint(1, 25)))
    if not data:
        return
    depth = r.choice([1, 5, 20, 100])
    order, begin = bwt.repeat_classes(np.frombuffer(data, np.uint8), depth)
    assert sorted(order) == list(range(len(data)))
    cls = np.zeros(len(data), int)
    cls[begin[1:]] = 1
    cls = np.cumsum(cls)
    found = {}
    for c, p in zip(cls, order, strict=True):
        if p + depth <= len(data):
            found.setdefault(data[p : p + depth], set()).add(int(c))
    assert all(len(x) == 1 for x in found.values())
    assert len({min(x) for x in found.values()}) == len(found)
