"""Both searches for copied blocks against all pairs of lines."""

from __future__ import annotations

import random

from quire.operators import faults as FA
from quire.operators.merge import similar


def plain(normals):
    for p in range(len(normals) - 5):
        for q in range(p + 3, len(normals) - 2):
            if all(similar(normals[p + o], normals[q + o]) > FA.SAME for o in range(3)):
                return [p, q]
    return None


def test_first_copies():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 90)))
    found = 0
    for _ in range(400):
        lines = [word() for _ in range(rng.randrange(1, 40))]
        for _ in range(rng.randrange(3) if len(lines) > 8 else 0):
            p, q = rng.randrange(len(lines) - 3), rng.randrange(len(lines) - 3)
            for o in range(rng.choice([2, 3, 4])):
                if q + o < len(lines) and p + o < len(lines):
                    x = list(lines[p + o])
                    for _ in range(rng.randrange(4)):
                        x[rng.randrange(len(x))] = rng.choice("abé日")
                    lines[q + o] = "".join(x)
        want = plain(lines)
        found += want is not None
        assert FA.first_copy(lines) == want == FA.first_copy_of_many(lines)
    assert found > 40
