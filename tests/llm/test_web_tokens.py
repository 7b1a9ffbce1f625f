"""Web tokens: found as by one plain pattern, in time that grows with the text."""

import random
import re
import time

PLAIN = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PARTS = ["eyJ", "eyJabcdefgh", "eyJ-bcdefgh1", "abcdefgh", "-", "_", ".", ".eyJabcdefgh.", "xy", " ", "é", "\n"]


def test_as_a_plain_pattern():
    from vitagraph.llm.secret_scan import BASE, find

    rng, found = random.Random(1), 0
    for _ in range(20_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 10)))
        want = [(m.start(), m.end(), m[0]) for m in PLAIN.finditer(text)]
        assert [(a, b, v) for a, k, b, v in find(text) if k == BASE] == want, text
        found += bool(want)
    assert found > 200


def test_hostile_runs_take_linear_time():
    from vitagraph.llm.secret_scan import find

    took = []
    for size in (500_000, 4_000_000):
        text = ("eyJaaaaaaaa-" * (size // 24) + ".eyJaaaaaaaa.") * 2
        began = time.perf_counter()
        find(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 1 and took[1] < 20
