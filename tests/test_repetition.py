"""repetition_flag against brute force over all patterns."""

import random
import re

import pandas as pd

from finloom.plans.more import _repeats


def brute(text):
    if len(text) < 2000:
        return False
    w, best, pattern = text[-2000:], 0, ""
    for size in range(5, 501):
        for start in range(1800, 2000 - size + 1):
            unit, n, pos = w[start : start + size], 0, start
            while pos >= 0 and w[pos : pos + size] == unit:
                n, pos = n + 1, pos - size
            if pos >= 0 and re.sub(r"<[^>]+>", "", w[pos : pos + size]).strip():
                n = 0
            if n > best:
                best, pattern = n, unit
    return best >= 20 or best * len(pattern) >= 1400


def test_repetition_matches_brute_force():
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh <>") for _ in range(n))
    texts = ["x" * 100, "", "ABABAB" * 10, "ABABAB" * 400, "ABABAB" * 400 + "</p>", " ".join(str(i) for i in range(600)), noise(2500)]
    for size in (5, 6, 13, 29, 70, 100, 150, 199, 200, 201, 300):
        for front, back in ((0, 0), (0, 3), (0, 40), (600, 0), (600, 17)):
            unit = noise(size)
            texts.append(noise(front) + (unit * (3000 // size))[: 3000 - front] + noise(back))
        texts.append("<br>" * 300 + noise(size) * (1000 // size))
        texts.append("<b>" * 200 + " " * 400 + ("word" + noise(size)) * (1300 // (size + 4)) + "end")
    want = [brute(t) for t in texts]
    assert any(want) and not all(want)
    assert list(_repeats(pd.Series([t[-2000:] for t in texts]))) == want
