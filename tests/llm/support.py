"""Helpers of the tests in this folder."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside; an input column of such a name must not matter.
CLASHING = "version ranges rep n size tie copies ids start kept words label block first score".split()


def words_of(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    pick = random.Random(seed)
    return " ".join(f"w{int(pick.paretovariate(0.7)) % vocabulary}" for _ in range(n))
