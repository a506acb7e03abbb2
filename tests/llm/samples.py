"""Texts for tests."""

import random

WORDS = "alpha beta gamma delta omega sigma kappa lambda theta iota zeta eta rho tau phi chi psi mu nu xi".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


#: Nulls, empty and long texts, ties, repeated rows, white space, odd characters.
ODD = [None, "", "   \n\t", "one", "one two three", "Ünïcödé ñandú 𝒳 日本語", "a\x00b  c", prose(1, 12_000), prose(2, 40), prose(2, 40)]
