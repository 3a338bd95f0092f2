"""Invented words for the tests."""

SYLLABLES = "the of and er on in ti re ha th st en ed ou an é ß ñó 日 я".split()


def sentence(rng, n):
    return [
        "".join(rng.choices(SYLLABLES, k=rng.randint(1, 5))) + rng.choice(["", "", "", "."])
        for _ in range(n)
    ]
