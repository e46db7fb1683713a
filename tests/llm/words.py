WORDS = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha", "li", "mo", "nu", "pe") for b in ("ra", "sti", "ton", "ver", "wis", "zan", "ck", "lm")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))
