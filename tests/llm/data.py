"""Small tables with everything that is awkward."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, component string, id string, size string"
_random = random.Random(5)
_SYLLABLES = "ba co di fu ge ha jo ki lu me no pa".split()


def word() -> str:
    return "".join(_random.choice(_SYLLABLES) for _ in range(_random.randint(1, 3)))


def prose(n: int) -> str:
    return " ".join(word() + ("\n" if _random.random() < 0.08 else "") for _ in range(n))


def documents() -> list[tuple]:
    base = prose(120)
    words = base.split(" ")
    texts = [
        None, "", "   \n\t", "one", "one two three", "12 34 !!", base, base, base.upper(), base + " tail",
        " ".join([*words[:60], "changed", *words[61:]]),
        " ".join([*words[:20], "new", *words[21:60], "changed", *words[61:]]),
        " ".join(words[:90]), "same " * 400, prose(20_000), "é ü ñ " * 30, prose(200).replace(" ", "  "),
        "<|endoftext|> in the middle <|endoftext|>", "\ud7ff\U0001f600 emoji 😀 text",
        *[prose(_random.randint(1, 150)) for _ in range(30)],
    ]
    shared = "\n".join(prose(12).replace("\n", "") for _ in range(8))
    texts += [f"{prose(9)}\n{shared}\n{prose(7)}" for _ in range(4)]
    sources = ["a", "b", None, "", "é", "B"]
    rows = [
        (i, t, "xx" if i % 3 else None, sources[i % 6], len(t) if t else None, 7, "c", "i", "s")
        for i, t in enumerate(texts)
    ]
    return [*rows, rows[6], rows[0], (None, base, None, None, None, 7, "c", "i", "s")]
