import random

import numpy as np
from tidemark.llm import decontaminate as dc


def test_quotes_at_every_offset():
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    items = [(n, prose(100)[:n].rstrip() + "z") for n in (75, 100, 160, 240, 400)]
    index = dc.Index(items)
    for item, text in items:
        docs = []
        for at in range(len(text) - 69):
            quote = text[at : at + 70]
            docs += [f"{prose(20)} {quote} {prose(20)}", quote, f"{prose(9)} {quote[:34]}{quote[35:]}q {prose(9)}" if at % 7 == 0 else quote]
        docs += [prose(60) for _ in range(20)]
        raw = [d.encode() for d in docs]
        found = index.search(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        assert {(t, k) for t, k, *_ in found} == {(t, item) for t in range(len(docs) - 20)}
