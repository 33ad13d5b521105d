"""The licence scan's gate leaves nothing out that scoring would find, whatever words are common in the corpus."""

import random

from lodewright.llm import license_scan as L
from lodewright.llm.license_templates import TEMPLATES


def software(seed=1):
    rng = random.Random(seed)
    words = "license licensed released copyright software mit under the this is version code with of general public apache a to build server".split()
    return [rng.sample(words, 12) for _ in range(400)]


def test_common_template_words():
    model = L.train(software())
    rng, found = random.Random(2), 0
    texts = ["Released under the MIT License.", *(t for ts in TEMPLATES.values() for t in ts)]
    texts += [" ".join(w for w in L.words_of(t) if rng.random() > 0.05) for t in texts]
    for t in texts:
        text = "Some words before.\n\n" + t + "\n\nand after it\n"
        scored = {f for a, b in L.passages(text) if (f := model.of(L.words_of(text[a:b]))[0]) != L.UNKNOWN}
        got = {f for _, _, f, _ in model.findings(text)}
        assert got <= scored and bool(got) == bool(scored)
        found += bool(got)
    assert [f for _, _, f, _ in model.findings("Released under the MIT License.")] == ["MIT"] and found > len(texts) / 2
