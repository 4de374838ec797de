"""Notices that share their line or paragraph with other words."""

import random

from fundcat.llm import licenses

S = licenses.Scanner()


def _best(text):
    return max(S.scan(text), key=lambda m: (m[1], -m[2]), default=None)


def test_inline_and_wrapped_notices():
    for text, name in (
        ("Copyright 2024 Acme. Released under the MIT License.", "MIT"),
        ("Parts of this text are Licensed under CC BY-NC 4.0. All other rights stay.", "CC-BY-NC-4.0"),
        ("word " * 5000 + "Licensed under the Apache License, Version 2.0. " + "more words " * 5000, "Apache-2.0"),
        ("# Tools of ours\n# Copyright. This program is free software: you can redistribute it and/or\n# modify it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or (at your\n# option) any later version.\nimport os\nx = 1\n" + "y = x + 2\n" * 40, "GPL-3.0"),
        ("İİ and so on. Released under the MIT License. İ", "MIT"),
    ):
        found = _best(text)
        assert found[:2] == (name, 1.0) and {m[0] for m in S.scan(text)} == {name}
        assert licenses.bigrams(text[found[2] : found[3]]) in [b for n, b in S.templates if n == name]
    twice = "Released under the MIT License. " * 2
    assert len([m for m in S.scan(twice + "tail " * 30) if m[0] == "MIT"]) == 2
    assert S.scan("The river is under the bridge and this work is free for any purpose.") == []


def test_windows_equal_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        own = rng.choice(licenses.TEMPLATES)[1].split()
        noise = [rng.choice(("the", "of", "license", "under", "river", "a", "this")) for _ in range(25)]
        words = noise[:10] + [w for w in own if rng.random() > 0.06] + noise[10:]
        text = " ".join(words)
        flat = licenses._WORD.findall(text.lower())
        best = 0.0
        for i in range(len(flat)):
            for j in range(i + 2, len(flat) + 1):
                w = set(zip(flat[i:j], flat[i + 1 : j], strict=False))
                best = max([best] + [2 * len(w & b) / (len(w) + len(b)) for _, b in S.templates])
        got = _best(text)
        assert (got[1] if got else 0.0) == (best if best >= S.threshold else 0.0)


def test_cost_is_bounded():
    assert len(S.scan("Released under the MIT License. of the terms " * 3000)) == 3000
