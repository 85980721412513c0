"""Licence notices against a plain Dice over all pairs."""

import random
import re

from loomgraph.llm import license_scan


def plain(text):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    lines = [re.sub(r"[^\w\n]+|_+", " ", line).strip() for line in lowered.split("\n")]
    units = [*lines, *(" ".join(p) for p in paragraphs(lines) if len(p) > 1)]
    best = []
    for u in units:
        words = u.split()
        b = {f"{x} {y}" for x, y in zip(words, words[1:], strict=False)}
        scores = [(2 * len(b & set(t)) / (len(b) + len(t)), -k, n) for k, (n, t) in enumerate((n, license_scan.bigrams_of(t)) for n, t in license_scan.TEMPLATES.items())]
        if max(scores)[0] >= license_scan.MIN_DICE:
            best.append(max(scores))
    return len(best), max(best)[2] if best else None, max(best)[0] if best else 0.0


def paragraphs(lines):
    block = []
    for line in [*lines, ""]:
        if line:
            block.append(line)
        elif block:
            yield block
            block = []


def test_matches_a_plain_version(spark):
    rng = random.Random(1)
    notices = list(license_scan.TEMPLATES.values())
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choice(notices).split()
            words = [w for w in words if rng.random() > rng.choice([0, 0, 0.1, 0.3])]
            parts.append(rng.choice([" ", " ", "\n", " - "]).join(words) if rng.random() < 0.7 else "some other words of prose é ß here")
        texts.append(rng.choice(["\n", "\n\n", " "]).join(parts))
    texts += [None, "", "\n\n\n", "MIT", "!!!", notices[0].upper(), (notices[1] + " ") * 300, "w " * 100_000 + "\n" + notices[2], notices[3] + "\n" + notices[3]]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in enumerate(texts)], "doc_id long, text string, dice double, license string")
    got = {r.doc_id: (r.n_matches, r.license, round(r.dice, 12)) for r in license_scan.scan(docs).collect()}
    want = {i: plain(t) for i, t in enumerate(texts)}
    assert got == {i: (n, name, round(d, 12)) for i, (n, name, d) in want.items()}
    assert sum(n > 0 for n, _, _ in want.values()) > 60


def test_bounds_lose_nothing():
    for size in range(1, 40):
        low, high = license_scan.bounds(size, 0.8)
        for a in range(1, 200):
            assert (2 * min(a, size) / (a + size) >= 0.8) == (low <= a <= high)


def test_odd_rows(spark):
    text = license_scan.TEMPLATES["MIT"]
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_matches, r.license or "") for r in license_scan.scan(rows).collect()) == [(0, 0, ""), (0, 1, "MIT"), (1, 1, "MIT"), (1, 1, "MIT")]
    assert license_scan.scan(rows.limit(0)).collect() == []


MIT_FILE = """MIT License

Copyright (c) 2024 Foo

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def test_every_licence_of_a_text_is_named(spark):
    texts = {
        1: MIT_FILE,
        2: "Copyright 2024 Example Foo Inc. Licensed under the Apache License, Version 2.0.",
        3: "x\nLicensed under the Apache License, Version 2.0.\ny\nReleased under the MIT License.\n",
        4: "/*\n * Prose first! This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU Affero General Public License"
           " as\n * published by the Free Software Foundation, either version 3 of the\n * License, or (at your option) any later version. */",
        5: "The licence was granted, the software was free, and no permission notice came with any copies of it.",
        6: None,
        7: "",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan.scan(docs).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0", 3: "Apache-2.0,MIT", 4: "AGPL-3.0", 5: "", 6: "", 7: ""}
