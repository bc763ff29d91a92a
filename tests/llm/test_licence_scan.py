import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewise.llm.licence_scan import PHRASES, TEMPLATES, Automaton, Scanner, scan_licences, templates_of
from tidewise.llm.words import chunks

SCANNER = Scanner(PHRASES, TEMPLATES)


def scan(texts):
    return [r for _, _, data, offsets in chunks(pa.array(texts, pa.string())) for r in SCANNER.scan(data, offsets)]


def brute(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def random_texts(n=300):
    rnd = random.Random(4)
    vocab = sorted({w for p in PHRASES for w in p.split()}) + ["The", "é", "x"]
    return ["", None, "cc by nc cc BY-NC", "under the mit-license, under the MIT  license"] + [rnd.choice([" ", "-", ", "]).join(rnd.choices([*vocab, *PHRASES], k=rnd.randrange(40))) for _ in range(n)]


def test_base_equals_brute_force():
    texts = random_texts()
    for t, r in zip(texts, scan(texts)):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t


def test_statistics_equal_brute_force():
    rnd = random.Random(1)
    for _ in range(60):
        seqs = [rnd.choices(range(4), k=rnd.randrange(1, 14)) for _ in range(4)]
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        a, text = Automaton(seqs), rnd.choices(range(5), k=40)
        for i, (state, length) in enumerate(a.statistics(text), 1):
            want = max((k for k in range(i + 1) if k == 0 or tuple(text[i - k : i]) in subs))
            assert length == want
            places = {(n, e) for n, s in enumerate(seqs) for e in range(length, len(s) + 1) if length and s[e - length : e] == text[i - length : i]}
            assert (a.places[state] if state else set()) == places


@pytest.mark.parametrize("n", range(len(TEMPLATES)))
def test_every_template_is_found_with_a_few_words_changed(n):
    label, text, deciding = TEMPLATES[n]
    w = text.split()
    if len(w) > 15 and not deciding:
        w[len(w) // 2] = "zzz"
    (r,) = scan(["lorem ipsum " + " ".join(w) + " dolor"])
    span = [s for s in r["spans"] if s["template"] == n]
    assert label in r["labels"].split(",") and span and span[0]["first"] == 2 and span[0]["last"] == len(w) + 1


@pytest.mark.parametrize(
    "text, labels",
    [
        ("licensed under CC BY.", "cc-by"),
        ("licensed under CC BY-NC 4.0", "cc-by-nc"),
        ("licensed under CC BY-NC-ND", "cc-by-nc,cc-by-nc-nd"),  # the base phrase stays
        ("licensed under CC BY-SA", "cc-by-sa"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "cc-by-nd"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-Example 4.0 International License", ""),
        ("licensed under the GNU General Public License version 2", "gpl-2"),
        ("licensed under the GNU General Public License version 3", "gpl-3"),
        ("This work is licensed under the GNU Lesser General Public License", "lgpl"),
        ("This work is licensed under the GNU Affero General Public License", "agpl"),
        ("Licensed under the Apache License, Version 1.1", "apache-1.1"),
        ("Licensed under the Apache License, Version 2.0", "apache-2"),
        ("subject to the terms of the Mozilla Public License, version 1.0", ""),
        ("released under the XYZ license", ""),
        ("licensed under the BSD 3-clause license", "bsd-3"),
        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
        ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted. The software is provided", "0bsd"),
    ],
)
def test_notices_that_look_alike(text, labels):
    assert scan([f"see file {text} ok"])[0]["labels"] == labels


def test_templates_of_a_table(spark):
    rows = [("own", "You may, Copy this Text as often as the author of it agrees", ["copy this text"]), (None, "a b c d", None), ("none", None, None)]
    got = templates_of(spark.createDataFrame(rows, "label string, text string, deciding array<string>"))
    df = spark.createDataFrame([(1, "you may copy this text as often as the author of it agrees"), (2, "you may copy that text as often as the author of it agrees")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in scan_licences(df, ["doc_id"], templates=got).collect()} == {1: "own", 2: ""}
    with pytest.raises(ValueError):
        templates_of(spark.createDataFrame([("x", "y" * 2_000_000, None)], "label string, text string, deciding array<string>"), most_mb=1)


def test_prose_has_no_labels():
    (r,) = scan(["the software is in this file and the rights of the copy are to be used for the work by any person in the public domain of the city"])
    assert r["labels"] == "" and r["score"] < 0.6


def test_many_repeats_stay_quick():
    (r,) = scan(["Licensed under the Apache License, Version 2.0.\n" * 5000])
    assert r["n_base"] == 5000 and "apache-2" in r["labels"]


def test_frame(spark):
    df = spark.createDataFrame([(1, "Under the MIT license", "q"), (1, "Under the MIT license", "q"), (None, None, None)], "doc_id long, text string, labels string")
    got = scan_licences(df, ["doc_id", "labels"]).collect()
    assert [r.labels for r in got] == ["mit", "mit", ""] and got[2].first_word is None and got[0].first_word == 0
    assert scan_licences(df.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "cc-by-nc-sa"),
        ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"),
        ("// SPDX-License-Identifier: MIT", "mit"),
        ("# SPDX-License-Identifier: MIT-0", "mit-0"),
        ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl-2.1"),
        ("SPDX-License-Identifier: CC-BY-ND-4.0", "cc-by-nd"),
        ("Creative Commons Attribution 4.0", "cc-by"),
        ("Licence: Mozilla Public License 2.0.", "mpl-2"),
        ("GNU Affero General Public License version 3", "agpl-3"),
        ("Boost Software License 1.0", "boost"),
        ("the words license identifier mit alone, and a general public of the gnu", ""),
        ("SPDX-License-Identifier: NONE", ""),
    ],
)
def test_identifiers_and_names(spark, text, labels):
    (r,) = scan_licences(spark.createDataFrame([(1, f"some words before it\n{text}\nand after")], "doc_id long, text string"), ["doc_id"]).collect()
    assert r.labels == labels


def test_every_identifier_and_name_has_its_label(spark):
    from tidewise.llm.licence_scan import IDENTIFIERS, NAMES

    rows = [(label, f"spdx license identifier {x}") for label, own in IDENTIFIERS.items() for x in own] + [(label, x) for label, own in NAMES.items() for x in own]
    for r in scan_licences(spark.createDataFrame(rows, "label string, text string"), ["label", "text"]).collect():
        base = {"cc-by-nc"} if "cc by nc" in r.text else set()  # labels of base phrases stay
        assert set(r.labels.split(",")) == {r.label} | base, r.text


def test_texts_of_a_table(spark, tmp_path):
    """Every document that holds a text of the table as a whole is found, and one without its words is not."""
    from tidewise.llm.queries import template_scan

    texts = {str(i): " ".join(f"w{i}x{j}" for j in range(30)) for i in range(5)}
    rows = [(i, f"before {texts[str(i % 5)]} after" if i % 2 else "nothing of it", "en", "s", 1) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(int(i), t) for i, t in texts.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((r.doc_id, r.labels, r.score, r.n_spans) for r in template_scan(spark, str(tmp_path)).collect()) == [(i, str(i % 5), 1.0, 1) for i in range(20) if i % 2]
