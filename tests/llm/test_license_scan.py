"""License notices against trying every block of every text."""

import re

import numpy as np
import pytest
from brute import lower_ascii

from chatterlens.llm import license_scan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(lower_ascii(text or ""))


def plain(text, phrases, templates, percent):
    w = words(text)
    spelled = [(words(p), label) for p, label in phrases.items()]
    stands = [(i, label) for p, label in spelled for i in range(len(w)) if w[i : i + len(p)] == p]
    found, best = set(), 0.0
    for label, texts in templates.items():
        for t in map(words, texts):  # a template without words is none
            for i in range(max(1, len(w) - len(t) + 1) if t else 0):
                shared = len(set(t) & set(w[i : i + len(t)]))
                if w and 100 * shared >= percent * len(set(t)):
                    found.add(label)
                    best = max(best, shared / len(set(t)))
    base = {label for _, label in stands}
    places = [i for i, _ in stands]
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if base else best)


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
TEMPLATES = license_scan.TEMPLATES | {"long": [" ".join(f"t{i}" for i in range(150))], "same": ["again again and again"], "none": ["", "..."]}


def texts():
    rng = np.random.default_rng(4)
    every = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
    made = [None, "", " \n", "all rights reserved", "ALL\nRights, reserved. All rights RESERVED", "all rights", "rights reserved all", "cc-by cc by", "again and", "Cc_By4.0",
            "general public license " * 3, "x" * 5000, "É all rights reserved é", "all rightsé reserved"]
    for _ in range(400):
        parts = []
        for _ in range(rng.integers(1, 6)):
            label = rng.choice(list(TEMPLATES))
            text = str(rng.choice(TEMPLATES[label])).split() or ["x"]
            changed = [str(rng.choice(every)) if rng.random() < 0.12 else w for w in text]
            parts += [*changed, *map(str, rng.choice(every, rng.integers(0, 30)))]
        made.append(str(rng.choice([" ", ", ", "\n"])).join(parts))
    return made


@pytest.mark.parametrize("percent", [80, 100, 35])
def test_scan_equals_trying_every_block(spark, percent):
    given = texts()
    docs = spark.createDataFrame([(i, t, "l", 1, "m") for i, t in enumerate(given)], "doc_id long, text string, labels string, n_words int, code string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs, templates=TEMPLATES, percent=percent).collect()}
    assert len(got) == len(given)
    for i, text in enumerate(given):
        expected = plain(text, license_scan.PHRASES, TEMPLATES, percent)
        assert tuple(got[i][c] for c in COLUMNS) == expected, text
        w = words(text)
        for m in got[i]["matches"]:
            t = words(TEMPLATES[m["label"]][m["template"]])
            block = w[m["first_word"] : m["last_word"] + 1]
            assert len(block) <= len(t) and len(set(block) & set(t)) == m["shared"] and m["containment"] == m["shared"] / len(set(t))


def test_odd_rows(spark, odd_docs, no_docs):
    got = license_scan.scan_licenses(odd_docs)
    given = odd_docs.select("doc_id", "text").collect()
    key = lambda r: (str(r[0]), str(r[1:]))
    assert sorted((tuple(r) for r in got.drop("matches").collect()), key=key) == sorted(
        ((r["doc_id"], *plain(r["text"], license_scan.PHRASES, license_scan.TEMPLATES, 80)) for r in given), key=key)
    assert license_scan.scan_licenses(no_docs).count() == 0
    assert set(license_scan.scan_licenses(odd_docs, {}, {}).select("labels").distinct().collect()) == {("",)}
    with pytest.raises(ValueError):
        license_scan.scan_licenses(no_docs, percent=0)
