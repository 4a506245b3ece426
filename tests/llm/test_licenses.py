"""License places against a word-by-word search, notices with edits."""

import random
import re

import pytest

from syllabica.llm import license_scan
from tests.llm.helpers import empty, prose, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ROWS = [
    (1, "Licensed under the Apache License, Version 2.0. Apache   License"), (2, ""), (3, None), (None, "MIT License"), (4, "mit licenses, amit license, MIT-License"),
    (5, "GNU\nGeneral.Public--LICENSE and CC BY and CC-BY-NC"), (6, "Relesed under the MIT Licnse"), (7, prose(20_000, 1) + " cc by"), (8, "x cc byé"),
    (9, "Licensed undr the Apache Licence, Version 2.0 " * 2), (1, "cc by"),
]


def base(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i: i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_base_places(spark):
    got = license_scan.summary(license_scan.scan(table(spark, ROWS))).collect()
    assert sorted(str((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got) == sorted(
        str((i, *base(t))) for i, t in ROWS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[6]["labels"] == "mit-notice" and 0.85 < by_id[6]["score"] < 1 and by_id[6]["base_labels"] == ""
    assert by_id[9]["labels"] == "apache-2.0" and by_id[9]["n_spans"] == 2
    assert by_id[2]["labels"] == by_id[3]["labels"] == "" and by_id[2]["score"] == 0
    assert license_scan.scan(empty(spark)).count() == 0


def edits(a, b):
    row = range(len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(30))
def test_edits_within_the_bound_are_found(seed):
    rng = random.Random(seed)
    notice = rng.choice(list(license_scan.NOTICES))
    body, _, exact = notice.partition("|")
    allowed = license_scan.allowed_edits(body, 0.1)
    wrong = list(body)
    for _ in range(rng.randint(0, allowed)):
        at = rng.randrange(len(wrong))
        wrong[at: at + 1] = rng.choice([[], ["#"], ["#", wrong[at]]])
    text = prose(30, seed) + " " + "".join(wrong) + exact + " " + prose(30, seed + 1)
    spans = license_scan.NoticeFinder(license_scan.NOTICES, 0.1).spans(text)
    best = [s for s in spans if s["label"] == license_scan.NOTICES[notice]]
    assert best and all(s["edits"] <= max(allowed, 4) for s in best)
    plain = [(n.replace("|", ""), label) for n, label in license_scan.NOTICES.items()]
    assert any(edits(text[s["start"]: s["end"]], n) == s["edits"] for s in best for n, label in plain if label == s["label"])


@pytest.mark.parametrize("order", [(1, 1, 0), (2, 1, 0, 1), (0, 2, 0), (2, 2, 1)])
def test_poorer_notices_before_a_better_one(order):
    forms = ["released under the mit license", "released under the mit licence", "relesed under the mit licence"]
    text = ". ".join(forms[i] for i in order) + "."
    spans = license_scan.NoticeFinder(license_scan.NOTICES, 0.1).spans(text)
    assert [s["edits"] for s in spans] == list(order) and all(s["label"] == "mit-notice" for s in spans)
    assert [edits(text[s["start"]: s["end"]], forms[0]) for s in spans] == list(order)


@pytest.mark.parametrize(("text", "labels"), [
    ("licensed under the gnu general public license, version 2", ["gpl-2.0"]), ("licensed under the gnu general public licence, version 3.0.", ["gpl-3.0"]),
    ("licensed under the apache license, version 1.1", ["apache-1.1"]), ("licensed under the apache license, version 2.0.", ["apache-2.0"]),
    ("licensed under the apache license, version 2.01", []), ("licensed under the apache license, version 2.0.1", []),
    ("licensed under cc by-nd 4.0", ["cc-by-nd-4.0"]), ("licensed under cc by-sa 4.0", ["cc-by-sa-4.0"]), ("licensd under cc by-nc 4.0", ["cc-by-nc-4.0"]),
    ("licensed under cc by-nc-sa 4.0", ["cc-by-nc-sa-4.0"]), ("licensed under cc by-nx 4.0", []), ("licensed under the gnu general public license, version 4", []),
    ("licensed under the gnu lesser general public license, version 2.1", ["lgpl-2.1"]), ("licensed under the gnu general public license, version 3.1", []),
    ("licensed under the apache license, version 2.0 licensed under the apache license, version 1.1", ["apache-2.0", "apache-1.1"]),
])
def test_what_tells_licences_apart_is_exact(text, labels):
    assert [s["label"] for s in license_scan.NoticeFinder(license_scan.NOTICES, 0.1).spans(text)] == labels
