"""Links, copies and classes against all pairs."""

import random
import re

import pytest

from syllabica.llm import components, ngram_join
from tests.llm.helpers import empty, prose, table

WORD = re.compile("[0-9a-z\u0080-\U0010ffff]+")


def grams(text, n=5):
    words = WORD.findall((text or "").lower())
    return frozenset(tuple(words[i: i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows, threshold=0.8):
    sets = {i: grams(t) for i, t in rows}
    copy = {i: min(j for j in sets if sets[j] == sets[i]) if sets[i] else i for i in sets}
    heads = sorted(set(copy.values()))
    root, links = {i: i for i in heads}, dict.fromkeys(heads, 0)
    for x in heads:
        for y in heads:
            if x != y and sets[x] and len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]):
                links[x] += 1
                low, high = sorted((root[x], root[y]))
                root = {k: low if v == high else v for k, v in root.items()}
    return sorted((i, root[copy[i]], copy[i], links[copy[i]]) for i in sets)


def near(text, seed, n):
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


def corpus():
    base, other = prose(300, 1), prose(120, 2)
    rows = [(i, near(base, i, 3)) for i in range(40)] + [(100 + i, base) for i in range(30)] + [(200 + i, near(other, i, i)) for i in range(6)]
    rows += [(300 + i, prose(80, 50 + i)) for i in range(20)]
    rows += [(400, ""), (401, None), (402, "two words"), (403, "Two, WORDS!"), (404, "..."), (405, base.upper()), (406, prose(30_000, 9)), (407, prose(30_000, 9) + " end")]
    return rows


@pytest.mark.parametrize("per_block", [8, 256])
def test_links(spark, per_block):
    got = ngram_join.similar(table(spark, corpus()), per_block=per_block)
    assert got.columns == ["doc_id", "class_id", "copy_id", "n_links"]
    assert sorted(tuple(r) for r in got.collect()) == brute(corpus())


def test_awkward_rows(spark):
    base = prose(50, 7)
    got = ngram_join.similar(table(spark, [(None, base), (1, base), (1, base), (None, ""), (2, None)])).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(["(None, None, None, 0)"] * 2 + ["(1, 1, 1, 0)"] * 2 + ["(2, 2, 2, 0)"])
    assert ngram_join.similar(empty(spark)).count() == 0


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = ngram_join.choose_bands(threshold, 0.99)
        assert 1 - (1 - threshold**rows) ** bands >= 0.99 and bands * rows <= 128


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(200)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        root[find(a)] = find(b)
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = {}
    for x in {x for a, b in edges if a != b for x in (a, b)}:
        groups.setdefault(find(x), set()).add(x)
    found = {}
    for x, r in got.items():
        found.setdefault(r, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))
