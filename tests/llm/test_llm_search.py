import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import lexical_search as ls
from feedloom.llm import ngram_join as nj


def brute_search(docs, items, k):
    """Scores of all documents for all items, straight from the formula."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    cut = [(i, Counter(terms(t))) for i, t in docs]
    cut = [(i, c) for i, c in cut if c]
    n_docs, n_terms = len(cut), sum(sum(c.values()) for _, c in cut)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, counts in cut:
            score = 0
            m = 100 - 90 + (90 * sum(counts.values()) * n_docs) // n_terms
            for t in set(terms(text)):
                df = sum(t in c for _, c in cut)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                score += w * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i))
        best = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(best, 1)]
    return sorted(out, key=str)


def search_case():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["É", "ß2", "多字", "The", "THE", "a_b", "x@y"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(200)]
    docs += [(7, docs[3][1]), (None, docs[5][1]), (None, None), (500, ""), (501, "_ @ -"), (502, "w1 w2 É " * 20_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 90)))) for i in range(25)]
    items += [(3, items[3][1]), (3, "w1 w2"), (90, None), (91, ""), (92, "nowhere"), (None, "w5 É")]
    return docs, items


@pytest.mark.parametrize("limits", [{}, {"TERMS_AT_ONCE": 300}])
def test_search_against_all_scores(llm_spark, docs_of, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(ls, name, value)
    docs, items = search_case()
    table = llm_spark.createDataFrame([(*i, 1, "x") for i in items], "item_id bigint, text string, item int, rank string")
    found = ls.search(docs_of(docs), table, 5).collect()
    assert sorted(map(tuple, found), key=str) == brute_search(docs, items, 5)


def test_search_of_nothing(llm_spark, docs_of):
    none = llm_spark.createDataFrame([], "item_id string, text string")
    one = llm_spark.createDataFrame([("a", "w1")], "item_id string, text string")
    assert ls.search(docs_of([(1, "w1")]), none).collect() == []
    assert ls.search(docs_of([]), one).collect() == []
    assert [tuple(r)[:3] for r in ls.search(docs_of([(1, "w1"), (2, "w2")]), one).collect()] == [("a", 1, 1)]


def test_masks_left_unread():
    """Masks are read from the highest bound down and most are never evaluated; the result is that of all."""
    rng = np.random.default_rng(1)
    present = rng.random((3000, 20)) < np.linspace(0.02, 0.9, 20)
    table = present * np.linspace(900, 1, 20).astype(np.int64) * rng.integers(5, 10, (3000, 20))
    best = ls._Best(10)
    done = ls.search_block(best, list(range(3000)), table, np.packbits(present.T, axis=1))
    scores = table.sum(axis=1)
    expected = sorted(((int(s), (False, i)) for i, s in enumerate(scores)), key=lambda r: (-r[0], r[1]))[:10]
    assert best.rows == expected
    assert done < len(np.unique(present, axis=0)) / 4


def brute_sets(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", words)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_join(rows):
    sets = [brute_sets(t) for _, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    ids = {}
    for (i, _), x in zip(rows, label, strict=True):
        ids.setdefault(x, []).append(i)
    least = {x: min((i for i in found if i is not None), default=None) for x, found in ids.items()}
    return sorted(((i, len(s), least[x]) for (i, _), s, x in zip(rows, sets, label, strict=True)), key=str)


def join_case(seed):
    """Near copies on both sides of the threshold, passages that many documents share, short texts."""
    rng = random.Random(seed)
    new = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passages = [new(30) for _ in range(4)]
    texts = [None, "", " \t\n", "One", "one", " ONE\n", "a b", "A\tB", "a b c d", "a b c d e", "a b c d e f", *["Same text here"] * 4]
    for _ in range(12):
        base = new(rng.choice([6, 9, 25, 80, 200])) + rng.choice([*passages, []])
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(max(2, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = new(1)[0]
            texts.append(" ".join(copy + new(rng.choice([0, 0, 1, 4]))))
    for _ in range(40):
        texts.append(" ".join(sum(rng.sample(passages, rng.randrange(1, 4)), []) + new(rng.choice([0, 1, 5, 20]))))
    texts += [" ".join(passages[0] * 40 + new(400)) * 3, texts[20], texts[21].upper()]
    rng.shuffle(texts)
    return [*enumerate(texts), (3, texts[40]), (None, texts[30]), (None, "alone at last in this long table"), (3, texts[3])]


@pytest.mark.parametrize(
    "limits", [{}, {"frequent": 2}, {"frequent": 1, "block_sets": 7}, {"frequent": 3, "block_tokens": 400}]
)
def test_join_against_all_pairs(docs_of, limits):
    rows = join_case(len(limits) + limits.get("frequent", 0))
    found = nj.join(docs_of(rows), **limits).collect()
    assert sorted(map(tuple, found), key=str) == brute_join(rows)


def test_join_of_nothing(docs_of):
    assert nj.join(docs_of([])).collect() == []
    assert sorted(map(tuple, nj.join(docs_of([(2, None), (1, "")])).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_similar_sets_share_a_key():
    """Any two similar sets, with any share of frequent tokens, have a key in common."""
    rng = np.random.default_rng(2)
    sieve = rng.integers(0, 256, 1 << 20).astype(np.uint8)
    for sieved in (sieve, np.full_like(sieve, 255), np.zeros_like(sieve), sieve | np.roll(sieve, 1)):
        for _ in range(150):
            n = int(rng.choice([2, 3, 4, 5, 9, 17, 40, 130, 700]))
            common = rng.integers(0, 2**64, n, np.uint64)
            more = int(rng.integers(0, n // 4 + 1))
            left = int(rng.integers(0, more + 1))
            a = np.unique(np.concatenate([common, rng.integers(0, 2**64, left, np.uint64)]))
            b = np.unique(np.concatenate([common, rng.integers(0, 2**64, more - left, np.uint64)]))
            keys = [nj.index_keys(x, sieved) for x in (a, b)]
            assert any(np.intersect1d(x, y).size for x, y in zip(*keys, strict=True))
            assert sum(map(len, keys[0])) <= 2.5 * len(a) + 4


def test_two_blocks_give_the_links_between_them():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 50, np.uint64)
    sets = [np.unique(np.concatenate([base[:k], rng.integers(0, 2**64, 50 - k, np.uint64)])) for k in rng.integers(30, 51, 40)]
    links = nj.link_block(sets, 25)
    assert all(x < 25 <= y for x, y in links)

    def labels(pairs):
        out = list(range(len(sets)))
        for x, y in pairs:
            out = [min(out[x], out[y]) if v in (out[x], out[y]) else v for v in out]
        return out

    similar = [
        (x, y) for x in range(25) for y in range(25, 40) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))
    ]
    assert labels(links) == labels(similar)


def similar_sets(rng, n):
    """Two sets of a Jaccard similarity of 0.8 or little less, at any difference of size."""
    common = rng.integers(0, 2**64, n, np.uint64)
    more = int(rng.integers(0, n // 4 + 2))
    left = int(rng.integers(0, more + 1))
    return [np.unique(np.concatenate([common, rng.integers(0, 2**64, k, np.uint64)])) for k in (left, more - left)]


def are_similar(a, b):
    both = len(np.intersect1d(a, b))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def test_sketches_lose_no_similar_pair():
    rng = np.random.default_rng(4)
    for _ in range(2_000):
        a, b = similar_sets(rng, int(rng.choice([1, 2, 3, 5, 16, 31, 33, 63, 64, 65, 127, 130, 513, 2050])))
        near = nj.may_be_similar(len(a), nj.sketch_of(a), len(b), nj.sketch_of(b))
        assert near or not are_similar(a, b)
        other = rng.integers(0, 2**64, len(a), np.uint64)
        assert len(a) < 33 or not nj.may_be_similar(len(a), nj.sketch_of(a), len(a), nj.sketch_of(other))


@pytest.mark.parametrize("first_part", [None, 45])
def test_near_block_connects_what_all_near_pairs_connect(first_part):
    rng = np.random.default_rng(5)
    sets = [x for n in (3, 30, 31, 62, 64, 70, 250, 260, 520) for _ in range(5) for x in similar_sets(rng, n)]
    base = rng.integers(0, 2**64, 130, np.uint64)
    sets += [np.concatenate([base[:k], rng.integers(0, 2**64, 130 - k, np.uint64)]) for k in rng.integers(90, 131, 30)]
    sets = [sets[i] for i in rng.permutation(len(sets))]
    sizes, sketches = np.array([len(s) for s in sets]), [nj.sketch_of(s) for s in sets]

    def labels(pairs):
        out = list(range(len(sets)))
        for x, y in pairs:
            out = [min(out[x], out[y]) if v in (out[x], out[y]) else v for v in out]
        return out

    pairs = [(x, y) for x in range(len(sets)) for y in range(x) if first_part is None or (x < first_part) != (y < first_part)]
    near = [(x, y) for x, y in pairs if nj.may_be_similar(sizes[x], sketches[x], sizes[y], sketches[y])]
    found = nj.near_block(sizes, sketches, first_part)
    assert len(found) < len(sets) and all(tuple(sorted(p, reverse=True)) in near for p in found)
    assert labels(found) == labels(near)


def test_sets_that_only_share_keys_are_in_no_cluster(docs_of, monkeypatch):
    """Else most sets of a large table are in one cluster, whose blocks are all compared with each other."""
    rng = random.Random(6)
    passages = [[f"p{k}x{i}" for i in range(24)] for k in range(14)]
    rows = []
    for i in range(150):
        words = sum(rng.sample(passages, rng.randrange(2, 5)), []) + [f"o{i}x{k}" for k in range(rng.randrange(8, 30))]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1] + " new") for i in range(5)]
    clustered, links_of = [], nj.links_of

    def seen(keyed, clusters, *rest):
        clustered.append(clusters.count())
        return links_of(keyed, clusters, *rest)

    monkeypatch.setattr(nj, "links_of", seen)
    found = nj.join(docs_of(rows), frequent=2).collect()
    expected = brute_join(rows)
    assert sorted(map(tuple, found), key=str) == expected
    linked = len(rows) - len({c for *_, c in expected})
    assert linked >= 5
    assert clustered[0] <= 2 * linked + 10


def test_as_few_tokens_are_rare_as_the_sieve_has_room_for(llm_spark):
    rows = [(list(range(k, 40)),) for k in range(40)]
    sets = llm_spark.createDataFrame(rows, "prefix array<long>")
    frequent = lambda most: sorted(r["token"] for r in nj.frequent_tokens(sets, 4, most).collect())
    # Token t is in t + 1 of the sets.
    assert frequent(1 << 20) == list(range(4, 40))
    assert frequent(35) == frequent(32) == list(range(8, 40))
    assert frequent(31) == list(range(16, 40))
    assert frequent(0) == []


def test_a_set_of_one_token_has_one_entry():
    batch = nj.pa.RecordBatch.from_pydict({"row_key": [1, 2], "text": ["one", "one two three four five six"]})
    full = np.full(1 << 20, 255, np.uint8)
    found = [b.column("n").to_pylist() for b in nj._longer_prefixes(iter([batch]), nj.SHINGLE, full, full)]
    assert found == [[2]]
