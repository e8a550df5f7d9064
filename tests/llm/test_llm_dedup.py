import hashlib
import itertools
import random
import re

import numpy as np
import xxhash

from feedloom.llm import exact_dedup, line_dedup, simhash
from feedloom.llm.components import components


def random_text(rng, words=30, vocabulary=40):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def test_perfect_hash_is_minimal_and_checks_bytes():
    keys = np.frombuffer(np.random.default_rng(1).bytes(32 * 3000), np.uint8).reshape(-1, 32)
    sizes, bits = exact_dedup.build_bits(keys)
    assert sorted(exact_dedup.slots_of(keys, sizes, bits)) == list(range(3000))
    assert int(bits.sum()) == 3000


def test_exact_dedup_against_brute_force(docs_of):
    rng = random.Random(2)
    texts = [None, "", " ", "a b", "a\t\nb", "a  b", "x" * 50_000, *(f"t{rng.randrange(30)}" for _ in range(200))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a b"), (None, "a b"), (None, "alone")]
    docs = docs_of(rows)
    found = exact_dedup.dedup(*exact_dedup.halves(docs), keys_per_bucket=16).collect()

    def normal(t):
        return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")

    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    expected = []
    for i, t in rows:
        ids = [x for x in groups[normal(t)] if x is not None]
        keep = min(ids) if ids else None
        expected.append((i, keep, len(groups[normal(t)]), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    key = str
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


def test_exact_dedup_of_nothing(docs_of):
    assert exact_dedup.dedup(*exact_dedup.halves(docs_of([]))).collect() == []


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_simhash_against_brute_force(docs_of):
    rng = random.Random(3)
    base = [random_text(rng, 120) for _ in range(20)]
    texts = [None, "", "one", "Two words", *base]
    for t in base:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts += [" ".join(words), t.upper(), t + " tail"]
    rows = list(enumerate(texts))
    prints = {i: brute_fingerprint(t) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    label = brute_components(prints, pairs)
    for block in (4096, 3):
        found = simhash.near_duplicates(docs_of(rows), block=block).collect()
        assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in found} == {
            i: (prints[i], label[i]) for i in prints
        }


def test_golay_keys_meet_for_all_close_fingerprints():
    rng = random.Random(4)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(4)):
            b ^= 1 << bit
        rows, keys = simhash.keys_of(np.array([a, b], np.uint64))
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_simhash_blocks_give_the_same_reach():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 10, 60).astype(np.uint64))
    whole = simhash.spanning_links(fps, None, 1)
    half = len(fps) // 2
    parts = simhash.spanning_links(fps[:half], None, 1) + simhash.spanning_links(fps[half:], None, 1)
    parts += simhash.spanning_links(fps[:half], fps[half:], 1)
    nodes = fps.tolist()
    assert brute_components(nodes, whole) == brute_components(nodes, parts)


def test_simhash_of_nothing(docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []


def test_components_of_a_chain(llm_spark):
    links = llm_spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    label = {r.node: r.label for r in components(links).collect()}
    assert label == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def brute_repeated(rows):
    lines = []
    for i, text in rows:
        for n, line in enumerate(text.split("\n") if text is not None else []):
            words = line.encode().lower().split()
            if words:
                tokens = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
                lines.append(((i, n), tokens, words))
    gone = set()
    for place, tokens, words in lines:
        for other, more, before in lines:
            if other < place and (words == before or 9 * len(tokens & more) >= 4 * (len(tokens) + len(more))):
                gone.add(place)
    return gone


def test_line_dedup_against_brute_force(docs_of):
    rng = random.Random(6)
    base = [random_text(rng, rng.randrange(1, 60), 500) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "a\nA\nb  b\nb\tb")]
    for i in range(10, 60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(base).split()
            if rng.random() < 0.6:
                words[rng.randrange(len(words))] = f"new{i}"
            if rng.random() < 0.3:
                words.append("end")
            lines.append(" ".join(words))
        rows.append((i, "\n".join(lines)))
    docs = docs_of(rows)
    repeated = line_dedup.repeated_lines(docs)
    expected = brute_repeated(rows)
    assert {(r.doc_id, r.line_no) for r in repeated.collect()} == expected
    assert any(n for n in expected)
    kept = {r.doc_id: r.text for r in line_dedup.without_lines(docs, repeated).collect()}
    for i, text in rows:
        left = None if text is None else [x for n, x in enumerate(text.split("\n")) if (i, n) not in expected]
        assert kept.get(i) == (None if not left else "\n".join(left))
    assert len(line_dedup.without_lines(docs, repeated).columns) == len(docs.columns)


def test_line_dedup_of_nothing(docs_of):
    docs = docs_of([])
    assert line_dedup.report(docs, line_dedup.repeated_lines(docs)).collect() == []


def test_lines_of_rows_without_or_with_one_id(docs_of):
    same, own = "one two three four five six", ["alpha beta", "gamma delta", "epsilon zeta"]
    for i in (None, 7):
        docs = docs_of([(1, same), (i, f"{own[0]}\n{own[1]}"), (i, f"{same}\n{own[2]}"), (i, f"{same}\n{own[2]}")])
        repeated = line_dedup.repeated_lines(docs)
        kept = [r.text for r in line_dedup.without_lines(docs, repeated).collect()]
        lines = [line for t in kept for line in t.split("\n")]
        # A row without an id comes before others.
        assert sorted(set(lines)) == sorted({same, *own})
        assert f"{own[0]}\n{own[1]}" in kept and len(kept) == (4 if i else 3)
        assert lines.count(same) == (1 if i else 2)
        n_removed = [r.n_removed for r in line_dedup.report(docs, repeated).collect()]
        assert sorted(n_removed) == ([0, 0, 1, 1] if i else [0, 0, 0, 1])


def test_one_of_each_component_stays_whatever_its_id(docs_of):
    rng = random.Random(14)
    a, b, c, d = (random_text(rng, 60, 1000) for _ in range(4))
    docs = docs_of([(1, a), (None, a), (5, a), (5, b), (None, c), (None, c), (None, c.upper()), (None, d), (9, None)])
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs, keyed=True)).collect()
    assert sorted(str((r.doc_id, (r.text or "").lower())) for r in kept) == sorted(
        map(str, [(1, a), (5, b), (None, c), (None, d), (9, "")])
    )


def test_lines_of_one_passage_are_not_paired_with_each_other(docs_of, monkeypatch):
    rng = random.Random(16)
    passage = "pa pb pc pd pe pf"
    filler = lambda n: " ".join(f"w{rng.randrange(10)}" for _ in range(n))
    rows = [(i, f"{filler(10)} {passage} {filler(10)}") for i in range(300)]
    # Near copies of one line, with one to three other words each.
    base = [f"b{k}" for k in range(60)]
    for i in range(300, 400):
        words = list(base)
        for k in rng.sample(range(60), rng.randrange(4)):
            words[k] = rng.choice(("x", "y"))
        rows.append((i, " ".join(words)))
    staged, write = [], line_dedup.stage

    def counted(df, label):
        out = write(df, label)
        staged.append((label, out.count()))
        return out

    monkeypatch.setattr(line_dedup, "stage", counted)
    found = line_dedup.repeated_lines(docs_of(rows)).collect()
    assert {(r.doc_id, r.line_no) for r in found} == brute_repeated(rows)
    assert any(r.doc_id >= 300 for r in found)
    assert sum(n for label, n in staged if label == "line-pairs") < 10 * len(rows)


def test_lines_of_frequent_tokens_are_rarely_sorted_again(docs_of, monkeypatch):
    rng = random.Random(17)
    filler = lambda: [f"w{rng.randrange(10**6)}" for _ in range(40)]
    # Long words come first in the order of tokens: the passage stands in all prefixes.
    passage = [f"passage{k}ofmanylines" for k in range(6)]
    rows = [(i, " ".join(passage + filler())) for i in range(100)]
    # Near copies of one line; lines of the passage with near copies of their own; short lines of nothing but frequent tokens.
    base = filler() + filler()
    rows += [(i, " ".join(base[:20] + [f"n{i}"] + base[21:])) for i in range(100, 150)]
    rows += [(i + 150, text + " end") for i, text in rows[:20]]
    rows += [(i, " ".join([*passage, "same", "words", "here", *["again"] * (i - 170)])) for i in range(170, 176)]
    rows += [(i, " ".join(["again"] * (i - 170))) for i in range(176, 180)]
    crowded, write = [], line_dedup.stage

    def counted(df, label):
        out = write(df, label)
        crowded.append(out.count() if label == "crowded-lines" else 0)
        return out

    monkeypatch.setattr(line_dedup, "stage", counted)
    found = line_dedup.repeated_lines(docs_of(rows)).collect()
    expected = brute_repeated(rows)
    assert {(r.doc_id, r.line_no) for r in found} == expected
    assert {i for i, _ in expected} >= {*range(101, 170)}
    assert sum(crowded) <= 60


def test_words_differ_by_letters_beyond_ascii(llm_spark):
    words = ["\u00c9t", "\u00e9t", "\u0420", "\u0440", "\u00f7", "\u00d7", "\u00df", "\u20ac", "\U0001f600", "\u0130", "\u00b5", "\u0085", "\u00a0"]
    frame = llm_spark.createDataFrame([(" A\tB\x0bc\x0c\rD" + "".join(f"  {w}" for w in words),)], "line string")
    found = frame.select(line_dedup.words_of(frame.line)).first()[0]
    assert found[:4] == ["a", "b", "c", "d"] and len(found) == len(set(found)) == 4 + len(words)


def test_the_two_hashes_of_a_line_are_independent(docs_of):
    texts = [f"a{i} b{i} c" for i in range(50)]
    lines = line_dedup._tokenised(line_dedup.lines_of(docs_of([(i, t) for i, t in enumerate(texts)])), 5)
    rows = lines.select("h1", "h2").collect()
    assert len({r.h1 for r in rows}) == len({r.h2 for r in rows}) == 50
    assert all(r.h2 != _int_behind(r.h1) for r in rows)


def _int_behind(seed):
    """Spark's xxhash64 of a value with hash `seed`, followed by the int 1."""
    value = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), seed % 2**64)
    return value - 2**64 if value >= 2**63 else value
