import math
import random
import zlib
from collections import Counter

import pytest
import sentencepiece as library

import brute_tree

from feedloom.llm import sentencepiece, suffix_tree
from feedloom.llm.queries import PIECES


@pytest.fixture(scope="module")
def transducer():
    with open(PIECES, "rb") as model:
        return sentencepiece.Transducer(model.read())


def texts():
    rng = random.Random(10)
    letters = "aetshinor  .\n\té\u00dfß中文字😀A1,;()"
    out = ["", " ", "  a  b ", "Hello world", "x" * 3000, "\x00\x01", "naïve café\n\n", "a" * 49 + " " + "ab" * 60]
    return out + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]


def test_shortest_paths_equal_the_library(transducer):
    reference = library.SentencePieceProcessor(model_file=PIECES)
    assert [x.tolist() for x in transducer.encode_all(texts())] == reference.encode(texts())


def test_single_lattice_equals_many_at_once(transducer):
    for word in ("▁onenble", "▁the", "é😀x", "▁▁▁a"):
        assert transducer._paths([word]) == [transducer._ids(word)]


def test_unigram_path_is_least():
    def piece(text, score, kind=1):
        import struct

        body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    model = piece("<unk>", 0, 2) + b"".join(
        piece(t, s) for t, s in [("▁", -1.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("▁a", -2.5), ("▁ab", -9.0)]
    )
    unigram = sentencepiece.Transducer(model)
    assert unigram.shortest_path("▁ab") == ["▁", "ab"]
    assert unigram.encode("abz")[-1] == 0


def test_round_trip_in_spark(docs_of):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, None)]
    encoded = sentencepiece.encode(docs_of(rows), PIECES)
    decoded = sentencepiece.decode(encoded, PIECES).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in decoded[:-1]) == sorted((str(i), t) for i, t in rows[:-1])
    assert decoded[-1].decoded is None
    assert sentencepiece.digests(docs_of([]), PIECES).collect() == []


def test_language_model_scores(docs_of):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["the cat sat", "a dog ran", f"n{rng.randrange(40)}"]) for _ in range(20))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "never seen é words"), (None, "the cat")]
    for head in (100_000, 3):
        found = {r.doc_id: r for r in suffix_tree.score_documents(docs_of(rows), head_tokens=head).collect()}
        counts, ends = Counter(), 0

        def held(i):
            return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1

        for i, t in rows:
            if not held(i):
                counts.update((t or "").lower().split())
                ends += 1
        total, kinds = sum(counts.values()) + ends, len(counts) + 1
        for i, t in rows:
            tokens = (t or "").lower().split()
            values = [*(counts[w] for w in tokens), ends]
            base = sum(math.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) for c in values)
            r = found[i]
            assert (r.held_out, r.n_tokens, r.train_tokens) == (held(i), len(tokens) + 1, total)
            assert r.n_known == sum(c > 0 for c in values)
            assert r.base_score == pytest.approx(base)
            assert r.score < 0
    ordinary = found[1].score / found[1].n_tokens
    assert found[1002].score / found[1002].n_tokens < ordinary


def test_all_contexts_that_pass_stay(llm_spark):
    # 70,000 contexts of three codes; those with a common suffix have different followers.
    window = "((id + 1) << 6) | (1 + id % 62)"
    windows = llm_spark.range(70_000).selectExpr(f"{window} AS window", "200L AS n")
    kept = suffix_tree.retained(windows).where("depth = 3").select("context").distinct()
    assert kept.count() == 70_000


def test_scores_equal_those_of_the_tree_in_memory(llm_spark, docs_of):
    import numpy as np

    rng = random.Random(13)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, range(1, 61), k=40))) for i in range(300)] + [(500, None), (501, "zz qq")]
    training = [suffix_tree.tokens_of(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    symbols = [np.frombuffer(b" ".join(t), np.uint8) for t in training]
    byte_counts = sum(np.bincount(x, minlength=256) for x in symbols)
    alphabet = suffix_tree.alphabet_of(byte_counts)
    counts = Counter(k for t in training for k in suffix_tree.windows_of(suffix_tree._coded(t, alphabet)).tolist())
    windows = llm_spark.createDataFrame(list(counts.items()), "window long, n long")
    brute = brute_tree.retained(counts)
    found = suffix_tree.retained(windows).select("depth", "context", "symbol", "n").collect()
    assert {tuple(r) for r in found} == brute and len(found) == len(brute)
    columns = np.array(sorted(brute), np.int64).T
    tree = brute_tree.Tree(tuple(columns), byte_counts, alphabet)
    assert set(tree.depths) == set(range(6))
    for head_windows in (suffix_tree.HEAD_WINDOWS, 40, 0):
        found = suffix_tree.score_documents(docs_of(rows), head_windows=head_windows).collect()
        assert {r.doc_id: r.score for r in found} == {
            i: pytest.approx(tree.score(suffix_tree.tokens_of(t)), rel=1e-5) for i, t in rows
        }


def test_language_model_of_nothing(docs_of):
    assert suffix_tree.score_documents(docs_of([])).collect() == []


def test_distributions_sum_to_one(docs_of):
    import numpy as np

    counts = np.zeros(256, np.int64)
    counts[97:101] = 5
    depth, context, symbol, n = (np.array(x) for x in ([0, 0, 1, 2], [0, 0, 1, 65], [1, 2, 2, 1], [6, 4, 3, 2]))
    tree = brute_tree.Tree((depth, context, symbol, n), counts, suffix_tree.alphabet_of(counts))
    assert np.allclose((10.0 ** tree.logs.astype(float)).sum(axis=1), 1, atol=1e-5)
