import hashlib
import itertools
import random

import sentencepiece as library

import corpus_pipeline
from feedloom.llm.queries import PIECES
from test_llm_dedup import brute_components, brute_fingerprint

DOCS = "doc_id bigint, text string, lang string, n_chars bigint, _id int, _key int, _gone int, kept int, row_id int"


def write(spark, folder, docs, benchmark):
    tables = {
        "documents": spark.createDataFrame([(i, t, "en", 0, 1, 2, 3, 4, 5) for i, t in docs], DOCS),
        "labels": spark.createDataFrame([], "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame(benchmark, "item_id bigint, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def lines_left(docs):
    """Texts without lines that an earlier line repeats, word by word; none of the fixture's lines is only similar."""
    seen, out = set(), []
    for i, text in docs:
        kept = []
        for line in (text or "").split("\n"):
            words = " ".join(line.lower().split())
            if not words or words not in seen:
                kept.append(line)
            seen.add(words)
        if text is None or kept:
            out.append((i, None if text is None else "\n".join(kept)))
    return out


def brute_chain(docs, benchmark):
    docs = [(i, t) for i, t in docs if "idiot" not in (t or "")]
    docs = lines_left(docs)
    prints = {i: brute_fingerprint(t) for i, t in docs}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    label = brute_components(list(prints), linked)
    docs = [(i, t) for i, t in docs if label[i] == i]

    def windows(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 10]) for i in range(len(words) - 9)}

    bad = set().union(*(windows(t) for _, t in benchmark))
    docs = [(i, t) for i, t in docs if not windows(t) & bad]
    model = library.SentencePieceProcessor(model_file=PIECES)
    out = []
    for i, text in docs:
        ids = model.encode(text or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    return sorted(out)


def fixture():
    rng = random.Random(21)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    shared = text(12)
    item = text(14)
    docs = [(i, f"{text(40)}\n{text(30)}") for i in range(30)]
    docs[3] = (3, "you idiot")
    docs[5] = (5, f"{docs[5][1]}\n{shared}")
    docs[9] = (9, f"{shared.upper()}\n{docs[9][1]}")
    docs[11] = (11, docs[10][1])
    docs[13] = (13, f"{docs[13][1]}\n{item}")
    docs[15] = (15, text(30_000))
    base = text(300)
    docs += [(40, base), (41, base + " tail"), (50, None), (51, ""), (52, " ")]
    return docs, [(1, item), (2, None)]


def test_pipeline_against_brute_force(llm_spark, tmp_path):
    docs, benchmark = fixture()
    sf = write(llm_spark, tmp_path, docs, benchmark)
    found = corpus_pipeline.run(llm_spark, sf).collect()
    assert sorted((r.doc_id, r.n_ids, r.ids_sha256) for r in found) == brute_chain(docs, benchmark)
    kept = {r.doc_id for r in found}
    assert 3 not in kept and 13 not in kept and 11 not in kept and {0, 5, 9, 15, 40} <= kept


def test_stages_keep_the_columns_and_take_an_empty_table(llm_spark, tmp_path):
    docs, benchmark = fixture()
    sf = write(llm_spark, tmp_path, [], benchmark)
    rows = llm_spark.read.parquet(f"{sf}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        result = step(llm_spark, rows, sf)
        assert result.collect() == []
        if name != "sentencepiece":
            assert result.schema.names == rows.schema.names


def test_rows_without_or_with_one_id(llm_spark, tmp_path):
    """Rows that share an id, or have none, are judged by their own texts; equal rows give one."""
    docs, benchmark = fixture()
    texts = [docs[0][1], docs[3][1], docs[13][1], docs[7][1], docs[7][1]]
    for n, i in enumerate((None, 8)):
        sf = write(llm_spark, tmp_path / str(n), [(i, t) for t in texts], benchmark)
        found = corpus_pipeline.run(llm_spark, sf).collect()
        assert len(found) == 2 and {r.doc_id for r in found} == {i}
