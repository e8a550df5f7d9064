import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from feedloom.llm import decontaminate, secrets, sharding, toxicity, url_filter

RULES = [("net/", "block", True), ("example.net/en/", "allow", True), ("a.org/x", "block", False)]


def test_urls_against_plain_rules(llm_spark):
    urls = [
        None, "", "no scheme", "http://Example.NET/en/1?q#f", "http://x.net", "http://x.net/", "ftp://net/a",
        "http://internet/", "https://a.ORG/x?y", "https://b.a.org/x", "a://b://c/d", "http://a.net/en/",
    ]
    pages = llm_spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id int, url string, entry string")
    entries = llm_spark.createDataFrame(RULES, "entry string, verdict string, is_rule boolean")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, entries).collect()}
    assert found == {
        0: ("", "", None, "allow"),
        1: ("", "", None, "allow"),
        2: ("", "", None, "allow"),
        3: ("example.net", "/en/1", "example.net/en/", "allow"),
        4: ("x.net", "", None, "allow"),
        5: ("x.net", "/", "net/", "block"),
        6: ("net", "/a", "net/", "block"),
        7: ("internet", "/", None, "allow"),
        8: ("a.org", "/x", None, "block"),
        9: ("b.a.org", "/x", None, "allow"),
        10: ("b:", "//c/d", None, "allow"),
        11: ("a.net", "/en/", "net/", "block"),
    }
    assert url_filter.judge(pages, entries.limit(0)).where("verdict = 'allow'").count() == len(urls)
    assert url_filter.judge(pages.limit(0), entries).collect() == []


def test_licence_pages_are_listed_whatever_they_end_in(llm_spark):
    urls = [
        ("https://a.org/en/1/", "CC BY-NC"), ("https://a.org/en/1/sub", ""), ("https://b.a.org/en/1/", ""),
        ("https://c.org/x", "CC BY-NC"), ("https://a.net/", "CC BY-NC"), ("https://b.net/", ""), ("https://net/", "CC BY-NC"),
    ]
    pages = llm_spark.createDataFrame([(i, *u) for i, u in enumerate(urls)], "page_id int, url string, html string")
    rules = llm_spark.createDataFrame([("net/", "allow", True)], "entry string, verdict string, is_rule boolean")
    listed = rules.unionByName(url_filter.noncommercial_pages(pages), allowMissingColumns=True)
    found = {r.page_id: (r.rule, r.verdict, r.listed) for r in url_filter.judge(pages, listed).collect()}
    assert found == {
        0: (None, "block", True),
        1: (None, "allow", False),
        2: (None, "allow", False),
        3: (None, "block", True),
        4: ("net/", "allow", True),
        5: ("net/", "allow", False),
        6: ("net/", "allow", True),
    }


def test_filter_has_no_false_negatives(llm_spark):
    keys = llm_spark.range(3000).selectExpr("concat('h', id, '/p') AS entry")
    probed = url_filter.probe(keys.selectExpr("entry AS key0"), url_filter.build_filter(keys, 64), 64, ["key0"])
    assert probed.where("size(maybe) = 1").count() == 3000


def brute_windows(docs, items, span):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())

    windows = []
    for item, text in items:
        w = words(text)
        n = min(len(w), span)
        windows += [(str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = {}
    for i, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for item, window in windows:
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit.update(range(s, s + len(window)))
                    ids.add(item)
        out[i] = (len(w), len(hit), len(ids), bool(hit))
    return out


def test_decontamination_against_brute_force(llm_spark, docs_of):
    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randrange(6)}" for _ in range(rng.choice([1, 2, 4, 7, 9, 10, 11, 25])))) for i in range(12)]
    items += [(20, None), (21, "?!")]
    docs = [(0, None), (1, ""), (2, items[0][1].upper())]
    for i in range(3, 40):
        words = [f"x{rng.randrange(9)}" for _ in range(rng.randrange(1, 40))]
        at = rng.randrange(len(words))
        words[at:at] = rng.choice(items)[1].split() if rng.random() < 0.6 and items[0][1] else []
        docs.append((i, " ".join(words)))
    docs = [(i, t) for i, t in docs]
    bench = llm_spark.createDataFrame(items, "item_id int, text string")
    found = decontaminate.find(docs_of(docs), bench).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found} == brute_windows(docs, items, 10)
    assert not any(r.contaminated for r in decontaminate.find(docs_of(docs), bench.limit(0)).collect())
    assert decontaminate.find(docs_of([]), bench).collect() == []


def test_secret_patterns():
    text = 'é API_KEY="abcdef" token: x password = short1 AKIA' + "A" * 16 + " AKIAB " + "0f" * 12 + " ſecret=abcdefgh"
    spans = [(kind, text[a:b]) for a, kind, b in secrets.base_spans(text)]
    assert spans == [
        (0, 'API_KEY="abcdef'), (0, "password = short1"), (1, "AKIA" + "A" * 16), (2, "0f" * 12),
    ]


def test_randomness_battery():
    rng = random.Random(8)
    alphabet = secrets.UPPER + secrets.UPPER.lower() + secrets.DIGITS
    tokens = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(50)]
    assert sum(secrets.discoveries([t])[0] for t in tokens) >= 48
    words = ["internationalization", "aaaaaaaaaaaaaaaaaaaaaaaa", "donaudampfschifffahrt", "abcabcabcabcabcabcabc"]
    assert not any(secrets.discoveries(words))


def test_values_behind_equals_signs_are_tested():
    rng = random.Random(12)
    alphabet = secrets.UPPER + secrets.UPPER.lower() + secrets.DIGITS
    found = 0
    for _ in range(50):
        token = "".join(rng.choice(alphabet) for _ in range(40))
        for text in (f"AWS_SECRET_ACCESS_KEY={token}", f"see https://x.org/f?sig={token}&v=1", f"X=={token}=="):
            spans = [text[a:b].rstrip("=") for a, _, b in secrets.random_spans(text, secrets.base_spans(text))]
            assert spans in ([], [token])
            found += spans == [token]
    assert found >= 140
    assert secrets.CANDIDATE.findall("A" * 18 + "======") == ["A" * 18 + "======"]


def test_scan_defines_null_and_empty(docs_of):
    found = secrets.scan(docs_of([(1, None), (2, ""), (None, "token=abcdef")])).collect()
    assert [(r.doc_id, r.n_assign, r.spans) for r in found] == [(1, 0, ""), (2, 0, ""), (None, 1, "assign:0:12")]


def test_shards_move_only_into_the_new_one(docs_of):
    docs = docs_of([(i, None if i == 3 else f"é{i}") for i in range(2000)] + [(None, "a"), (5, "é5")])
    rows = sharding.shard_records(docs, [1.0] * 7, [1.0] * 8, chunk_rows=50).collect()
    assert all(r.grown_shard in (r.shard, 7) for r in rows)
    assert {r.shard for r in rows} == set(range(7))
    for shard in range(7):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].size == 16 and by_id[3].text_crc32 == 0
    assert by_id[7].size == 19 and by_id[7].text_crc32 == zlib.crc32("é7".encode())
    again = {r.doc_id: r.shard for r in sharding.shard_records(docs.limit(0).union(docs), [1.0] * 7).collect()}
    assert again == {r.doc_id: r.shard for r in rows}


def test_equal_records_are_numbered_in_many_tasks(docs_of):
    """A third of all rows are equal: their slots are made in parts, without a gap."""
    docs = docs_of([(i, "a") for i in range(600)] + [(7, "same")] * 300 + [(None, None)] * 45)
    frame = sharding.shard_records(docs, [1.0] * 3, chunk_rows=40)
    rows = frame.collect()
    assert len(rows) == 945
    for shard in range(3):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.slot for r in rows if r.doc_id == 7}) == 301
    assert sharding.shard_records(docs_of([]), [1.0]).collect() == []


def test_filter_grows_with_the_list_up_to_a_bound():
    sizes = [url_filter.filter_blocks(n) for n in (0, 1, 16, 17, 10**5, 10**9)]
    assert sizes == [1, 1, 1, 2, 6250, url_filter.MOST_BLOCKS]


def test_sample_is_bounded_by_rows(llm_spark, docs_of):
    """One id on very many rows: the sample takes no more rows than it may."""
    docs = docs_of([(1, f"text {i}") for i in range(3000)] + [(2, "same")] * 500 + [(i, "other") for i in range(3, 60)])
    labels = llm_spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id bigint, toxic int")
    held = []
    real = toxicity.stage
    toxicity.stage = lambda df, label: held.append((label, real(df, label))) or held[-1][1]
    try:
        toxicity.train(docs, labels, sample_rows=40)
    finally:
        toxicity.stage = real
    assert dict(held)["toxicity-sample"].count() <= 40


def test_weights_share_the_records(docs_of):
    rows = sharding.shard_records(docs_of([(i, "") for i in range(3000)]), [1.0, 3.0]).collect()
    assert 0.70 < sum(r.shard for r in rows) / 3000 < 0.80
    with pytest.raises(ValueError):
        sharding.rendezvous(None, [0.0])


def toxic_rows():
    rng = random.Random(9)
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["idiot", "zorgle", "zorgwick"])
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


def test_toxicity_on_held_out_rows(llm_spark, docs_of):
    rows = toxic_rows()
    docs = docs_of([(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (None, "idiot")])
    labels = llm_spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    found = toxicity.score(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert len(found) == len(rows) + 3 and all(0 <= r.score <= 1 for r in found)


def test_toxicity_without_labels(llm_spark, docs_of):
    labels = llm_spark.createDataFrame([], "doc_id bigint, toxic int")
    found = toxicity.score(docs_of([(1, "you idiot"), (2, "kind words")]), labels).collect()
    assert [(r.doc_id, r.predicted) for r in found] == [(1, 1), (2, 0)]


def test_features_are_finite_for_odd_texts():
    for text in (None, "", "!!!", "\x00", "i d i o t", "1d10t", "A" * 100_000):
        assert all(math.isfinite(v) for v in toxicity.features_of(text, {}))


CLASHES = ("_id", "_key", "_gone", "_kept", "row_id", "row_key", "gone", "kept", "text_key", "label")


def test_decisions_tell_rows_without_or_with_one_id_apart(llm_spark, docs_of):
    bad, good = "you idiot", "kind words for all"
    for i in (None, 3):
        docs = docs_of([(i, bad), (i, good), (i, None)]).withColumns({c: F.lit(1) for c in CLASHES})
        labels = llm_spark.createDataFrame([], "doc_id bigint, toxic int")
        kept = toxicity.accepted(docs, labels).collect()
        assert {r.text for r in kept} == {good, None}
        bench = llm_spark.createDataFrame([(1, bad)], "item_id int, text string")
        kept = decontaminate.clean(docs, decontaminate.find(docs, bench, keyed=True)).collect()
        assert {r.text for r in kept} == {good, None}
