"""Decontamination against brute force: repeated words, short items, null and repeated ids, a full filter."""
import random
import re
import time

import pytest

from quarry.llm import decontaminate
from quarry.llm.decontaminate import find_overlaps, overlap_counts


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench):
    known = {}
    for item, text in bench:
        ws = words(text)
        n = min(8, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            known.setdefault(tuple(ws[k:k + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        ws, hit, items = words(text), set(), set()
        for n in range(1, 9):
            for k in range(len(ws) - n + 1):
                if (g := tuple(ws[k:k + n])) in known:
                    hit.update(range(k, k + n))
                    items |= known[g]
        out.append((doc_id, len(ws), len(hit), sorted(items, key=str.encode)))
    return sorted(map(str, out))


@pytest.mark.parametrize("bits", [1 << 26, 1 << 10])
def test_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    rng = random.Random(5)
    bench = [(k if k % 7 else None, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for k in range(60)] + [(5, None), (99, "a " * 30)]
    docs = [(rng.choice([k, None, 3]), " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for k in range(300)] + [(1, None), (2, ""), (7, "A-b A-b " * 50), (7, "A-b A-b " * 50)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    assert sorted(str((r[0], r[1], r[2], list(r[3]))) for r in overlap_counts(d, b, ["doc_id"]).collect()) == want
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, list(r["items"]))) for r in find_overlaps(d, b).collect()) == want


def test_given_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert sorted(str((r[0], r[1], r[2], list(r[3]))) for r in overlap_counts(docs, bench, ["doc_id"]).collect()) == want


def test_equal_words_take_no_pairs_of_places(spark):
    docs = spark.createDataFrame([(1, "a " * 100_000), (2, "b " * 3 + "a " * 20_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a " * 20_000), (2, "a " * 100_000)], "item_id long, text string")
    began = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in overlap_counts(docs, bench, ["doc_id"]).collect()}
    assert got == {1: (100_000, 100_000, ["1", "2"]), 2: (20_003, 20_000, ["1", "2"])} and time.time() - began < 60


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([("one two three four five six seven eight", 1, "x", "y", 7)], "text string, n_words int, key string, items string, found int")
    bench = spark.createDataFrame([("i", "One two, three four five six seven eight nine")], "item_id string, text string")
    row = find_overlaps(docs, bench).first()
    assert (row.n_words, row.n_hit, row["items"], row.key, row.found) == (8, 8, ["i"], "x", 7)
    row = overlap_counts(docs, bench, ["key", "found"]).first()
    assert tuple(row) == ("x", 7, 8, 8, ["i"])
    assert overlap_counts(docs.limit(0), bench, ["key"]).count() == 0 and find_overlaps(docs.limit(0), bench).count() == 0
    assert [tuple(r) for r in overlap_counts(docs, bench.limit(0), ["key"]).collect()] == [("x", 8, 0, [])]
