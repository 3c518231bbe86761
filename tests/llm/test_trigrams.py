"""Trigram queries: read off the regex, and satisfied by every text with a match."""
import random
import re
from re import _parser

import pytest

from quarry.llm import secret_scan
from quarry.llm.secret_scan import RULES, Rule, build_index, candidates, query_trigrams, scan
from quarry.llm.trigram_query import satisfied, trigram_query


def sample(nodes, rng):
    """A random text that a parsed regex matches."""
    out = ""
    for kind, value in nodes:
        kind = str(kind)
        if kind == "LITERAL":
            out += chr(value)
        elif kind == "IN":
            if str(value[0][0]) == "NEGATE":
                banned = [v for k, v in value[1:] if str(k) == "LITERAL"]
                out += rng.choice([c for c in "abXYZ019%!" if ord(c) not in banned])
            else:
                k, v = rng.choice(value)
                out += chr(v) if str(k) == "LITERAL" else chr(rng.randint(*v))
        elif kind == "ANY":
            out += rng.choice("abc é")
        elif kind == "SUBPATTERN":
            text = sample(value[3], rng)
            out += "".join(rng.choice([c.upper(), c.lower()]) if c.isascii() else c for c in text) if value[1] & re.I else text
        elif kind == "BRANCH":
            out += sample(rng.choice(value[1]), rng)
        elif "REPEAT" in kind:
            low, high, inner = value
            for _ in range(rng.randint(low, min(int(high), low + 3))):
                out += sample(inner, rng)
    return out


REGEXES = [r.regex for r in RULES] + [r"ab(c|d)?e{2}fgh+i", r"(?:foo|ba[rz]){2,}qux", r"x*", r"abc|de", r"a.bcd", r"[a-z]{3}key", r"(ab){3}", r"^start(?=x)", r"(?:abc)+?defg", r"Grüße{1,3}!", r"(?:|abc)def", r"a[^b]cde|fgh"]


@pytest.mark.parametrize("regex", REGEXES)
def test_query_admits_every_match(regex):
    rng, query = random.Random(7), trigram_query(regex)
    for _ in range(300):
        text = sample(_parser.parse(regex), rng)
        if re.search(regex, text):
            assert satisfied(query, "zz " + text + " zz"), (text, query)


def test_queries_by_hand():
    q = trigram_query
    assert q("abc") == "abc" and q("ABCd") == ("and", ("abc", "bcd")) and q("ab") is True and q("[0-9a-f]{16,}") is True and q("(") is True
    assert q("abc|xyz") == ("or", ("abc", "xyz")) and q("abc|x") is True and q("a[bc]d") == ("or", ("abd", "acd")) and q("a[b-z]d") is True
    assert q("abc.*xyz") == ("and", ("abc", "xyz")) and q("ab?cde") == ("or", (("and", ("abc", "bcd", "cde")), ("and", ("acd", "cde"))))
    assert q("(?:abc)*xyz") == "xyz" and q("abc{2}") == ("and", ("abc", "bcc")) and q("(?i:KEY)") == "key"
    assert q("colou?rs") == ("or", (("and", ("col", "olo", "lor", "ors")), ("and", ("col", "olo", "lou", "our", "urs")))) and q("key[\"']?") == "key"
    assert not satisfied(q("abc|xyz"), "ab cxy z") and satisfied(q("abc|xyz"), "XYZ")


def test_postings_and_candidates(spark):
    texts = ["api_key = x", "the pass and the word", "password", "AKIA then", "a://b", None, "", "password"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    index = build_index(docs).collect()
    assert {r.trigram for r in index} <= set(query_trigrams(RULES)) and any(r.trigram == "://" for r in index)
    assert candidates(build_index(docs), RULES).count() == 4  # equal texts are one row
    plain = (Rule("digits", "[0-9]{3,}", 3),)
    assert [len(r.secrets) for r in scan(docs.limit(3), plain).collect()] == [0, 0, 0]
    assert scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("words", [1 << 20, 1])
def test_scan_keeps_clashing_columns_and_repeated_rows(spark, monkeypatch, words):
    monkeypatch.setattr(secret_scan, "FILTER_WORDS", words)
    rows = [("password=abcdefghijkl", 1, 2, "x")] * 3 + [("0123456789abcdef", 1, 2, "x"), (None, None, None, None), ("no secret", 0, 0, "y")]
    docs = spark.createDataFrame(rows, "text string, secrets int, row int, rules string")
    got = scan(docs, output="secrets").collect()
    assert sorted([(s.kind, s.start, s.end) for s in r.secrets] for r in got) == [[], [], *[[("assign", 0, 21)]] * 3, [("hex", 0, 16)]]
    assert sorted(str((r.row, r.rules)) for r in got) == sorted(str(r[2:]) for r in rows)


def test_scan_does_not_shuffle_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0] and "SortMergeJoin" not in plan
