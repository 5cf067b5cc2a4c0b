"""The url vocabulary against brute force, given as a table."""

import random
import re

import pytest

from shardwright.llm import url_filter


def brute(url, terms, limit):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    hit = {t for t in terms if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low)}
    soft = [terms[t] for t in hit if terms[t] is not None]
    strict = any(terms[t] is None for t in hit)
    return strict, len(soft), "block" if strict or (len(soft) >= 2 and sum(soft) >= limit) else "allow"


def test_a_vocabulary_of_differing_weights(spark):
    rnd = random.Random(6)
    pool = ["ab", "abc", "b", "c-ab", "dd", "ee/ff", "g.h", "ij", "klm", "no", "é"]
    terms = {t: rnd.choice([None, 10, 30, 45, 70, 100, 250]) for t in pool}
    vocabulary = [*terms.items(), ("DD", 1), ("", 500), (None, None)]
    terms["dd"] = terms["dd"] if terms["dd"] is None else max(terms["dd"], 1)
    urls = [None, "", "no scheme", "http://x.org/" + "ab-" * 100_000 + "klm"]
    urls += ["http://x.org/" + "".join(rnd.choice([*pool, "-", "/", "X", "7", "AB", "É"]) for _ in range(rnd.randrange(1, 9)))
             for _ in range(600)]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, term string")
    table = spark.createDataFrame(vocabulary, "term string, weight long")
    out = {r["page_id"]: r for r in url_filter.judge(pages, rules=[], vocabulary=table).collect()}
    for k, u in enumerate(urls):
        r = out[k]
        assert (r["strict_hit"], r["n_soft"], r["verdict"]) == brute(u, terms, 100), u
    none = url_filter.judge(pages, rules=[], vocabulary=table.limit(0)).collect()
    assert {(r["n_soft"], r["verdict"]) for r in none} == {(0, "allow")}


def test_too_large_a_vocabulary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_TERMS", 3)
    with pytest.raises(ValueError, match="3 terms"):
        url_filter.terms_of(spark.createDataFrame([(c, 1) for c in "abcd"], "term string, weight long"))
