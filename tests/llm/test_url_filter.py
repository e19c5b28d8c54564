import random
import re

import numpy as np

from blackbar.llm import url_filter as M

ODD = [
    None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x", "http://example.org/es", "http://example.org?/es/", "x://org",
    "http://org/", "http://forg/", "http://a.b.com/fr/x#y", "http://com#/de/", "http://com/de/?q=://z", "a://b://c/d",
    "http://example.org/en/12", "http://sub.example.org/en/1", "http://example.org/en/", "http://é.com/fr/\nnew", "//com/fr/",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in M.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")


def test_hosts_paths_and_rules(llm):
    df = pages(llm, ODD)
    got = {r.page_id: r for r in M.url_filter(df, M.rule_labels(df)).collect()}
    assert len(got) == len(ODD)
    for i, url in enumerate(ODD):
        name, verdict = rule(*split(url))
        assert (got[i].host, got[i].path, got[i].rule) == (*split(url), name), url
        assert got[i].verdict == (verdict or ("block" if got[i].block_score >= 0.5 else "allow"))


def test_held_out_urls_are_told_apart(llm):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    good = [f"http://{word()}.test/docs/{word()}" for _ in range(300)]
    bad = [f"http://{r.choice(['casino', 'pills'])}-{word()}.test/win/{word()}" for _ in range(300)]
    known = [(u, "allow") for u in good[:200]] + [(u, "block") for u in bad[:200]] + [(None, "block"), ("x", None)]
    got = {x.page_id: x for x in M.url_filter(pages(llm, good[200:] + bad[200:]), llm.createDataFrame(known, "url string, verdict string")).collect()}
    assert np.mean([(got[i].verdict == "block") == (i >= 100) for i in range(200)]) > 0.95


def test_grams_keep_to_their_text():
    row, cell = M.gram_rows(["ab", "", "é😀c"], ["/x", "/x", ""], 1 << 16)
    each = [sorted(cell[row == i].tolist()) for i in range(3)]
    assert [len(x) for x in each] == [3 + 3, 0 + 3, 3 + 2 + 1]
    assert set(each[1]) <= set(each[0]) and not set(each[2]) & set(each[0])


def test_one_label_no_label_and_empty_table(llm):
    none = llm.createDataFrame([], "url string, verdict string")
    assert M.url_filter(pages(llm, []), none).collect() == []
    free = pages(llm, ["http://x.net/a", None])
    assert {r.verdict for r in M.url_filter(free, none).collect()} == {"allow"}
    blocked = llm.createDataFrame([("http://a.net/", "block"), ("http://a.net/", "allow")], "url string, verdict string")
    assert {r.verdict for r in M.url_filter(free, blocked).collect()} == {"block"}
