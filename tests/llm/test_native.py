"""Url templates and source mixing: rules, targets and selections against plain Python."""

import hashlib
import math
import re

from pyspark.sql import functions as F

from citeloom.llm import mixing as mx
from citeloom.llm import url_templates as ut
from citeloom.llm.queries import URL_RULES


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")


def test_host_path_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/EN/1": ("example.net", "/EN/1", "net/", "block"),
        "https://x.example.com/de/2?q=/#f": ("x.example.com", "/de/2", "example.com/de/", "block"),
        "https://notexample.com/de/2": ("notexample.com", "/de/2", None, "allow"),
        "http://b.org/fr/?x": ("b.org", "/fr/", "org/fr/", "allow"),
        "http://h.net?x=/": ("h.net", "", None, "allow"),
        "http://h.net#a/b": ("h.net", "", None, "allow"),
        "no scheme/path": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://É.Example.org/fr/é\n2": ("É.example.org", "/fr/é\n2", "org/fr/", "allow"),
    }
    out = {r.page_id: r for r in ut.judge_urls(pages(spark, list(cases)), URL_RULES).collect()}
    for i, (url, want) in enumerate(cases.items()):
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == want, url


def test_variable_segments_and_impure_templates(spark):
    urls = [f"http://a.com/item/{i}.html" for i in range(40)] + [f"http://a.com/spam-{w}/x" for w in ("ab", "cd", "ef", "gh", "ij", "kl")] + ["http://a.com/about"] * 5
    df = pages(spark, urls)
    out = ut.judge_urls(df, [], bad=F.when(F.col("page_id").between(40, 45), True).when(F.col("page_id") < 10, False))
    rows = {r.page_id: r for r in out.collect()}
    assert rows[0].template == "/item/<n>.html" and rows[40].template == rows[41].template == "/*/x" and rows[46].template == "/about"
    assert rows[20].verdict == "allow" and rows[42].verdict == "block" and rows[47].verdict == "allow"


def test_merge_borrows_labels_of_similar_branches(spark):
    urls = [f"http://a.com/{s}/{i}" for s in ("x", "y", "z") for i in range(30)]
    out = ut.judge_urls(pages(spark, urls), [], bad=F.when(F.col("page_id") < 60, F.lit(True)))
    assert {r.verdict for r in out.collect()} == {"block"}  # the branch z has no label of its own


def test_deep_paths_and_repeats(spark):
    deep = "http://a.com/" + "/".join("abcdefghij")
    out = ut.judge_urls(pages(spark, [deep, deep, deep, "http://a.com/" + "0123456789abcdef" * 2]), []).collect()
    assert len(out) == 4 and any(r.template.endswith("/**") for r in out)
    assert ut.judge_urls(pages(spark, []), URL_RULES).count() == 0


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, fixed, total = {}, set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in fixed)
        free = [s for s in order if s not in fixed]
        for s in free:
            target[s] = rest * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return target | {s: float(most * sizes[s]) for s in fixed}
        fixed.update(over)
        target.update({s: float(most * sizes[s]) for s in over})


def rows_of(words, n=400):
    return [(i, words(1 + i * 7 % 40), None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(n)]


def test_targets_and_words_taken(docs_of, words):
    rows = rows_of(words) + [(900, None, "empty"), (901, "", "empty"), (None, words(5), "s1"), (902, "w " * 20000, "s2"), (7, rows_of(words)[7][1], "s2")]
    out = mx.mix(mx.sized(docs_of(rows), None)).collect()
    size = {}
    for _, text, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(size)
    assert len(out) == len(rows)
    for s in size:
        own = [r for r in out if r.source == s]
        assert {r.source_size for r in own} == {size[s]}
        assert all(math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-6) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) / 2 + 1e-6
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)


def test_selection_follows_the_keys(docs_of, words, monkeypatch):
    rows = rows_of(words)
    whole = sorted(map(tuple, mx.mix(mx.sized(docs_of(rows), None)).collect()), key=str)
    monkeypatch.setattr(mx, "ROWS_PER_RANGE", 7)
    assert sorted(map(tuple, mx.mix(mx.sized(docs_of(rows), None)).collect()), key=str) == whole
    out = mx.mix(mx.sized(docs_of(rows), None)).collect()

    def key(d):
        bits = int(hashlib.md5(f"mix:{d}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2**52)
    for s in {r.source for r in out}:
        own = sorted((r for r in out if r.source == s), key=lambda r: key(r.doc_id))
        at = 0
        for r in own:
            rest = r.target - r.epochs * r.source_size
            assert r.copies == r.epochs + (at + r.size / 2 < rest and r.epochs < 2)
            at += r.size


def test_quality_weights_favour_good_documents(spark, docs_of, words):
    rows = [(i, words(10), "abc"[i % 3]) for i in range(1500)]
    labels = spark.createDataFrame([(i, int(i // 3 % 2 == 0), 0) for i in range(1500)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    out = mx.mix(mx.sized(docs_of(rows), labels)).filter("copies > epochs").collect()
    good = sum(r.quality == 2.0 for r in out)
    assert good > 0.6 * len(out)


def test_take_repeats_rows(docs_of, words):
    rows = rows_of(words, 60) + [(3, "same row", "s3"), (3, "same row", "s3")]
    df = docs_of(rows)
    chosen = mx.mix(mx.sized(df, None)).agg(F.sum("copies")).first()[0]
    got = mx.take(df, None)
    assert got.columns == df.columns and got.count() == chosen


def test_empty_table(docs_of):
    assert mx.mix(mx.sized(docs_of([]), None)).count() == 0
    assert mx.take(docs_of([]), None).count() == 0
