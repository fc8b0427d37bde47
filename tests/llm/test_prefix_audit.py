"""Divergence audit against plain counting with exact integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from citeloom.llm import prefix_audit as pa

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("n", "term", "p", "none", "prefix", "docs", "v", "total", "item", "value", "rank", "part"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


def plain_kept(rows, least):
    docs = defaultdict(set)
    for i, (_, text, lang, _) in enumerate(rows):
        for t in TERM.findall(text or ""):
            docs[lang or "", t.translate(LOWER)].add(i)
    return {k: len(v) for k, v in docs.items() if len(v) >= least}


def plain(rows, least, top):
    kept = plain_kept(rows, least)
    count, groups = Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in TERM.findall(text or ""):
            t = t.translate(LOWER)
            if (lang, t) in kept:
                count[lang, source, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        terms, sources = sorted(t for x, t in kept if x == lang), sorted(s for x, s in groups if x == lang)
        v = len(terms)

        def shares(get):
            total = sum(map(get, terms))
            return {t: 1 + 10**9 * (get(t) + 2) // (total + 2 * v) for t in terms}
        p = {s: shares(lambda t, s=s: count[lang, s, t]) for s in sources}
        q = shares(lambda t: sum(count[lang, s, t] for s in sources))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in terms), o) for o in sources if o != s]
            used = [(f(p[s][t], q[t]), t) for t in terms if count[lang, s, t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", used, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(items[:most], 1)]
    return sorted(out)


def sample(n=240):
    rnd = random.Random(8)
    vocab = ["a", "an", "and", "ands", "andsome", "Größe", "größer", "日本", "日本語", "x" * 40, "x" * 41, "Zeta", "zeta"] + [f"w{c}{d}" for c in "abcdefgh" for d in "ijkl"]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rnd.choice(["s1", "s2", "é", "😀", "￮", None, ""])
        words = rnd.choices(vocab, [1 + (len(source or "") * k) % 7 for k in range(len(vocab))], k=rnd.randrange(12))
        rows.append((i, rnd.choice([" ", "_", "1", "\n", "-", "\x00"]).join(words), rnd.choice(["en", "en", "de", None, "zz"]), source))
    rows += [(900, None, "en", "empty"), (901, "", "only", "one"), (902, "123 ,.", "only", "two"), (None, "and " * 30000, "en", "long"), (5, rows[5][1], rows[5][2], rows[5][3]),
             (903, "rare words", "lone", "s")]
    return rows


@pytest.mark.parametrize(("least", "bits", "first"), [(10, 26, 2), (3, 6, 1), (1, 3, 3)])
def test_kept_terms_are_the_frequent_ones(spark, docs_of, least, bits, first):
    rows = sample()
    blocks = pa.term_blocks(table(spark, rows).repartition(4))
    got = {(r.lang, bytes(r.term).decode()): r.docs for r in pa.kept_terms(blocks, min_docs=least, bits=bits, first_length=first).collect()}
    assert got == plain_kept(rows, least)


@pytest.mark.parametrize(("least", "top", "bits"), [(10, 10, 26), (2, 3, 5), (1000, 10, 8)])
def test_divergences_are_exact(spark, docs_of, least, top, bits):
    rows = sample()
    out = pa.divergences(table(spark, rows).repartition(5), min_docs=least, top=top, bits=bits)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == plain(rows, least, top)


def test_shares_beyond_a_long(spark):
    big = 10**17
    row = spark.range(1).select(F.lit(big).alias("n"), F.lit(3 * big).alias("total"), F.lit(5).cast("long").alias("v"))
    assert row.select(pa.share("n", "total", "v")).first()[0] == 1 + 10**9 * (big + 2) // (3 * big + 10)
    p, q = 10**9 + 1, 1
    assert spark.range(1).select(pa.distance(F.lit(p).cast("long"), F.lit(q).cast("long"))).first()[0] == (p - q) ** 2 // (p + q)


def test_hashes_agree_with_spark(spark):
    row = spark.createDataFrame([("dé", bytearray(b"ab\xc3\x00"))], "lang string, prefix binary")
    bitmap = pa.bitmap_of(row, 12)
    assert pa.holds(bitmap, pa.hashes("dé", [b"ab\xc3\x00"]), 12).all() and sum(bin(int(x)).count("1") for x in bitmap) == 1


def test_empty_table(spark, docs_of):
    assert pa.divergences(table(spark, [])).count() == 0
