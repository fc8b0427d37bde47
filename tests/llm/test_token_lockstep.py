"""Lockstep alignment against a plain two-pointer walk over the libraries' own ids."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from citeloom.llm import token_lockstep as tl

V = tl.vocabularies(tl.Pair.default())


def plain(texts):
    """Per text: ids of A and B, groups, links; by the libraries on whole texts and a walk over ends."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    pair = tl.Pair.default()
    a, b = Tokenizer.from_file(pair.a), SentencePieceProcessor(model_file=pair.b)
    a.encode_special_tokens = True
    out = []
    for t in texts:
        ids_a = a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        want = (" " + t).encode() if t else b""
        if any(b"".join(v.tokens[i] for i in ids) != want for v, ids in ((V.a, ids_a), (V.b, ids_b))):
            ids_a, ids_b = [], []
        ends_a = np.cumsum([len(V.a.tokens[i]) for i in ids_a]).tolist()
        ends_b = np.cumsum([len(V.b.tokens[i]) for i in ids_b]).tolist()
        links = [(i, ends_b.index(e)) for i, e in enumerate(ends_a) if e in set(ends_b)]
        groups, pa, pb = [], 0, 0
        for i, j in links:
            groups.append(",".join(map(str, ids_a[pa:i + 1])) + "|" + ",".join(map(str, ids_b[pb:j + 1])))
            pa, pb = i + 1, j + 1
        out.append((ids_a, ids_b, groups, links))
    return out


def odd_texts(n=400):
    rnd = random.Random(3)
    bits = [" ", "  ", "\n", "\t", "the", "Harbor", "x", "é", "日本", "…", "1", "2024", "!?", "<|endoftext|>", "<s>", "<0x41>", "▁", "\x00", " ", "𝛼", "don't", "ﬁ", "é"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("lane", [3, 64, 1024])
def test_alignment_is_the_plain_walk(words, lane):
    texts = [*odd_texts(), "", "a", " ", words(400), "no\nspace" * 50, "日本語" * 100]
    want = plain(texts)
    assert sum(not w[0] for w in want) > 20 and sum(len(w[2]) > 1 for w in want) > 200
    got = tl.align(texts, V, lane)
    digests = tl.group_digests(got, V)
    for d, (ids_a, ids_b, groups, links) in enumerate(want):
        (sa, sb), sl = got.starts, got.link_starts
        assert got.ids[0][sa[d]:sa[d + 1]].tolist() == ids_a and got.ids[1][sb[d]:sb[d + 1]].tolist() == ids_b, texts[d]
        assert [(i - sa[d], j - sb[d]) for i, j in zip(got.links[0][sl[d]:sl[d + 1]], got.links[1][sl[d]:sl[d + 1]], strict=True)] == links
        assert digests[d] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")


def test_borders_cut_long_documents_only():
    assert tl.lane_borders(np.array([3, 13, 14]), 4).tolist() == [0, 3, 7, 11, 13, 14]


def test_digests_over_a_table(docs_of, words):
    texts = [words(1 + i % 30) for i in range(80)] + odd_texts(60) + [None, "", "long " * 20000, "same", "same"]
    rows = [(i if i != 7 else None, t) for i, t in enumerate(texts)]
    rows.append((3, texts[3]))
    docs = docs_of(rows).selectExpr("*", "'p' as pairs", "'q' as n_a")
    want = plain([t for _, t in rows])
    count = Counter((w[0][i], w[1][j]) for w in want for i, j in w[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    expected = []
    for (doc, _), (ids_a, ids_b, groups, links) in zip(rows, want, strict=True):
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        expected.append((doc, len(ids_a), len(ids_b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
                         sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs)))
    out = tl.alignment_digests(docs.repartition(3))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    arrays = {r.doc_id: r for r in tl.aligned_documents(docs_of(rows[:7])).collect()}
    for (doc, _), w in zip(rows[:7], want, strict=False):
        assert (arrays[doc].ids_a, arrays[doc].ids_b, list(zip(arrays[doc].link_a, arrays[doc].link_b, strict=True))) == (w[0], w[1], w[3])


def test_empty_table(docs_of):
    assert tl.alignment_digests(docs_of([])).count() == 0
