"""Exact dedup by merged digest runs against a plain grouping."""

import hashlib
import random
import re

import numpy as np
import pytest

from citeloom.llm import digest_runs as dr


def plain(rows):
    """rows: (doc_id, text) -> multiset of result rows."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        flags = [False] * len(members)
        flags[members.index(keep)] = True
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(doc, keep[0], len(members), f, digest) for (doc, _), f in zip(members, flags, strict=True)]
    return sorted(out, key=repr)


def sample(words, n=300):
    rnd = random.Random(2)
    texts = [words(1 + i % 9) for i in range(40)]
    rows = []
    for i in range(n):
        t = "hot copy of many" if i % 3 == 0 else rnd.choice(texts)
        rows.append((i * 7 % 1009, t.replace(" ", rnd.choice([" ", "\n", "\t ", "\x0b", ""]))))
    odd = [(2000, None), (2001, ""), (2002, " \r\n\x0c"), (None, "no id"), (None, "no  id"), (2003, "noid"), (-4, "é x"), (2004, "é x"), (2005, "éx"),
           (2006, "日本 語"), (2007, "日本語"), (2008, "long " * 40000), (2009, "long" * 40000), (2010, "same"), (2010, "same"), (None, "lone"), (None, None)]
    return rows + odd


@pytest.mark.parametrize("options", [{"slots": 1}, {"slots": 37, "round_bits": 2}, {"slots": 5, "task_entries": 20}, {"slots": 23, "round_bits": 1, "task_entries": 3}])
def test_groups_match_a_plain_grouping(docs_of, words, options):
    rows = sample(words)
    docs = docs_of(rows).repartition(options.pop("slots"))
    got = dr.exact_copies(docs, **options)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got, want = [tuple(r) for r in got.collect()], plain(rows)
    # of rows alike in everything which one is kept is a matter of places: compare how many are
    assert sorted(got, key=repr) == want


def test_kept_rows_keep_their_columns(docs_of, words):
    rows = sample(words)
    docs = docs_of(rows).selectExpr("*", "'y' as slot", "1.5 as at", "'z' as digest", "'r' as row").repartition(7)
    out = dr.first_copies(docs, round_bits=1)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(
        ((doc, text) for doc, text in _keepers(rows)), key=repr)


def _keepers(rows):
    groups = {}
    for doc, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc, text))
    for members in groups.values():
        first = min(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))
        yield first


def test_entries_of_one_head_are_verified():
    def entry(d1, doc, size=3):
        e = np.zeros(1, dr.ENTRY)
        e["d0"], e["d1"], e["doc"], e["size"], e["rows"] = 7, d1, doc, size, 1
        return e
    out = dr.merge_runs([np.concatenate([entry(1, 5), entry(2, 6)]), entry(1, 4), entry(2, 9), entry(2, 3, size=4)])
    assert [(int(e["d1"]), int(e["doc"]), int(e["rows"])) for e in out] == [(1, 4, 2), (2, 6, 2), (2, 3, 1)]
    assert len(dr.merge_runs([])) == 0


def test_empty_table(docs_of):
    assert dr.exact_copies(docs_of([])).count() == 0
