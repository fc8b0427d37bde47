"""Exact round trips: planes, shards, files, and the library's own ids."""

import json
import random
import zlib

import numpy as np
import pytest

from citeloom.llm import token_planes as tp

TOKENIZER = tp.default_tokenizer()


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_planes_and_shards_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    if n:
        assert (tp.from_planes(tp.to_planes(ids, bits), n) == ids).all()
    data = tp.write_shard([5, 9], [n, 0], ids, block_ids=64, bits=bits)
    docs, lens, back = tp.read_shard(data)
    assert docs.tolist() == [5, 9] and lens.tolist() == [n, 0] and (back == ids).all()
    for b in range(-(-n // 64)):
        assert (tp.read_block(data, b) == ids[64 * b:64 * b + 64]).all()
    with pytest.raises(IndexError):
        tp.read_block(data, -(-n // 64))


def test_cut_shard_is_refused():
    with pytest.raises(ValueError):
        tp.read_shard(b"XXXX" + tp.write_shard([1], [1], np.array([3], "<u4"))[4:])


def test_cached_ids_are_the_library_ids():
    own = tp.WordCachedTokenizer(TOKENIZER)
    rnd = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "é", "ß", "1", "!", "'s", "...", "\x1c", "\x85", "<|endoftext|>", "日", "́", "\r", " \n", "x,", "\u00a0", "don't"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(3000)]
    texts += ["", " ", "The the\nThe, the. A b", "word,\nWord! x", "a" * 5000, "é" * 300]
    want = own.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in want]


@pytest.mark.parametrize("change", [{"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
                                    {"normalizer": {"type": "Lowercase"}}])
def test_other_kinds_of_tokenizer_encode_whole_texts(tmp_path, change):
    with open(TOKENIZER) as f:
        spec = json.load(f) | change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    own = tp.WordCachedTokenizer(str(path))
    texts = ["Two Words", " led by a space", "", "A  b\n c "]
    assert not own.cuts and tp.WordCachedTokenizer(TOKENIZER).cuts
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def brute(rows):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(TOKENIZER), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("options", [{}, {"shard_ids": 50, "block_ids": 16, "ranges": 3}, {"bits": True, "shard_ids": 200}])
def test_files_match_the_library(docs_of, words, options):
    rows = [(i * 7 % 101, words(i % 30)) for i in range(60)] + [(200, None), (201, ""), (None, "no id"), (-5, "below"), (3, "twice"), (3, "twice"), (300, "long " * 30000)]
    got = tp.encode_documents(docs_of(rows), **options).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)


def test_empty_table(docs_of):
    assert tp.encode_documents(docs_of([])).count() == 0
