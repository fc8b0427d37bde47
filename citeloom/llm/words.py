"""Words of texts as numbers, for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as bytes, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    r"""A-Z lower-cased, then runs of ``[^\x20\x09-\x0D]``; exactly the white space that ``bytes.split`` knows."""
    return text.translate(LOWER).split()


def pieces(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that one piece holds about ``most_bytes`` of text, or one long row."""
    for batch in batches:
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, size[at] + most_bytes, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class Interned:
    """Word lists as flat ids into a vocabulary: ``ids`` of all texts, ``lens`` per text, ``vocab`` by id. Lists may be added
    one by one; only their ids are kept."""

    def __init__(self, lists: Iterable[list[bytes]] = ()) -> None:
        self.table: dict[bytes, int] = defaultdict()
        self.table.default_factory = self.table.__len__
        self.flat: list[np.ndarray] = []
        for words in lists:
            self.add(words)

    def add(self, words: list[bytes]) -> None:
        self.flat.append(np.fromiter(map(self.table.__getitem__, words), np.int32, len(words)))

    @property
    def vocab(self) -> list[bytes]:
        return list(self.table)

    @cached_property
    def lens(self) -> np.ndarray:
        return np.array([len(x) for x in self.flat], np.int64)

    @cached_property
    def ids(self) -> np.ndarray:
        return np.concatenate(self.flat) if self.flat else np.zeros(0, np.int32)

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.lens)])

    @property
    def rows(self) -> np.ndarray:
        """The text that each id belongs to."""
        return np.repeat(np.arange(len(self.lens)), self.lens)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each id's word."""
        table = np.fromiter(map(xxhash.xxh3_64_intdigest, self.table), np.uint64, len(self.table))
        return table[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
