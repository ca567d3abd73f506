"""A bounded store of the ids of strings, with vectorised look-up: what tokenizers keep between batches."""

from __future__ import annotations

from itertools import compress, repeat

import numpy as np
import pyarrow as pa

from . import _shared


class IdStore:
    """Strings, each with a run of ids. Emptied when it would pass `most` strings, or has passed most_bytes of text and ids.

    So it holds at most that and the strings of one batch, however long strings are. keep_found: strings that were looked
    up again since they were kept, or since the last time, stay when it is emptied, if they are at most half of either bound.
    """

    def __init__(self, most: int = 1_000_000, most_bytes: int = 64 << 20, keep_found: bool = False):
        self.most, self.most_bytes, self.keep_found = most, most_bytes, keep_found
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.found = np.zeros(1 << 14, bool)
        self.used = self.text = 0

    def make_room(self, n: int) -> None:
        if len(self.place) + n > self.most or self.text + 4 * self.used > self.most_bytes:
            found = np.flatnonzero(self.found[: len(self.place)])
            words = list(compress(self.place, self.found)) if len(found) <= self.most // 2 else []
            small = sum(map(len, words)) + 4 * int(self.lengths[found].sum()) <= self.most_bytes // 2
            lengths, ids = self.gather(found) if words and small else (None, None)
            self.clear()
            if ids is not None:
                self.keep(words, lengths, ids)

    def keep(self, words: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        n = len(self.place)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.found = np.concatenate([self.found, np.zeros_like(self.found)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[n : n + len(words)] = lengths
        self.used += len(flat)
        self.text += sum(map(len, words))
        self.place.update(zip(words, range(n, n + len(words)), strict=True))

    def places(self, coded: pa.DictionaryArray, learn) -> np.ndarray:
        """The place of each entry of coded; learn(strings) must keep those that are not here yet."""
        words = coded.dictionary.to_pylist()
        places = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        if self.keep_found:
            self.found[places[places >= 0]] = True
        if len(at := np.flatnonzero(places < 0)):
            learn(new := [words[k] for k in at.tolist()])
            places[at] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        return places[coded.indices.to_numpy(zero_copy_only=False)]

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of the strings at places, one after another."""
        lengths = self.lengths[places]
        return lengths, self.ids[_shared.ranges(self.starts[places], lengths)]
