"""A cuckoo filter over 64-bit keys: four slots of 16-bit fingerprints a bucket, with deletion."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 500
_M = (1 << 64) - 1


def _mix(x: int) -> int:
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & _M
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & _M
    return x ^ (x >> 33)


class CuckooFilter:
    """Never denies a key that was inserted (and not deleted); others pass with a chance of about 1 in 8000."""

    def __init__(self, buckets: int):
        assert buckets & (buckets - 1) == 0
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.seed = 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.85))))))

    @classmethod
    def of(cls, keys) -> CuckooFilter:
        keys = [int(k) for k in keys]
        found = cls.sized(len(keys))
        while not all(found.insert(k) for k in keys):
            found = cls(2 * len(found.table))
        return found

    def _places(self, key: int) -> tuple[int, int, int]:
        h = _mix(key & _M)
        print_, mask = (h >> 48) or 1, len(self.table) - 1
        first = h & mask
        return print_, first, first ^ (_mix(print_) & mask)

    def insert(self, key: int) -> bool:
        """False if it is full; it is then to be built anew, larger."""
        print_, one, two = self._places(key)
        for at in (one, two):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = print_
                return True
        at, mask = one, len(self.table) - 1
        for _ in range(KICKS):
            self.seed = self.seed * 6364136223846793005 + 1 & _M
            slot = self.seed >> 62
            print_, self.table[at, slot] = int(self.table[at, slot]), print_
            at ^= _mix(print_) & mask
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = print_
                return True
        return False

    def delete(self, key: int) -> bool:
        print_, one, two = self._places(key)
        for at in (one, two):
            held = np.flatnonzero(self.table[at] == print_)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Which of many keys (as unsigned 64-bit values) may be held."""
        with np.errstate(over="ignore"):
            u = np.uint64
            mixed = lambda x: (y := ((z := (x ^ (x >> u(33))) * u(0xFF51AFD7ED558CCD)) ^ (z >> u(33))) * u(0xC4CEB9FE1A85EC53)) ^ (y >> u(33))
            h = mixed(keys.astype(u))
            print_ = np.maximum(h >> u(48), u(1))
            mask = u(len(self.table) - 1)
            one = h & mask
            two = one ^ (mixed(print_) & mask)
        print_ = print_.astype(np.uint16)[:, None]
        return (self.table[one] == print_).any(1) | (self.table[two] == print_).any(1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        found = cls(len(raw) // (2 * SLOTS))
        found.table = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return found
