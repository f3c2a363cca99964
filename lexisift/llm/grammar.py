"""Re-Pair grammars of token sequences, for many files at once.

Each round counts the neighbouring pairs of every file and replaces those that occur at least twice and more often than the
pairs they overlap (of pairs as frequent the one with the greater hash, of equal occurrences the left one), so rounds are few
and every replacement is one that Re-Pair could make. Hashes come from the tokens alone: a file's grammar is the same whatever
files are with it. A rule's hash is that of the tokens it expands to, so equal rules of different files meet, however they came
about.
"""

from __future__ import annotations

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * _M + (b ^ (b >> np.uint64(29))) * _N + np.uint64(1)
        x ^= x >> np.uint64(31)
        return x * _M


_BASE = np.uint64(0xD6E8FEB86659FD93)


def _powers(most: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, _BASE)]), dtype=np.uint64)


class Grammars:
    """sizes: tokens of each file; left: symbols of each start rule; rule_*: the rules, with file, hash, length, uses."""

    def __init__(self, sequences: list[np.ndarray], hashes: np.ndarray):
        self.sizes = np.array([len(s) for s in sequences], np.int64)
        files = np.repeat(np.arange(len(sequences)), self.sizes)
        symbols = np.concatenate(sequences) if len(sequences) else np.empty(0, np.int64)
        symbols = symbols.astype(np.int64)
        hashes = hashes.astype(np.uint64)
        lengths = np.ones(len(hashes), np.int64)
        rules_file: list[np.ndarray] = []
        rules_symbol: list[np.ndarray] = []
        n = len(sequences)
        # the whole file as one hash, of its tokens in their places
        self.root = np.zeros(n, np.uint64)
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        with np.errstate(over="ignore"):
            np.add.at(self.root, files, _mix(hashes[symbols], place.astype(np.uint64)))
        self.root = self.root.astype(np.int64)
        bits = np.uint64(20)  # the same for batches of any size, up to a million files
        powers = _powers(int(self.sizes.max(initial=1)))
        while len(symbols) > 1:
            inside = files[1:] == files[:-1]
            # a pair's hash with its file in the last bits: within a file the order is that of the hashes
            pair = _mix(hashes[symbols[:-1]], hashes[symbols[1:]])
            key = np.where(inside, (pair << bits) | files[:-1].astype(np.uint64), np.uint64(0))
            uniq, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            count = np.where(inside, counts[inverse], 0)
            # a run a a a counts its overlaps; they cannot all be replaced
            count = np.where((count == 2) & (symbols[:-1] == symbols[1:]) & self._overlap(symbols, inside), 1, count)
            rank = count * (len(uniq) + 1) + inverse
            before = np.concatenate([[0], rank[:-1]])
            after = np.concatenate([rank[1:], [0]])
            win = (count >= 2) & (rank >= before) & (rank >= after)
            if not win.any():
                break
            at = np.flatnonzero(win)
            # neighbours that win together are runs of one pair: take every other
            start = np.concatenate([[True], np.diff(at) > 1])
            run = at - np.maximum.accumulate(np.where(start, at, 0))
            at = at[run % 2 == 0]
            pairs, which = np.unique(inverse[at], return_inverse=True)
            used = np.bincount(which)
            keep = used[which] >= 2
            at, which = at[keep], which[keep]
            if not len(at):
                break
            pairs, first, which = np.unique(which, return_index=True, return_inverse=True)
            new = len(hashes) + np.arange(len(pairs))
            a, b = symbols[at[first]], symbols[at[first] + 1]
            with np.errstate(over="ignore"):
                hashes = np.concatenate([hashes, hashes[a] * powers[lengths[b]] + hashes[b]])
            lengths = np.concatenate([lengths, lengths[a] + lengths[b]])
            rules_file.append(files[at[first]])
            rules_symbol.append(np.stack([new, a, b], 1))
            symbols[at] = new[which]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            symbols, files = symbols[~gone], files[~gone]
        self.left = np.bincount(files, minlength=n)
        rs = np.concatenate(rules_symbol) if rules_symbol else np.empty((0, 3), np.int64)
        self.rule_file = np.concatenate(rules_file) if rules_file else np.empty(0, np.int64)
        total = len(hashes)
        uses = np.bincount(symbols, minlength=total) + (np.bincount(rs[:, 1], minlength=total) + np.bincount(rs[:, 2], minlength=total) if len(rs) else 0)
        self.rule_hash = hashes[rs[:, 0]].astype(np.int64) if len(rs) else np.empty(0, np.int64)
        self.rule_length = lengths[rs[:, 0]] if len(rs) else np.empty(0, np.int64)
        self.rule_uses = uses[rs[:, 0]] if len(rs) else np.empty(0, np.int64)
        #: Occurrences in the start rules alone, for what a rule covers of its file.
        top = np.bincount(symbols, minlength=total)
        self.rule_top = top[rs[:, 0]] if len(rs) else np.empty(0, np.int64)
        self.rules = np.bincount(self.rule_file, minlength=n)
        # tokens covered by rules that occur in the start rule
        self.covered = np.bincount(files, weights=np.where(lengths[symbols] > 1, lengths[symbols], 0), minlength=n).astype(np.int64)
        self.long_covered = np.bincount(files, weights=np.where(lengths[symbols] >= 16, lengths[symbols], 0), minlength=n).astype(np.int64)

    @staticmethod
    def _overlap(symbols: np.ndarray, inside: np.ndarray) -> np.ndarray:
        same = (symbols[:-1] == symbols[1:]) & inside
        near = np.zeros(len(same), bool)
        near[:-1] |= same[1:]
        near[1:] |= same[:-1]
        return near
