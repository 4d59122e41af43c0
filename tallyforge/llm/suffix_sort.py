"""Deep-shallow sorting of strings: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

import numpy as np

#: Bytes that the quicksort compares; strings that agree on them go to a blind trie.
SHALLOW = 32
#: Segments up to this size are ordered on one word by numpy instead of by pivots.
SMALL = 4096


def lcp(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def _words(strings: list[bytes]) -> np.ndarray:
    """The first SHALLOW bytes of each string as big-endian words, zeros behind short ones."""
    flat = b"".join([s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings])
    return np.frombuffer(flat, ">u8").astype(np.uint64).reshape(len(strings), SHALLOW // 8)


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order of the rows by their words, and the runs of it that are equal in all of them."""
    order = np.arange(len(words))
    equal: list[tuple[int, int]] = []
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2:
            continue
        if depth == words.shape[1]:
            equal.append((lo, hi))
            continue
        part = order[lo:hi]
        key = words[part, depth]
        if hi - lo <= SMALL:
            by = np.argsort(key, kind="stable")
            order[lo:hi] = part[by]
            cuts = np.flatnonzero(np.diff(key[by])) + 1
            ends = np.r_[cuts, hi - lo]
            begins = np.r_[0, cuts]
            for k in np.flatnonzero(ends - begins > 1):
                todo.append((lo + int(begins[k]), lo + int(ends[k]), depth + 1))
        else:
            pivot = np.sort(key[:: max(1, len(key) // 9)])[len(key[:: max(1, len(key) // 9)]) // 2]
            less, same, more = part[key < pivot], part[key == pivot], part[key > pivot]
            order[lo:hi] = np.concatenate([less, same, more])
            a, b = lo + len(less), lo + len(less) + len(same)
            todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order, equal


class BlindTrie:
    """A trie of branching depths and branching bytes alone; a string is compared once, with the leaf it is led to."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # a leaf is [members], a node [depth, {byte: child}]

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [[i]]
            return
        path, node = [], self.root
        while len(node) == 2:
            path.append(node)
            children = node[1]
            node = children.get(self._at(s, node[0])) or next(iter(children.values()))
        other = self.strings[node[0][0]]
        common = lcp(s, other)
        if common == len(s) == len(other):
            node[0].append(i)
            return
        # the branch goes where the path first runs deeper than what is common
        parent, child = None, self.root
        for node in path:
            if node[0] >= common:
                break
            parent, child = node, node[1].get(self._at(s, node[0]))
        if child is not None and len(child) == 2 and child[0] == common:
            child[1][self._at(s, common)] = [[i]]
            return
        if child is None:
            parent[1][self._at(s, parent[0])] = [[i]]
            return
        branch = [common, {self._at(other, common): child, self._at(s, common): [[i]]}]
        if parent is None:
            self.root = branch
        else:
            parent[1][self._at(s, parent[0])] = branch

    def walk(self) -> tuple[list[int], list[int]]:
        """The strings in order, and each one's common prefix with the one before (0 for the first)."""
        order: list[int] = []
        common: list[int] = []
        todo: list[tuple[list, int]] = [(self.root, 0)] if self.root else []
        while todo:
            node, before = todo.pop()
            if len(node) == 1:
                size = len(self.strings[node[0][0]])
                order += node[0]
                common += [before] + [size] * (len(node[0]) - 1)
            else:
                kids = sorted(node[1].items())
                for n, (_, child) in reversed(list(enumerate(kids))):
                    todo.append((child, node[0] if n else before))
        return order, common


def deep_shallow_sort(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings, and for each place in it the common prefix with the string before (the first: 0)."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = _words(strings)
    order, equal = multikey_quicksort(words)
    within: list[tuple[int, list[int]]] = []
    for lo, hi in equal:
        trie = BlindTrie(strings)
        for i in order[lo:hi].tolist():
            trie.insert(i)
        order[lo:hi], shared = trie.walk()
        within.append((lo, shared))
    common = np.zeros(n, np.int64)
    # neighbours that part within the shallow bytes
    a, b = words[order[:-1]], words[order[1:]]
    differ = a != b
    column = differ.argmax(axis=1)
    x = a[np.arange(n - 1), column] ^ b[np.arange(n - 1), column]
    lead = np.zeros(n - 1, np.int64)
    for k in range(1, 8):
        lead += (x >> np.uint64(8 * k)) == 0
    size = np.array([len(s) for s in strings], np.int64)
    common[1:] = np.where(differ.any(axis=1), np.minimum(column * 8 + lead, np.minimum(size[order[:-1]], size[order[1:]])), 0)
    for lo, shared in within:
        common[lo + 1 : lo + len(shared)] = shared[1:]
    return order, common
