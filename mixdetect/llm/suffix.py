"""Deep-shallow suffix sorting.

``sort_suffixes`` orders byte strings (suffixes cut at a fixed depth) that are
given in groups: a multikey quicksort over 8-byte keys runs to a shallow depth
on all groups at once; strings that still agree there go, group by group,
through a blind trie, which looks at branching bytes on the way down and
compares the whole string only once.
"""

from __future__ import annotations

import numpy as np

#: Bytes up to which the multikey quicksort goes.
SHALLOW = 24


class BlindTrie:
    """Compacted trie of equally wide strings that stores only the depth and byte of each branch."""

    __slots__ = ("width", "root", "strings", "numbers", "same")

    def __init__(self, width: int):
        self.width, self.root = width, None
        self.strings: list[bytes] = []
        self.numbers: list[int] = []
        self.same: list[list[int]] = []  # the items that share a leaf's string

    def insert(self, item: int, s: bytes) -> None:
        number = int.from_bytes(s, "big")
        node = self.root
        if node is None:
            self.root = self._leaf(item, s, number)
            return
        while not isinstance(node, int):  # blind descent: only branching bytes are looked at
            depth, children = node
            node = children.get(s[depth])
            if node is None:
                node = next(iter(children.values()))
        differ = number ^ self.numbers[node]
        if not differ:
            self.same[node].append(item)
            return
        lcp = self.width - (differ.bit_length() + 7) // 8
        byte, leaf = self.strings[node][lcp], self._leaf(item, s, number)
        node, parent, edge = self.root, None, None
        while not isinstance(node, int) and node[0] < lcp:
            parent, edge = node, s[node[0]]
            node = node[1][edge]
        if not isinstance(node, int) and node[0] == lcp:
            node[1][s[lcp]] = leaf
            return
        branch = (lcp, {byte: node, s[lcp]: leaf})
        if parent is None:
            self.root = branch
        else:
            parent[1][edge] = branch

    def _leaf(self, item: int, s: bytes, number: int) -> int:
        self.strings.append(s)
        self.numbers.append(number)
        self.same.append([item])
        return len(self.strings) - 1

    def in_order(self) -> tuple[list[int], list[int]]:
        """Items in order, and of each its common prefix with the one before (the first has 0)."""
        items: list[int] = []
        lcps: list[int] = []
        stack: list[tuple] = [(self.root, 0)]
        while stack:
            node, lcp = stack.pop()
            if isinstance(node, int):
                items += self.same[node]
                lcps += [lcp] + [self.width] * (len(self.same[node]) - 1)
                continue
            depth, children = node
            keys = sorted(children)
            stack += [(children[b], depth) for b in reversed(keys[1:])]
            stack.append((children[keys[0]], lcp))
        return items, lcps


def sort_suffixes(strings: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``strings`` (n x width bytes) by (group, bytes), and common prefixes in that order.

    ``group`` holds group numbers.  The common prefix of a row with the row
    before it is 0 at the start of a group.
    """
    n, width = strings.shape
    order = np.argsort(group, kind="stable")
    lcp = np.zeros(n, dtype=np.int64)
    words = -(-min(shallow, width) // 8)
    padded = np.zeros((n, words * 8), dtype=np.uint8)
    padded[:, :min(width, words * 8)] = strings[:, :words * 8]
    keys = padded.view(">u8").astype(np.uint64)
    # run: number of the set of rows that agree so far, by rank
    run = np.cumsum(np.concatenate(([0], group[order][1:] != group[order][:-1])))
    open_ranks = np.arange(n)
    for w in range(words):
        tied = np.bincount(run[open_ranks], minlength=int(run[-1]) + 1 if n else 1)[run[open_ranks]] > 1
        open_ranks = open_ranks[tied]
        if not len(open_ranks):
            return order, np.minimum(lcp, width)
        key = keys[order[open_ranks], w]
        by = np.lexsort((key, run[open_ranks]))
        order[open_ranks], key = order[open_ranks][by], key[by]
        same_run = np.concatenate(([False], run[open_ranks][1:] == run[open_ranks][:-1]))
        differ = np.concatenate(([np.uint64(0)], key[1:] ^ key[:-1]))
        parted = same_run & (differ != 0)
        if parted.any():
            lcp[open_ranks[parted]] = 8 * w + (64 - _bit_length(differ[parted])) // 8
        # renumber the runs of the open rows
        start = ~same_run | parted
        first_rank = np.maximum.accumulate(np.where(start, open_ranks, 0))
        run = np.array(run)
        run[open_ranks] = n + first_rank
        _, run = np.unique(run, return_inverse=True)
        run = run.astype(np.int64)
    deep = min(width, words * 8)
    sizes = np.bincount(run)
    tied = np.flatnonzero(sizes[run] > 1)
    if len(tied):
        cuts = np.flatnonzero(np.diff(run[tied])) + 1
        raw = np.ascontiguousarray(strings).tobytes()
        for ranks in np.split(tied, cuts):
            trie = BlindTrie(width - deep)
            if width > deep:
                for k in order[ranks].tolist():
                    trie.insert(k, raw[k * width + deep:(k + 1) * width])
                items, common = trie.in_order()
            else:
                items, common = order[ranks].tolist(), [0] * len(ranks)
            order[ranks] = items
            lcp[ranks[1:]] = np.array(common[1:], dtype=np.int64) + deep
    return order, np.minimum(lcp, width)


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Bit length of unsigned 64-bit numbers."""
    out = np.zeros(len(x), dtype=np.int64)
    x = x.copy()
    for s in (32, 16, 8, 4, 2, 1):
        big = x >= (np.uint64(1) << np.uint64(s))
        out[big] += s
        x[big] >>= np.uint64(s)
    return out + (x > 0)
