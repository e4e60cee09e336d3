"""Deep-shallow suffix sorting.

Suffixes are dealt by their first two bytes, then ordered by multikey
quicksort down to a shallow depth: each group is parted by a pivot into less,
equal and greater, and the equal part goes on eight bytes deeper.  All groups
take their step at once.  Groups that still share their prefix at the shallow
depth are ordered by blind tries, which compare a suffix with one leaf instead
of with every other suffix.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16


def words(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a number that orders like the bytes; the data needs eight more bytes."""
    return np.ndarray((len(data) - 8,), dtype=">u8", buffer=data.data, strides=(1,))


class BlindTrie:
    """Strings in order: inner nodes know only the depth at which their children part."""

    __slots__ = ("root", "strings")

    def __init__(self):
        self.root, self.strings = None, []

    def add(self, string: bytes) -> int:
        """The number of the string, which is a new one unless the string is there."""
        strings = self.strings
        if self.root is None:
            strings.append(string)
            self.root = 0
            return 0
        node, path = self.root, []
        while not isinstance(node, int):  # blindly: bytes between the branching depths are not looked at
            path.append(node)
            branch = string[node[0] : node[0] + 1]
            node = node[1].get(branch)
            if node is None:
                node = next(iter(path[-1][1].values()))
                while not isinstance(node, int):
                    node = next(iter(node[1].values()))
        leaf = strings[node]
        depth = common(string, leaf)
        if depth == len(string) == len(leaf):
            return node
        strings.append(string)
        new, own, other = len(strings) - 1, string[depth : depth + 1], leaf[depth : depth + 1]
        above, below = None, self.root
        while not isinstance(below, int) and below[0] < depth:
            above, below = below, below[1][string[below[0] : below[0] + 1]]
        if not isinstance(below, int) and below[0] == depth:
            below[1][own] = new
            return new
        inner = (depth, {own: new, other: below})
        if above is None:
            self.root = inner
        else:
            above[1][string[above[0] : above[0] + 1]] = inner
        return new

    def order(self) -> list[int]:
        """The numbers of the strings, in the strings' order."""
        out, stack = [], [] if self.root is None else [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:  # a[:low] and b[:low] are equal
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _median(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def quicksort(eight: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of their first ``depth`` bytes by multikey quicksort, and the number of each one's group of equals.

    ``eight`` has at each place the next eight bytes as a number.
    """
    n = len(starts)
    head = (eight[starts] >> np.uint64(48)).astype(np.uint16) if depth >= 2 else np.zeros(n, dtype=np.uint16)
    by = np.argsort(head, kind="stable")  # radix sort
    first = np.flatnonzero(np.concatenate(([True], head[by][1:] != head[by][:-1]))) if n else np.zeros(0, dtype=np.int64)
    opens = np.zeros(n, dtype=bool)  # where a group begins
    opens[first] = True
    size = np.diff(np.concatenate((first, [n])))
    low, size = first[size > 1], size[size > 1]  # the groups that are not done, with the depth that they agree to
    deep = np.zeros(len(low), dtype=np.int64)
    key = np.zeros(n, dtype=np.uint64)
    fresh = np.ones(len(low), dtype=bool)  # groups whose keys are of another depth

    def places(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group = np.repeat(np.arange(len(low)), size)
        return group, np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + low[group]

    while len(low):
        if fresh.any():
            group, at = places(low[fresh], size[fresh])
            d = deep[fresh][group]
            word = eight[starts[by[at]] + d].astype(np.uint64)
            beyond = np.maximum(0, 8 - (depth - d)).astype(np.uint64) * np.uint64(8)  # bits behind the depth
            key[at] = word >> beyond
        group, at = places(low, size)
        now = key[at]
        pivot = _median(key[low], key[low + size // 2], key[low + size - 1])[group]
        part = (now >= pivot).astype(np.int8) + (now > pivot)
        edges = np.cumsum(size) - size
        counts, rank = [], np.empty(len(at), dtype=np.int64)
        for k in range(3):
            here = part == k
            upto = np.concatenate(([0], np.cumsum(here)))
            counts.append(upto[edges + size] - upto[edges])
            rank[here] = (upto[:-1] - upto[edges][group])[here]
        less, equal, more = counts
        to = low[group] + rank + np.where(part > 0, less[group], 0) + np.where(part > 1, equal[group], 0)
        by[to], key[to] = by[at], now
        opens[low + less] = True
        opens[(low + less + equal)[more > 0]] = True
        low = np.concatenate((low, low + less, low + less + equal))
        deep, fresh = np.concatenate((deep, deep + 8, deep)), np.repeat([False, True, False], len(size))
        size = np.concatenate((less, equal, more))
        live = (size > 1) & (deep < depth)
        low, size, deep, fresh = low[live], size[live], deep[live], fresh[live]
    return by, np.cumsum(opens) - 1


def order(data: bytes, starts: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of the ``depth`` bytes at each, and which are equal.

    Returns the sorted starts' numbers, and for each of them the number of
    its class: starts of the same class have the same bytes.  Bytes behind
    the end count as none, before all others.
    """
    n, size = len(starts), len(data)
    padded = np.frombuffer(data + bytes(depth + 16), dtype=np.uint8)
    eight = words(padded)
    by, group = quicksort(eight, starts, min(shallow, depth))
    alone = np.bincount(group, minlength=n)[group] == 1
    # Ends of the data pad with zeros: what runs into them is compared with its length.
    runs_out = starts + depth > size
    if depth <= shallow and not runs_out.any():
        return by, group
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, dtype=np.int64)
    ends = np.concatenate((edges[1:], [n])).astype(np.int64)
    # Groups whose rest is the same throughout are one leaf.
    first = starts[by[edges]][group] if n else starts
    differs = runs_out[by].copy()
    for d in [*range(shallow, depth - 7, 8), max(0, depth - 8)] if depth >= 8 else [0]:
        differs |= (eight[starts[by] + d] != eight[first + d]) & ~alone
    mixed = np.unique(group[differs & ~alone])
    rank = np.zeros(n, dtype=np.int64)
    for g in mixed.tolist():
        low, high = int(edges[g]), int(ends[g])
        trie = BlindTrie()
        leaves = [trie.add(data[s : s + depth]) for s in starts[by[low:high]].tolist()]
        place = np.empty(len(trie.strings), dtype=np.int64)
        place[trie.order()] = np.arange(len(trie.strings))
        found = place[leaves]
        moved = np.argsort(found, kind="stable")
        by[low:high] = by[low:high][moved]
        rank[low:high] = found[moved]
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (rank[1:] != rank[:-1]))) if n else np.zeros(0, dtype=bool)
    return by, np.cumsum(new) - 1


def suffix_array(data: bytes, shallow: int = SHALLOW) -> np.ndarray:
    """All suffixes of ``data`` in order."""
    starts = np.arange(len(data))
    return starts[order(data, starts, max(1, len(data)), shallow)[0]]
