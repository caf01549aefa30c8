"""A compressed radix trie over byte strings whose terminals hold an owner and a count."""

from __future__ import annotations

from collections.abc import Iterator


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the longest common prefix of ``label`` and ``key[at:]``."""
    if key.startswith(label, at):
        return len(label)
    low, high = 0, min(len(label), len(key) - at)
    while low < high:  # label[:low] agrees, label[:high + 1] does not
        middle = (low + high + 1) // 2
        if key.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    __slots__ = ("children", "count", "owner", "size")

    def __init__(self):
        self.children: dict[int, tuple[bytes, Node]] = {}
        self.owner = None  # rank of the best row: (-code points, id is null, id)
        self.count = 0
        self.size = 0


class RadixTrie:
    """Edges carry byte strings; a child is found by the first byte of its edge."""

    def __init__(self):
        self.root = Node()
        self.held = 0  # bytes on all edges

    def insert(self, key: bytes, owner: tuple, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            edge = node.children.get(key[at])
            if edge is None:
                leaf = Node()
                node.children[key[at]] = (key[at:], leaf)
                self.held += len(key) - at
                node, at = leaf, len(key)
                break
            label, child = edge
            same = _common(label, key, at)
            if same < len(label):  # split the edge where the strings part
                middle = Node()
                middle.children[label[same]] = (label[same:], child)
                node.children[key[at]] = (label[:same], middle)
                child = middle
            node, at = child, at + same
        node.owner = owner if not node.count or owner < node.owner else node.owner
        node.count += count

    def terminals(self) -> Iterator[tuple[bytes, tuple, int]]:
        """(key, owner, count) of every string, depth first and without recursion."""
        stack = [(b"", self.root)]
        while stack:
            key, node = stack.pop()
            if node.count:
                yield key, node.owner, node.count
            stack.extend((key + label, child) for label, child in node.children.values())
