"""A BK-tree over 64-bit fingerprints: children are keyed by their distance to the parent."""

from __future__ import annotations


class BKTree:
    def __init__(self, root: int):
        self.root = (root, {})

    def insert(self, value: int) -> None:
        node = self.root
        while True:
            distance = (node[0] ^ value).bit_count()
            if not distance:
                return
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        """Values at most ``radius`` away: by the triangle inequality only edges whose
        distance differs by at most the radius can lead to one."""
        found, stack = [], [self.root]
        while stack:
            key, children = stack.pop()
            distance = (key ^ value).bit_count()
            if distance <= radius:
                found.append(key)
            if len(children) <= 2 * radius + 1:
                stack.extend(c for d, c in children.items() if abs(d - distance) <= radius)
            else:
                for d in range(distance - radius, distance + radius + 1):
                    if d in children:
                        stack.append(children[d])
        return found


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join the values exactly as all links within ``radius`` do, fewer than values."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    links, tree = [], None
    for value in values:
        if tree is None:
            tree = BKTree(value)
            continue
        for other in tree.within(value, radius):
            a, b = root(value), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((value, other))
        tree.insert(value)
    return links
