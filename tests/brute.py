"""Plain versions for small graphs."""

from __future__ import annotations

from argosy.functions.graph import RELATIONS


def cycle_cuts(edges, rank, kinds):
    """The cuts, over all walks: the first walk in order that comes back to itself loses its first supports edge into an analysis, else the edge that closed it, until none comes back."""
    place = lambda x: (rank.get(x, len(rank)), x)
    left, cuts = sorted(edges, key=lambda e: (RELATIONS.index(e[0]), place(e[1]), place(e[2]))), []

    def closing(nodes, way):
        for e in left:
            if e[1] == nodes[-1]:
                found = [*way, e][nodes.index(e[2]) :] if e[2] in nodes else closing([*nodes, e[2]], [*way, e])
                if found:
                    return found
        return None

    while True:
        found = next(filter(None, (closing([x], []) for x in sorted({x for e in left for x in e[1:]}, key=place))), None)
        if found is None:
            return cuts
        into = sorted((e for e in found if e[0] == "supports" and kinds.get(e[2]) == "analysis"), key=left.index)
        cuts.append((into or found[-1:])[0])
        left.remove(cuts[-1])


def reading_order(children, entry):
    """Pre-order over child lists by recursion; the first visit wins."""
    out = []

    def visit(x):
        if x not in out:
            out.append(x)
            for child in children.get(x, []):
                visit(child)

    visit(entry)
    return out
