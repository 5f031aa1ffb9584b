"""Whether a pattern is cyclic, by repeatedly taking away ears (GYO reduction)."""

from __future__ import annotations

from . import ir


def is_cyclic(patterns: list[ir.Triple]) -> bool:
    """True if no join tree exists. Constants do not count, only variables do."""
    edges = [{t.name for t in (p.s, p.p, p.o) if isinstance(t, ir.Var)} for p in patterns]
    edges = [e for e in edges if e]
    changed = True
    while changed:
        changed = False
        for i, e in enumerate(edges):
            others = edges[:i] + edges[i + 1 :]
            shared = {v for v in e if any(v in o for o in others)}
            if any(shared <= o for o in others) or not shared:
                edges = others
                changed = True
                break
            if shared != e:
                edges[i] = shared
                changed = True
                break
    return bool(edges)


def ordered(parts: list) -> list:
    """Parts of a join with the triples of a cyclic pattern moved next to each other, closing edges last.

    A triple whose variables are all bound by the ones before it only filters, so it goes as
    soon as it can: a cycle is cut back before it is extended. Acyclic patterns stay as they are.
    """
    triples = [p for p in parts if isinstance(p, ir.Triple)]
    if len(triples) < 3 or not is_cyclic(triples):
        return parts
    names = lambda p: {t.name for t in (p.s, p.p, p.o, p.eid) if isinstance(t, ir.Var)}
    ends = lambda p: {t.name for t in (p.s, p.o) if isinstance(t, ir.Var)}
    left, out, bound = list(triples), [], set()
    while left:
        nxt = next((p for p in left if bound and ends(p) <= bound), None) or next((p for p in left if ends(p) & bound), left[0])
        left.remove(nxt)
        out.append(nxt)
        bound |= names(nxt)
    return out + [p for p in parts if not isinstance(p, ir.Triple)]
