"""One owner for each claim: terms, metric conditions and repetition variants."""

from __future__ import annotations

from .model import Group, Ruleset


def _terms(groups: list[Group], kind: str, warnings: list[tuple[str, str, str]]) -> None:
    """A term belongs to the entry of the lowest tier, the first of equals; the others lose it."""
    owner: dict[str, tuple[int, str]] = {}
    for group in groups:
        for entry in group.entries if group.kind == kind else ():
            for term in entry.terms:
                held = owner.get(term)
                if held is None or group.tier < held[0]:
                    if held is not None:
                        warnings.append((held[1], term, entry.id))
                    owner[term] = (group.tier, entry.id)
                else:
                    warnings.append((entry.id, term, held[1]))
    for group in groups:
        if group.kind == kind:
            for entry in group.entries:
                entry.terms = [t for t in dict.fromkeys(entry.terms) if owner[t][1] == entry.id]
            group.entries = [e for e in group.entries if e.terms]


def deduplicated(ruleset: Ruleset) -> Ruleset:
    """Prunes in place and adds a `dedup:` warning for each claim dropped. Disabled groups take part."""
    claims: list[tuple[str, str, str]] = []
    for kind in ("vocab", "literal-ban"):
        _terms(ruleset.groups, kind, claims)
    best: dict[tuple, Group] = {}
    for group in ruleset.groups:
        if group.metric is not None:
            m = group.metric
            key = ("metric", m.stat, m.window, tuple(sorted(m.terms)), m.direction)
            wins = key in best and m.stricter(best[key].metric)
            what = f"metric conflict on {m.stat}/{m.window}"
        elif group.repetition is not None:
            r = group.repetition
            key = ("repetition", r.variant)
            wins = key in best and r.threshold > best[key].repetition.threshold
            what = f"repetition conflict on {r.variant}"
        else:
            continue
        held = best.get(key)
        if held is None or wins:
            best[key] = group
        if held is not None:
            winner, loser = (group, held) if wins else (held, group)
            ruleset.warnings.append(f"dedup: {what} - {winner.id} is stricter, {loser.id} dropped")
    kept = {id(g) for g in best.values()}
    ruleset.groups = [g for g in ruleset.groups if id(g) in kept or g.metric is None and g.repetition is None and g.entries]
    ruleset.warnings += [f"dedup: `{term}` owned by {winner} - dropped duplicate claim from {loser}" for loser, term, winner in sorted(claims)]
    return ruleset
