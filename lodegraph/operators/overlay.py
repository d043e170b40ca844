"""What one plan binds, completes and grounds: the parts of overlay planning that look at a seed's candidates.

The facts that bindings need (values by attribute, table cells, units, peers in other papers, nearby
results, chunk nodes) are joined to the candidates as bounded columns; the functions below only read
them. Every choice is by the candidates' order, so a plan is the same on any partitioning.

Defined results. A binding that finds nothing leaves the roles as they are. A virtual edge counts only
if a path of the candidates' own links, of at most HOPS edges, backs it and its score is above zero.
"""

from __future__ import annotations

from collections import deque
from typing import Any

# Where a role's evidence is looked for first, how many edges are proposed for a role, how long a backing is.
EVIDENCE_ANCHORS = {
    "evidence_A": ["value_A", "object_A"],
    "evidence_B": ["value_B", "object_B"],
    "evidence_span": ["claim", "attribute_or_result", "condition_boundary"],
    "supporting_evidence": ["observed_result", "intermediate_mechanism", "method_or_intervention"],
    "evidence": ["value", "attribute", "concept", "equation", "figure_or_table", "claim"],
}
PER_ROLE, HOPS = 3, 4
PHYSICAL = ("ChunkNode", "EvidenceNode", "FigureNode", "TableNode")
REAL = ("ConceptNode", "MethodNode", "ValueNode")


def words(name: str) -> set[str]:
    return {w for w in name.lower().replace("/", " ").split() if w}


def similarity(a: str, b: str) -> float:
    x, y = words(a), words(b)
    return len(x & y) / len(x | y) if x and y else 0.0


class Overlay:
    """Roles of one plan with the facts of its candidates; ``order`` are the candidates in their order, ``facts`` also hold what bindings may add."""

    def __init__(self, kind: str, facts: dict[str, dict[str, Any]], links: dict[str, set[str]], order: list[str], roles: dict[str, str]) -> None:
        self.kind, self.facts, self.links, self.order, self.roles = kind, facts, links, order, roles
        self.added: list[str] = []
        self.edges: list[dict[str, Any]] = []

    def _get(self, node: str | None, what: str, default: Any = None) -> Any:
        value = self.facts.get(node or "", {}).get(what)
        return default if value is None else value

    def _set(self, role: str, node: str | None) -> None:
        if node and node in self.facts:
            self.roles[role] = node
            self.added.append(node)

    def _good(self, node: str | None) -> bool:
        return bool(node) and bool(self._get(node, "ok", False))

    # ---- bindings ----

    def bind(self) -> None:
        if self.kind == "comparative":
            self.bind_comparison()
        elif self.kind == "cross_paper":
            self.bind_papers()
        elif self.kind in ("numerical", "formula") and (unit := self._get(self.roles.get("value"), "unit")):
            self._set("unit", unit)

    def bind_comparison(self) -> None:
        """Values that belong to the two objects under one metric: cells of a column that both rows have, else values of attributes of one name."""
        objects = [self.roles.get("object_A"), self.roles.get("object_B")]
        if not all(objects):
            return
        objects = [self._get(x, "row", x) for x in objects]
        for side, node in zip("AB", objects):
            self._set(f"object_{side}", node)
        a, b = ({c["column"]: c["cell"] for c in self._get(x, "columns", [])} for x in objects)
        shared = [c for c in a if c in b]
        if shared:
            wanted = self.roles.get("shared_attribute")
            column = wanted if wanted in shared else next((c for c in shared if any(x.isdigit() for x in self._get(a[c], "name", ""))), shared[0])
            values = [a[column], b[column]]
            self._set("shared_attribute", column)
            values = [v if self._good(v) else None for v in values]
        else:
            held = [self._get(x, "attrs", []) for x in objects]
            names = [list(dict.fromkeys(h["attribute"] for h in some)) for some in held]
            wanted = self.roles.get("shared_attribute")
            pair = (wanted, wanted) if wanted in names[0] and wanted in names[1] else next(((x, y) for x in names[0] for y in names[1] if words(self._get(x, "name", "")) & words(self._get(y, "name", ""))), None)
            if pair:
                self._set("shared_attribute", pair[0])
            values = [next((h["value"] for h in some if (not pair or h["attribute"] == attribute) and self._good(h["value"])), None) for some, attribute in zip(held, pair or (None, None))]
        for side, value in zip("AB", values):
            self._set(f"value_{side}", value)
        if not self.roles.get("unit"):
            self._set("unit", next((u for v in values if (u := self._get(v, "unit"))), None))

    def bind_papers(self) -> None:
        """The first anchor with a real peer in another paper, its peer, and a result of each in its own paper."""
        anchors = [self.roles.get("paper_A_instance"), self.roles.get("canonical_concept"), *self.roles.values()]
        anchor = next((x for x in anchors if x and self._get(x, "peer") in self.facts), None)
        if anchor is None:
            return
        peer = self._get(anchor, "peer")
        self._set("paper_A_instance", anchor)
        self._set("paper_B_instance", peer)
        if not self.roles.get("canonical_concept"):
            self._set("canonical_concept", anchor)
        self._set("result_A", self._get(anchor, "result"))
        self._set("result_B", self._get(peer, "result"))

    # ---- virtual completion ----

    def proposals(self, missing: list[str]) -> list[tuple[str, str, str, str]]:
        """(source, target, intent, role) of edges that could fill a missing role, at most PER_ROLE for each."""
        r, of = self.roles, lambda *types: [n for n in self.order if self._get(n, "type") in types]
        out: list[tuple[str, str, str, str]] = []

        def propose(source: str | None, targets: list[str], intent: str, role: str) -> None:
            out.extend((source, t, intent, role) for t in [t for t in targets if source and t != source][:PER_ROLE])

        if self.kind == "comparative":
            attribute = r.get("shared_attribute")
            if attribute and {"object_B", "value_B"} & set(missing):
                propose(attribute, [c for c in of("ConceptNode") if c != r.get("object_A") and self._comparable(c, attribute)], "search_comparable", "object_B")
            if r.get("object_A") and r.get("object_B"):
                propose(r["object_A"], [r["object_B"]], "comparable", "comparison_criterion")
        if self.kind == "condition" and "condition_boundary" in missing:
            propose(r.get("claim") or r.get("attribute_or_result"), of("ConditionNode"), "limited_by", "condition_boundary")
        if self.kind == "mechanism" and "intermediate_mechanism" in missing:
            propose(r.get("method_or_intervention"), of("ClaimNode"), "seek_mechanism", "intermediate_mechanism")
            propose(r.get("method_or_intervention"), [x for x in (r.get("observed_result") or r.get("target_attribute"),) if x], "method_effect", "observed_result")
        if self.kind == "cross_paper" and (anchor := r.get("canonical_concept")):
            propose(anchor, [n for n in self.order if self._same_elsewhere(anchor, n)], "cross_paper_align", "paper_B_instance")
        if any(x.startswith("evidence") or x == "supporting_evidence" for x in missing):
            anchor = r.get("claim") or r.get("observed_result") or r.get("shared_attribute") or next(iter(r.values()), None)
            propose(anchor, of("FigureNode") + of("TableNode"), "need_visual_evidence", "supporting_evidence")
        return out

    def _comparable(self, concept: str, attribute: str) -> bool:
        identity = self._get(attribute, "canonical", "")
        return any((identity and self._get(h["attribute"], "canonical", "") == identity) or similarity(self._get(h["attribute"], "name", ""), self._get(attribute, "name", "")) > 0.5 for h in self._get(concept, "attrs", []))

    def _same_elsewhere(self, a: str, b: str) -> bool:
        identity = self._get(a, "canonical", "")
        return b != a and bool(identity) and self._get(b, "canonical", "") == identity and self._get(b, "paper", "") != self._get(a, "paper", "")

    def backing(self, source: str, target: str) -> list[str]:
        """A shortest path of the candidates' links, of at most HOPS edges; empty if there is none."""
        before, todo = {source: ""}, deque([(source, 0)])
        while todo:
            node, far = todo.popleft()
            if node == target:
                path = [node]
                while before[path[-1]]:
                    path.append(before[path[-1]])
                return path[::-1]
            for near in sorted(self.links.get(node, ())) if far < HOPS else ():
                if near not in before:
                    before[near] = node
                    todo.append((near, far + 1))
        return []

    def complete(self, missing: list[str], weights: dict[str, float], compatible: dict[str, list[str]]) -> None:
        """Proposes, scores and backs virtual edges; the best accepted one of each empty role fills it."""
        for source, target, intent, role in self.proposals(missing):
            path = self.backing(source, target)
            a, b = self._get(source, "type", ""), self._get(target, "type", "")
            schema = 1.0 if b in compatible.get(a, ()) or a in compatible.get(b, ()) else 0.3
            chunks = (self._get(source, "chunk", ""), self._get(target, "chunk", ""))
            apart = not chunks[0] or not chunks[1] or chunks[0] != chunks[1]
            other = self._get(source, "paper", "") != self._get(target, "paper", "")
            features = {"goal": 1.0, "similarity": similarity(self._get(source, "name", ""), self._get(target, "name", "")), "schema": schema, "backing": 1.0 if path else 0.0, "diversity": 0.5 * apart + 0.5 * other, "condition": float("ConditionNode" in (a, b)), "ambiguity": 1 - schema}
            score = round(sum(weights[k] * v for k, v in features.items()), 4)
            if path and score > 0:
                self.edges.append({"source": source, "target": target, "intent": intent, "role": role, "score": score, "path": path})
        self.edges.sort(key=lambda e: -e["score"])
        for e in self.edges:
            if not self.roles.get(e["role"]):
                self._set(e["role"], e["target"])
                self.added += e["path"]

    # ---- grounding ----

    def ground(self, seed: str, least: list[str], abstract: list[str]) -> None:
        """Empty evidence roles: the first unused physical candidate, else the chunk of an anchor."""
        used = set(self.roles.values())
        for role in least:
            if role in abstract or self.roles.get(role) or "evidence" not in role:
                continue
            picked = next((n for n in self.order if n not in used and self._get(n, "type") in PHYSICAL), None)
            if picked is None:
                anchors = [self.roles.get(a) for a in EVIDENCE_ANCHORS.get(role, [])] + list(self.roles.values()) + [seed]
                chunks = (self._get(a, "chunk", "") for a in anchors if a)
                picked = next((c for c in chunks if c and c in self.facts and c not in used), None)
            if picked:
                self._set(role, picked)
                used.add(picked)

    def fix_papers(self) -> None:
        """An instance B of another paper than A: one of the same identity first, then one of the same type."""
        a, b = self.roles.get("paper_A_instance"), self.roles.get("paper_B_instance")
        paper = self._get(a, "paper", "")
        if not paper or (b and self._get(b, "paper", "") != paper):
            return
        used = set(self.roles.values())
        elsewhere = [n for n in self.order if n not in used and self._get(n, "paper", "") != paper]
        anchor = self.roles.get("canonical_concept")
        best = next((n for n in elsewhere if anchor and self._same_elsewhere(anchor, n)), None) or next((n for n in elsewhere if self._get(n, "type") == self._get(a, "type")), None)
        if best is None and anchor:
            best = next((n for n in self.facts if n not in used and self._get(n, "paper", "") != paper and self._same_elsewhere(anchor, n)), None)
        self._set("paper_B_instance", best)

    def two_papers(self) -> bool:
        return len({p for n in self.roles.values() if (p := self._get(n, "paper", ""))}) >= 2
