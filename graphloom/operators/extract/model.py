"""What an extractor finds in one file."""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field


@dataclass
class Found:
    """Entities and intra-file links of a file, in the order in which they were found."""

    path: str
    entities: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)

    def entity(self, kind: str, name: str, start: int = 0, end: int = 0, node: str | None = None, **meta: object) -> str:
        """Add an entity and return its id; one without a name is not added."""
        if not name:
            return ""
        node = f"{self.path}#{node}" if node else f"{self.path}#{kind}:{name}"
        self.entities.append({"entity_id": node, "type": kind, "name": name, "start_line": start, "end_line": max(start, end), "metadata": {k: str(v) for k, v in meta.items()}})
        return node

    def link(self, source: str, target: str, kind: str, weight: float = 1.0, **meta: object) -> None:
        self.links.append({"source_id": source, "target_id": target, "type": kind, "weight": weight, "source_type": "extracted", "metadata": {k: str(v) for k, v in meta.items()}})


class Lines:
    """Line numbers, from 1, of offsets in a text."""

    def __init__(self, text: str):
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]

    def of(self, offset: int) -> int:
        return bisect.bisect_left(self.breaks, offset) + 1
