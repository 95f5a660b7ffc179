"""Grouping rules: from the JSON tree to flat paths."""

from __future__ import annotations

import json
from dataclasses import dataclass


@dataclass(frozen=True)
class RulePath:
    """One leaf: the group holds if every feature position has its value.

    ``rank`` is the place in document order. Where several paths hold, the one
    with the highest rank decides.
    """

    rank: int
    conditions: tuple[tuple[int, str], ...]
    group: str

    @property
    def positions(self) -> tuple[int, ...]:
        return tuple(position for position, _ in self.conditions)


def flatten_rules(rules: str | dict) -> list[RulePath]:
    """Paths of a ``{Field, Table: [{Key, Rule}]}`` tree with ``{GroupName}`` leaves.

    The message form wrapped in ``GroupingRules`` is accepted too. A node that
    has both a field and a group name is read as a field node. A path asking two
    values of one position can never hold and is left out, as is a leaf whose name is null.
    """
    tree = json.loads(rules) if isinstance(rules, str) else rules
    pending = [(tree.get("GroupingRules", tree), {})]
    paths: list[RulePath] = []
    while pending:
        node, conditions = pending.pop()
        if "Field" in node:
            position = int(node["Field"])
            for entry in reversed(node["Table"]):
                if conditions.get(position, entry["Key"]) == entry["Key"]:
                    pending.append((entry["Rule"], {**conditions, position: entry["Key"]}))
        elif node.get("GroupName") is not None:
            paths.append(RulePath(len(paths), tuple(sorted(conditions.items())), node["GroupName"]))
    return paths
