"""All registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "g1_topk"
QUERIES: dict = {}
ORACLES: dict = {}

for _name in ("telemetry", "corpus", "text", "retrieval", "labelling", "answers", "flows"):
    _plan = import_module(f"{__package__}.{_name}")
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
