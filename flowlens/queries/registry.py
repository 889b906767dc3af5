"""All registered queries."""

from __future__ import annotations

from flowlens.queries import learning, packets, points, tabular

_MODULES = (tabular, points, packets, learning)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}

flagship = learning.flagship
