"""All registered queries, with their SQL where SQL can express them."""

from __future__ import annotations

from foliate.plans import documents, exports, graphs, loose, manuscripts, repairs

PLANS = (documents, manuscripts, graphs, exports, repairs, loose)
QUERIES: dict = {name: function for plan in PLANS for name, function in plan.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
