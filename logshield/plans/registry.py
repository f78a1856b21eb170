"""The registry that the modules of queries fill: queries and their SQL oracles by name."""

from __future__ import annotations

from logshield.operators import verdicts as VD

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


DEFAULT = VD.Policies(allowed_endpoints=("^/api/.*",))
