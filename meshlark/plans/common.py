"""What the family modules share: the registration decorator."""

from __future__ import annotations

from meshlark.sources.tables import Tables


def registrar(queries: dict, oracles: dict):
    """``@query(name, oracle)`` keeps fn(Tables) as queries[name](spark, sf_dir) and its SQL check."""

    def query(name: str, oracle: str | None = None):
        def keep(fn):
            queries[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            if oracle is not None:
                oracles[name] = oracle
            return fn

        return keep

    return query
