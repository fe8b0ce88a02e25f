"""How plans register queries with their SQL twins."""

from __future__ import annotations


def _long(df):
    """Ranks as long, which is what SQL's row_number() gives elsewhere."""
    kind = dict(df.dtypes)
    return df.withColumns({c: df[c].cast("long") for c in ("rank", "marker") if kind.get(c) == "int"})


def collection():
    queries: dict = {}
    oracles: dict = {}

    def add(name, query, *sql):
        """sql: common table expressions, then the select; none if SQL can't express the query."""
        queries[name] = lambda spark, sf_dir: _long(query(spark, sf_dir))
        if sql:
            *ctes, select = sql
            head = f"WITH {', '.join(ctes)} " if ctes else ""
            oracles[name] = head + select

    return queries, oracles, add
