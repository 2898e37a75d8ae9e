"""How a module of queries names them."""

from __future__ import annotations


def register(queries: dict, oracles: dict[str, str]):
    """A decorator that puts a query under its name, beside the SQL that gives the same rows if there is one."""

    def query(sql: str | None = None):
        def add(function):
            queries[function.__name__] = function
            if sql is not None:
                oracles[function.__name__] = sql
            return function

        return add

    return query
