"""Queries of the corpus operators, one module each, and their SQL where SQL can express them."""

from functools import wraps

from ..shipping import ship
from . import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13

_MODULES = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, op11, op12, op13)


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(f) for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
