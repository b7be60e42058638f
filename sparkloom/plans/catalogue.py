"""Every query of the library's own operators, with its SQL counterpart."""

from __future__ import annotations

from sparkloom.plans import corpus, relational


def queries() -> dict:
    return {**corpus.QUERIES, **relational.QUERIES}


def oracle_sql() -> dict:
    return {**corpus.SQL, **relational.SQL}
