"""SQL statements that check the registered queries in another engine."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from oracle import core, models, serving, studies

    return {**core.ORACLE, **serving.ORACLE, **models.ORACLE, **studies.ORACLE}
