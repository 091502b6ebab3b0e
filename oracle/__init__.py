"""DuckDB oracle SQL for every registered query that SQL can express."""

from oracle import commerce, dashboard, nightly, operators


def oracle_sql() -> dict[str, str]:
    from promolens.plans.operators import ALIASES
    out: dict[str, str] = {}
    for mod in (nightly, dashboard, commerce, operators):
        out.update(mod.SQL)
    for alias, target in ALIASES.items():
        if target in out:
            out[alias] = out[target]
    return out
