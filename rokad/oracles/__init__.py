"""Check SQL for the registered jobs."""


def all_sql() -> dict[str, str]:
    from . import bank, books, imports, ingest, reports, tax
    out: dict[str, str] = {}
    for module in (reports, bank, tax, books, ingest, imports):
        out.update(module.SQL)
    return out
