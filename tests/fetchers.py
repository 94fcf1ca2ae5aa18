"""Stand-ins for providers, imported by name where a source reads."""

from lorekeep.sources.connectors import Page, as_items


def numbers(options, cursor):
    end = int(options.get("end", 25))
    upto = min(cursor + 10, end)
    rows = [{"n": n, "who": options["account"], "played_at": f"2024-01-{n + 1:02d}"} for n in range(cursor, upto)]
    return Page(as_items(rows), upto if upto < end else None, [r["n"] % 5 != 4 for r in rows])


def stuck(options, cursor):
    return Page(as_items([{"n": cursor}]), 0)
