"""Query catalogue: every operator applied to the driver tables, with its ANSI-SQL twin.

A query is a function of `Tables`; `sql` is the DuckDB text that must give the same rows.
"""

from importlib import import_module

FAMILIES = (
    "store",
    "scalars",
    "leaderboards",
    "experiments",
    "tests",
    "ordered",
    "training",
    "suites",
    "knowledge",
    "boards",
    "replays",
    "streams",
    "files",
)


def load() -> None:
    """Import every family so that its queries register themselves."""
    for family in FAMILIES:
        import_module(f"catalog.{family}")
