"""``python -m brickwise QUERY FOLDER [OUT]``: run a registered query, show it or write it as Parquet."""

from __future__ import annotations

import sys

from brickwise.plans import catalog
from brickwise.session import build_session


def main(argv: list[str]) -> int:
    known = catalog.queries()
    if len(argv) < 2 or argv[0] not in known:
        print(__doc__, "\nQueries:", *sorted(known), sep="\n")
        return 2
    spark = build_session()
    rows = known[argv[0]](spark, argv[1])
    if len(argv) > 2:
        rows.write.parquet(argv[2])
    else:
        rows.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
