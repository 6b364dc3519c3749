"""python -m quillon NAME SF_DIR [OUT]: runs a query of the catalogue and shows its rows or writes them as Parquet."""

from __future__ import annotations

import sys

from quillon.plans.catalogue import QUERIES
from quillon.session import local_session


def main(args: list[str]) -> int:
    if len(args) not in (2, 3) or args[0] not in QUERIES:
        print(__doc__, "Queries:", *sorted(QUERIES), sep="\n")
        return 2
    df = QUERIES[args[0]](local_session(), args[1])
    if len(args) == 3:
        df.write.mode("errorifexists").parquet(args[2])
    else:
        df.show(truncate=60)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
