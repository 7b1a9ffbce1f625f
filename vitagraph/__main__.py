"""Command line: ``python -m vitagraph validate GRAPH [VOCAB]`` or ``query NAME GRAPH [key=value ...]``.

``validate`` prints the problems and ends with 1 if one is an error.  ``query`` prints the rows as JSON
lines; plain values fill the required arguments in their order.
"""

from __future__ import annotations

import sys


def _session():
    from pyspark.sql import SparkSession

    from .runtime import ship

    spark = SparkSession.builder.appName("vitagraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    return spark


def arguments(query, given: list[str]) -> dict[str, str]:
    """key=value pairs, and plain values for the required arguments that no pair names."""
    named = dict(g.split("=", 1) for g in given if "=" in g)
    open_ = (a for a in query.required if a not in named)
    return named | dict(zip(open_, (g for g in given if "=" not in g), strict=False))


def main(args: list[str]) -> int:
    from .plans import registry
    from .sources.seed import load_graph

    if len(args) >= 2 and args[0] == "validate":
        from .operators.validate import validate

        rows = validate(load_graph(_session(), args[1], *args[2:3])).collect()
        for r in rows:
            print(f"{r['severity']}: {r['message']}")
        return int(any(r["severity"] == "error" for r in rows))
    if len(args) >= 3 and args[0] == "query" and args[1] in registry.QUERIES:
        query = registry.QUERIES[args[1]]
        out = query(load_graph(_session(), args[2]), arguments(query, args[3:]))
        parts = out if isinstance(out, dict) else {"": getattr(out, "steps", out)}
        for name, df in parts.items():
            for line in df.toJSON().collect() if df is not None else []:
                print(f"{name} {line}".strip())
        return 0
    print(__doc__, "Queries:", ", ".join(registry.QUERIES), file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
