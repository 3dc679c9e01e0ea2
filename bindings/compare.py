"""Compare two results by column name, type family and exact multiset of rows."""

from __future__ import annotations

from collections import Counter

_FAMILY = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN", "float": "FLOAT",
}


def compare(spark_types, spark_rows, oracle_types, oracle_rows) -> str | None:
    mine, theirs = dict(spark_types), dict(oracle_types)
    if sorted(mine) != sorted(theirs):
        return f"columns differ: {sorted(set(mine) ^ set(theirs))}"
    kinds = {c: (t, theirs[c]) for c, t in mine.items() if _FAMILY.get(t, t) != theirs[c]}
    if kinds:
        return f"types differ: {kinds}"
    order = sorted(mine)
    spark_at = [[n for n, _ in spark_types].index(c) for c in order]
    oracle_at = [[n for n, _ in oracle_types].index(c) for c in order]

    def key(row, places):
        return tuple(0.0 if row[p] == 0 and isinstance(row[p], float) else row[p] for p in places)

    left = Counter(key(r, spark_at) for r in spark_rows)
    right = Counter(key(r, oracle_at) for r in oracle_rows)
    if left != right:
        only_left, only_right = list((left - right).elements()), list((right - left).elements())
        return (
            f"rows differ: {len(spark_rows)} vs {len(oracle_rows)}; {len(only_left)} only here {sorted(map(str, only_left))[:2]};"
            f" {len(only_right)} only in oracle {sorted(map(str, only_right))[:2]} columns {order}"
        )
    return None if oracle_rows else "EMPTY"
