"""Read a table of the source database over JDBC, with the connection taken from an ini file."""

from __future__ import annotations

from configparser import ConfigParser
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from stockflow import schema

REQUIRED = ("user", "password", "host", "port", "dbname", "sslmode")


def connection_settings(ini_path, section: str = "postgresql") -> dict[str, str]:
    """The REQUIRED settings of one ini section. An empty value counts as missing; `database` stands in for `dbname`.

    A missing file raises FileNotFoundError, a missing section or setting KeyError.
    """
    ini = ConfigParser()
    with open(ini_path) as text:
        ini.read_file(text)
    given = ini[section]
    found = {name: given.get(name) for name in REQUIRED}
    found["dbname"] = found["dbname"] or given.get("database")
    missing = ", ".join(name for name in REQUIRED if not found[name])
    if missing:
        raise KeyError(f"[{section}] of {ini_path} lacks {missing}")
    return found


def jdbc_options(table: str, ini_path, section: str = "postgresql") -> dict[str, str]:
    settings = connection_settings(ini_path, section)
    port = int(settings["port"])
    names = ", ".join(f'"{c}"' for c in schema.columns(table))
    return {
        "url": f"jdbc:postgresql://{settings['host']}:{port}/{settings['dbname']}?sslmode={settings['sslmode']}",
        "user": settings["user"],
        "password": settings["password"],
        "driver": "org.postgresql.Driver",
        "dbtable": f'(select {names} from "{table}") as {table}',
        "fetchsize": "10000",
    }


def created_ranges(edges: list[datetime]) -> list[str]:
    """Disjoint conditions on created_at that together cover the table (created_at is never null)."""
    if not edges:
        return ["created_at is not null"]
    stamps = [f"timestamptz '{e.isoformat(sep=' ')}'" for e in sorted(edges)]
    inner = [f"created_at >= {a} and created_at < {b}" for a, b in zip(stamps, stamps[1:])]
    return [f"created_at < {stamps[0]}", *inner, f"created_at >= {stamps[-1]}"]


def range_query(table: str) -> str:
    """The query that a plan of parallel reads needs: first and last created_at, and the number of rows."""
    return f'select min(created_at) as first_at, max(created_at) as last_at, count(*) as row_count from "{table}"'


def created_edges(first_at: datetime | None, last_at: datetime | None, row_count: int, rows_per_read: int) -> list[datetime]:
    """Edges of equally long ranges of created_at, about rows_per_read rows in each if they are spread evenly.

    None for an empty table, for rows of one moment, and for fewer rows than two reads would take.
    """
    reads = -(-row_count // rows_per_read)
    if first_at is None or last_at is None or reads < 2 or first_at >= last_at:
        return []
    return sorted({first_at + (last_at - first_at) * i / reads for i in range(1, reads)})


def jdbc_source(
    spark: SparkSession, table: str, ini_path, section: str = "postgresql", edges: list[datetime] | None = None,
    rows_per_read: int | None = None,
) -> DataFrame:
    """One table over JDBC; with edges, one parallel read per range of created_at.

    With rows_per_read and no edges, one query asks for the range and the number of rows first, and the edges follow from it.
    """
    options = jdbc_options(table, ini_path, section)
    if edges is None and rows_per_read:
        asked = {k: v for k, v in options.items() if k != "dbtable"} | {"query": range_query(table)}
        edges = created_edges(*spark.read.format("jdbc").options(**asked).load().first(), rows_per_read)
    if edges:
        connection = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
        return spark.read.jdbc(options["url"], options["dbtable"], predicates=created_ranges(edges), properties=connection)
    return spark.read.format("jdbc").options(**options).load()
