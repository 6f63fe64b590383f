"""Database extracts over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DRIVERS = {
    "POSTGRESQL": ("postgresql", 5432, "org.postgresql.Driver"),
    "MYSQL": ("mysql", 3306, "com.mysql.cj.jdbc.Driver"),
}


def jdbc_options(config: dict) -> dict[str, str]:
    """Reader options for a PostgreSQL or MySQL query.

    With ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` the query is read
    in parallel ranges; without them one task reads it.
    """
    kind = str(config.get("dbType", "POSTGRESQL")).upper()
    if kind not in _DRIVERS:
        raise ValueError(f"unsupported database type {kind!r}")
    scheme, port, driver = _DRIVERS[kind]
    query = (config.get("sqlQuery") or "").strip().rstrip(";")
    if not query:
        raise ValueError("a query is needed")
    host, database = config.get("host", "localhost"), config.get("database", "")
    options = {
        "url": f"jdbc:{scheme}://{host}:{config.get('port', port)}/{database}",
        "driver": driver,
        "user": config.get("username", ""),
        "password": config.get("password", ""),
        "fetchsize": str(config.get("fetchSize", 10_000)),
    }
    ranges = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
    given = {k: str(config[k]) for k in ranges if config.get(k) is not None}
    if given and len(given) < len(ranges):
        raise ValueError(f"parallel reads need all of {', '.join(ranges)}")
    # Spark takes partitioning options with a table expression only.
    options |= {**given, "dbtable": f"({query}) extract"} if given else {"query": query}
    return options


def read_database(spark: SparkSession, config: dict) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(config)).load()
