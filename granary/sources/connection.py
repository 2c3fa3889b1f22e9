"""Connection settings of a Postgres database, from the environment and a file of settings."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path
from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession

# The names of the settings, and what holds where one is missing (None: it is required).
SETTINGS = {
    "user": ("PG_POOL_USER", None),
    "password": ("PG_PASSWORD", None),
    "host": ("PG_POOL_HOST", None),
    "database": ("PG_DATABASE", "postgres"),
    "sslmode": ("PG_SSL_MODE", "require"),
    "transactions": ("PG_PSQL_USE_TRANSACTION_POOLER_PORT", "0"),
    "transaction_port": ("PG_POOL_TRANSACTION_PORT", "6543"),
    "session_port": ("PG_POOL_SESSION_PORT", "5432"),
}
LINE = re.compile(r"^\s*(?!#)([^=]*?)\s*=\s*(.*?)\s*$", re.M)


def with_file(environment: Mapping[str, str], path: str | Path) -> dict[str, str]:
    """The environment over the ``NAME=value`` lines of a file, which may be missing; of a repeated name the first line counts."""
    file = Path(path)
    found: dict[str, str] = {}
    for name, value in LINE.findall(file.read_text()) if file.is_file() else ():
        found.setdefault(name, value)
    return {**found, **environment}


def settings(environment: Mapping[str, str]) -> dict[str, str]:
    """Every setting by its short name, and the port in force; a missing required one raises."""
    missing = [name for name, default in SETTINGS.values() if default is None and name not in environment]
    if missing:
        raise KeyError(f"settings missing: {', '.join(missing)}")
    found = {short: environment.get(name, default) for short, (name, default) in SETTINGS.items()}
    return {**found, "port": found["transaction_port" if found["transactions"] == "1" else "session_port"]}


def url(environment: Mapping[str, str]) -> str:
    """The address in the form of other clients, with the password quoted."""
    s = settings(environment)
    return f"postgresql://{s['user']}:{quote_plus(s['password'])}@{s['host']}:{s['port']}/{s['database']}?sslmode={s['sslmode']}"


def jdbc_options(environment: Mapping[str, str]) -> dict[str, str]:
    """Options of ``spark.read.format("jdbc")``."""
    s = settings(environment)
    return {"url": f"jdbc:postgresql://{s['host']}:{s['port']}/{s['database']}?sslmode={s['sslmode']}", "user": s["user"], "password": s["password"], "driver": "org.postgresql.Driver"}


def read_table(spark: SparkSession, environment: Mapping[str, str], name: str, schema: str = "information_schema") -> DataFrame:
    """A table of the database; filters and columns are pushed to it."""
    return spark.read.format("jdbc").options(**jdbc_options(environment), dbtable=f"{schema}.{name}").load()
