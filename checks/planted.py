"""Log lines with one planted value each, made from a key column by the same formula in Spark and in DuckDB.

Each template is ``lead``, a value built from the integer key ``k``, and ``tail``. The
finding expected of a line is then known without any regex: the value, at the end of the lead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    """``value`` is SQL over ``k``; ``{hex(n)}`` marks zero-padded lower-case hex digits of ``k``."""

    lead: str
    value: str
    tail: str


def pad(n: int, of: str = "k") -> str:
    return f"lpad(cast({of} as varchar(30)), {n}, '0')"


TEMPLATES = {
    "ipv4": Template(
        "conn from ",
        "concat('10.', cast((k // 65536) % 256 as varchar(9)), '.', cast((k // 256) % 256 as varchar(9)), '.', "
        "cast(k % 256 as varchar(9)))",
        " refused",
    ),
    "ipv6": Template("peer ", "concat('2001:db8::', {hex(k % 65536)})", " up"),
    "email": Template(
        "mail to ", "concat('u', cast(k as varchar(20)), '@mail', cast(k % 7 as varchar(9)), '.example.com')", " now"
    ),
    "hostname": Template("node ", "concat('db-', cast(k as varchar(20)), '.internal.corp')", " down"),
    "url": Template("GET ", "concat('https://h', cast(k as varchar(20)), '.example.com/p?x=1')", " done"),
    "uuid": Template("id ", "concat(lpad({hex(k)}, 8, '0'), '-0000-4000-8000-', lpad({hex(k)}, 12, '0'))", " end"),
    "mac": Template(
        "if ",
        "concat('aa:bb:cc:dd:', lpad({hex((k // 256) % 256)}, 2, '0'), ':', lpad({hex(k % 256)}, 2, '0'))",
        " up",
    ),
    "phone": Template("call ", f"concat('(212) 555-', {pad(4, 'k % 10000')})", " ok"),
    "api_key": Template("api_key=", f"concat('Zqxw', {pad(16)})", " used"),
    "jwt": Template(
        "bearer ", f"concat('eyJhbGciOiJIUzI1.eyJzdWIi', {pad(10)}, '.c2lnbmF0', {pad(10)})", " ok"
    ),
    "connection_string": Template(
        "cs ",
        "concat('Server=db', cast(k as varchar(20)), ';Database=x;Pwd=s3c', cast(k % 1000 as varchar(9)))",
        " used",
    ),
    "private_key": Template(
        "pem ",
        "concat('-----BEGIN RSA PRIVATE KEY-----', {newline}, cast(k as varchar(20)), {newline}, "
        "'-----END RSA PRIVATE KEY-----')",
        " end",
    ),
    "path_unix": Template("open ", "concat('/var/log/app', cast(k as varchar(20)), '/x.log')", " now"),
    "path_windows": Template(
        "open ",
        "concat('C:', {backslash}, 'data', {backslash}, 'u', cast(k as varchar(20)), {backslash}, 'f.txt')",
        " now",
    ),
    "credit_card": Template(
        "card ",
        "case k % 4 when 0 then '4111111111111111' when 1 then '5500005555555559' "
        "when 2 then '378282246310005' else '6011111111111117' end",
        " ok",
    ),
    "date": Template("on ", f"concat('2024-01-', {pad(2, '1 + k % 28')})", " done"),
    "iban": Template("iban ", f"concat('FR76', {pad(23)})", " ok"),
    "ssn": Template("ssn ", f"concat('123-45-', {pad(4, 'k % 10000')})", " end"),
    "username": Template("user=", "concat('alice_', cast(k as varchar(20)))", " logged"),
    "server_name": Template("ok: [", "concat('SRV-DB-', cast(k as varchar(20)))", "]"),
}


def fill(sql: str, dialect: str) -> str:
    while "{hex(" in sql:
        start = sql.index("{hex(")
        end = sql.index(")}", start)
        inner = sql[start + 5 : end]
        spelled = f"lower(hex({inner}))" if dialect == "spark" else f"printf('%x', {inner})"
        sql = sql[:start] + spelled + sql[end + 2 :]
    for mark, code in (("{newline}", 10), ("{backslash}", 92)):
        sql = sql.replace(mark, f"chr({code})")
    if dialect == "spark":
        sql = sql.replace(" // ", " div ")
    return sql


def value_sql(kind: str, dialect: str, key: str = "k") -> str:
    sql = fill(TEMPLATES[kind].value, dialect)
    if key != "k":
        sql = re.sub(r"\bk\b", f"({key})", sql)
    return sql


def text_sql(kind: str, dialect: str, key: str = "k") -> str:
    t = TEMPLATES[kind]
    return f"concat('{t.lead}', {value_sql(kind, dialect, key)}, '{t.tail}')"


# Lines with several values: (type, key expression); repeats come from the modulo.
SERVICE_LOG = (
    ("email", "user_id"),
    ("ipv4", "event_id % 200"),
    ("path_unix", "event_id % 97"),
    ("path_windows", "user_id % 5"),
    ("username", "user_id"),
)
SEPARATOR = " # "


def line_sql(parts: tuple, dialect: str) -> str:
    return "concat(" + f", '{SEPARATOR}', ".join(text_sql(kind, dialect, key) for kind, key in parts) + ")"


def expected_sql(parts: tuple, table: str, columns: str, dialect: str = "duck") -> str:
    """``columns, s, e, type, prefix, value`` of every planted value of a line."""
    from inkveil import catalog

    rows = []
    before = "0"
    for kind, key in parts:
        value = value_sql(kind, dialect, key)
        t = TEMPLATES[kind]
        start = f"({before} + {len(t.lead)})"
        rows.append(
            f"SELECT {columns}, {start} AS s, {start} + length({value}) AS e, '{kind}' AS type, "
            f"'{catalog.PREFIXES[kind]}' AS prefix, {value} AS value FROM {table}"
        )
        before = f"({start} + length({value}) + {len(t.tail) + len(SEPARATOR)})"
    return " UNION ALL ".join(rows)
