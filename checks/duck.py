"""Building blocks of the DuckDB statements that check the Spark queries.

Patterns that RE2 takes come from the catalog; those with look-around or possessive loops
are spelled here in a plain form with the same matches on these tables.
"""

from __future__ import annotations

from inkveil import catalog

_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\."

PLAIN = {
    "connection_string": r"(?:Server|Data Source|Host|jdbc:[a-z]+:)=[^;\s]+(?:;[^;\s]+)*(?:;(?:Password|Pwd)=[^;\s]+)",
    "email": rf"\b[A-Za-z0-9](?:[A-Za-z0-9._%+-]{{0,62}}[A-Za-z0-9])?@(?:{_LABEL})+[A-Za-z]{{2,63}}\b",
    "hostname": rf"\b(?:{_LABEL})+(?:{'|'.join(catalog.HOST_SUFFIXES)})\b",
    "path_windows": r"""[A-Za-z]:\\{1,2}(?:[^\\/:*?"<>|\r\n\s]+\\{1,2})*[^\\/:*?"<>|\r\n\s]+""",
    "path_unix": rf"(?:^|[^A-Za-z0-9])/(?:{'|'.join(catalog.UNIX_ROOTS)})/[a-zA-Z0-9._@%/-]+",
    "username": r"""(?:(?:^|[\s|])u=[a-zA-Z][a-zA-Z0-9_-]{1,31}(?:[\s|,;]|$)"""
    r"""|(?:user|username|usr|login)[=:\s]+["']?[a-zA-Z][a-zA-Z0-9_.-]{1,63}["']?"""
    r"""|(?:^|[\s]|\\r\\n|\\n)[a-zA-Z][a-zA-Z0-9_-]{1,31}@\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})""",
    "server_name": rf"(?:{catalog.PLAY_STATUSES}:[\s]*\[[A-Za-z][A-Za-z0-9_-]{{2,}}\]"
    r"|\[[A-Z][A-Z0-9_-]*-[A-Za-z0-9_]+\]"
    r"|(?:^|\|)[\s]*[A-Z][A-Z0-9]*(?:-[A-Za-z0-9_]+)+[\s]*(?:[|:]|[\s]ok=))",
}

SPLIT = {
    "api_key": catalog.TYPE_BY_NAME["api_key"].split,
    "path_unix": r"^([^/]?)(/.*)$",
    "username": r"""^([\s|]?u=|(?:user|username|usr|login)[=:\s]+["']?|(?:[\s]|\\r\\n|\\n)?)"""
    r"""([a-zA-Z][a-zA-Z0-9_.-]*)(?:["'|,;\s]|@[0-9.]+)?$""",
    "server_name": rf"^({catalog.PLAY_STATUSES}:[\s]*\[|\[|\|?[\s]*)([A-Za-z][A-Za-z0-9_-]*)[\s\]|:]*(?:ok=)?$",
}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pattern(kind: str) -> str:
    return "(?i)" + PLAIN.get(kind, catalog.TYPE_BY_NAME[kind].pattern)


def matches(table: str, keys: str, regex: str, text: str = "text", split: str | None = None) -> str:
    """SELECT of ``keys, value, start`` of every match of a regex over a table."""
    re = lit(regex)
    lead, value = "0", "m"
    if split is not None:
        sp = lit("(?is)" + split)
        value = f"coalesce(nullif(regexp_extract(m, {sp}, 2), ''), m)"
        lead = f"length(regexp_extract(m, {sp}, 1))"
    return (
        f"SELECT {keys}, {value} AS value, CAST(start0 + {lead} AS INTEGER) AS start FROM ("
        f"SELECT {keys}, ms[i] AS m, coalesce(list_sum(list_transform(ps[1:i], lambda z: length(z))), 0) "
        f"+ coalesce(list_sum(list_transform(ms[1:i-1], lambda z: length(z))), 0) AS start0 FROM ("
        f"SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ("
        f"SELECT {keys}, regexp_extract_all({text}, {re}) AS ms, string_split_regex({text}, {re}) AS ps "
        f"FROM {table} WHERE regexp_matches({text}, {re}))))"
    )


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '', 'g')"


def luhn(value: str) -> str:
    """Luhn check by list arithmetic over the reversed digits."""
    doubled = (
        f"list_transform(range(1, length({digits(value)}) + 1), lambda j: "
        f"CASE WHEN j % 2 = 0 THEN (2 * CAST(substr(reverse({digits(value)}), j, 1) AS INTEGER)) // 10 "
        f"+ (2 * CAST(substr(reverse({digits(value)}), j, 1) AS INTEGER)) % 10 "
        f"ELSE CAST(substr(reverse({digits(value)}), j, 1) AS INTEGER) END)"
    )
    return f"(length({digits(value)}) >= 13 AND list_sum({doubled}) % 10 = 0)"


def check(kind: str) -> str:
    if kind == "credit_card":
        return luhn("value")
    if kind == "phone":
        return f"length({digits('value')}) >= 8"
    return "true"


def candidates(table: str, keys: str, kinds: list[str], text: str = "text", preserve: list[str] = ()) -> str:
    """UNION of all candidates: ``keys, ord, seq, s, e, type, prefix, value``."""
    kept = " AND ".join(f"NOT contains(lower(value), {lit(p.lower())})" for p in preserve) or "true"
    parts = []
    for kind in kinds:
        found = matches(table, keys, pattern(kind), text, SPLIT.get(kind))
        parts.append(
            f"SELECT {keys}, {catalog.RANK[kind]} AS ord, start AS seq, start AS s, start + length(value) AS e, "
            f"{lit(kind)} AS type, {lit(catalog.PREFIXES[kind])} AS prefix, value "
            f"FROM ({found}) WHERE {check(kind)} AND {kept}"
        )
    return " UNION ALL ".join(parts)


def custom(table: str, keys: str, regex: str, ord_: int, text: str = "text", prefix: str = "VAL", split: str | None = None) -> str:
    return (
        f"SELECT {keys}, {ord_} AS ord, start AS seq, start AS s, start + length(value) AS e, 'custom' AS type, "
        f"{lit(prefix)} AS prefix, value FROM ({matches(table, keys, '(?i)' + regex, text, split)})"
    )


def resolved(cands: str, keys: str) -> str:
    """The overlap rules as a fold over each document's candidates in rank order."""
    overlap = "(f.e > x.s AND f.s < x.e)"
    x_covers, f_covers = "(x.s <= f.s AND x.e >= f.e)", "(f.s <= x.s AND f.e >= x.e)"
    refused = f"{overlap} AND NOT {x_covers} AND ({f_covers} OR (x.e - x.s) <= (f.e - f.s))"

    def with_x(body: str) -> str:
        return body.replace("x.", "y[1].")

    fold = (
        "list_reduce(list([struct_pack(s := s, e := e, type := type, prefix := prefix, value := value)] ORDER BY ord, seq), "
        f"lambda acc, y: CASE WHEN len(list_filter(acc, lambda f: {with_x(refused)})) > 0 THEN acc "
        f"ELSE list_concat(list_filter(acc, lambda f: NOT {with_x(overlap)}), y) END)"
    )
    return (
        f"SELECT {keys}, k.s AS s, k.e AS e, k.type AS type, k.prefix AS prefix, k.value AS value FROM ("
        f"SELECT {keys}, unnest({fold}) AS k FROM ({cands}) GROUP BY {keys})"
    )


def found(table: str, keys: str, kinds: list[str], text: str = "text", preserve: list[str] = ()) -> str:
    """All findings of several types: ``keys, s, e, type, prefix, value``."""
    return resolved(candidates(table, keys, kinds, text, preserve), keys)


def mapping(findings: str, doc: str, scope: str, existing: str | None = None) -> str:
    """``scope, value, prefix, n, placeholder, first_seq, first_pos`` by the numbering rule."""
    anti = ""
    base = "0"
    if existing is not None:
        anti = f" WHERE NOT EXISTS (SELECT 1 FROM ({existing}) x WHERE x.scope = v.scope AND x.value = v.value)"
        base = f"coalesce((SELECT max(x.n) FROM ({existing}) x WHERE x.scope = v.scope AND x.prefix = v.prefix), 0)"
    ranked = (
        f"SELECT {scope} AS scope, value, prefix, {doc} AS first_seq, s AS first_pos, "
        f"row_number() OVER (PARTITION BY {scope}, value ORDER BY {doc}, s DESC) AS pick FROM ({findings})"
    )
    numbered = (
        f"SELECT scope, value, prefix, first_seq, first_pos, {base} + row_number() OVER "
        f"(PARTITION BY scope, prefix ORDER BY first_seq, first_pos DESC) AS n FROM "
        f"(SELECT * FROM ({ranked}) WHERE pick = 1) v{anti}"
    )
    return (
        "SELECT scope, value, printf('[%s_%03d]', prefix, n) AS placeholder, prefix, CAST(n AS BIGINT) AS n, "
        f"first_seq, first_pos FROM ({numbered})"
    )


def redacted(table: str, doc: str, findings: str, mapped: str, scope: str, text: str = "text") -> str:
    """``doc, redacted`` for every row of the table, rebuilt from its pieces."""
    return (
        f"SELECT t.{doc} AS {doc}, coalesce(r.body || substr(t.{text}, r.tail + 1), t.{text}) AS redacted FROM {table} t "
        f"LEFT JOIN (SELECT {doc}, string_agg(piece, '' ORDER BY s) AS body, max(e) AS tail FROM ("
        f"SELECT f.{doc}, f.s, f.e, substr(d.{text}, coalesce(lag(f.e) OVER (PARTITION BY f.{doc} ORDER BY f.s), 0) + 1, "
        f"f.s - coalesce(lag(f.e) OVER (PARTITION BY f.{doc} ORDER BY f.s), 0)) || m.placeholder AS piece "
        f"FROM ({findings}) f JOIN ({mapped}) m ON m.value = f.value AND m.scope = {scope} "
        f"JOIN {table} d ON d.{doc} = f.{doc}) GROUP BY {doc}) r ON r.{doc} = t.{doc}"
    )
