"""Candidate findings: every match of every enabled type, before overlaps are resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inkveil import catalog
from inkveil.config import Config
from inkveil.functions import matching, pyengine, validators
from inkveil.functions.arrays import let, quote, strings

CANDIDATES = "array<struct<ord:int,seq:bigint,start:int,end:int,type:string,prefix:string,value:string>>"

# Letters outside ASCII that match an ASCII letter when case is ignored.
_FOLDS = {"i": "iIİı", "k": "kKK", "s": "sSſ"}


def _fold(word: str) -> str:
    """A word in any case, as plain classes: much faster to search for than a flagged regex."""
    return "".join(f"[{_FOLDS.get(c, c + c.upper())}]" if c.isalpha() else c for c in word)


def _any(*words: str) -> str:
    return "(?:" + "|".join(_fold(w) for w in words) + ")"


def _rlike(regex: str) -> str:
    return f"rlike({{t}}, {quote(regex)})"


#: How every account number begins, as in the catalog.
IBAN_BEGINS = r"\b[A-Z]{2}[0-9]{2}"

# Necessary conditions, much cheaper than the patterns they stand before. The shared ones
# are computed once per document.
_SHARED_GUARDS = {
    "two_digits": _rlike("[0-9]{2}"),
    "four_digits": _rlike("[0-9]{4}"),
    "separator": matching.holds_separator("{t}"),
    "lower": "if(octet_length({t}) = length({t}), lower({t}), null)",
    "ascii": "octet_length({t}) = length({t})",
}

# Words of secrets, looked for as plain strings in lower case where the text is ASCII.
_SECRET_PARTS = ("key", "token", "passw", "pwd", "credential", "secret", "xox", "aiza", "sk-", "sk_", "pk-", "pk_", "rk-", "rk_", "ak-", "ak_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
_LONG_TOKEN = _rlike(r"(?iu)(?<![a-z0-9_.=+/-])[a-z0-9_.=+/-]{15}")
_SECRET_WORD = _rlike(
    _any("key", "token", "passw", "pwd", "credential", "secret", "xox", "aiza")
    + "|[sSſpPrRaA][kKK][-_]|[gG][hH][pPoOuUsSſrR]_"
)

_GUARDS = {
    "private_key": "contains({t}, '-----')",
    "jwt": _rlike("[eE][yY][jJ]"),
    "connection_string": f"contains({{t}}, ';') and {_rlike('(?iu);(?:password|pwd)=')}",
    "url": "contains({t}, '://')",
    "email": "contains({t}, '@')",
    "uuid": _rlike("-[1-5][0-9a-fA-F]{3}-"),
    "ipv4": _rlike(r"[0-9]\.[0-9]"),
    "ipv6": f"contains({{t}}, '::') or {_rlike('[0-9a-fA-F]:[0-9a-fA-F]{1,4}:')}",
    "hostname": _rlike(r"(?iU)\.(?:" + "|".join(catalog.HOST_SUFFIXES) + r")\b"),
    "mac": _rlike(r"[:-][0-9a-fA-F]{2}[:-]|\.[0-9a-fA-F]{4}\."),
    "phone": "g.two_digits",
    "api_key": "if(g.lower is null, " + _SECRET_WORD + ", " + " or ".join(f"contains(g.lower, '{w}')" for w in _SECRET_PARTS) + f") and {_LONG_TOKEN}",
    "path_windows": "contains({t}, ':\\\\')",
    "path_unix": _rlike("(?iu)/(?:" + "|".join(catalog.UNIX_ROOTS) + ")/"),
    "credit_card": "g.four_digits",
    "date": _rlike(r"(?U)\d[/-]\d"),
    "iban": f"g.two_digits and {_rlike(matching.jvm_regex(IBAN_BEGINS))}",
    "ssn": "g.four_digits",
    "username": _rlike(r"(?U)[uU](?:=|[sSſ][eE]?[rR])|[lL][oO][gG][iIİı][nN]|@\d"),
    "server_name": "contains({t}, '[') or contains({t}, '|') or "
    + _rlike(r"(?U)^[\s\x1c-\x1f]*+[^\s-]++-"),
}

# What a match can begin with: lets the JVM pass over most positions with one comparison.
_BEGINS = {
    "connection_string": "[sdhj]",
    "email": r"\b[a-z0-9][a-z0-9._%+-]{0,63}+@",
    "hostname": catalog.NAME_START,
    "uuid": "[0-9a-f]",
    "ipv4": "[0-9]",
    "mac": "[0-9a-f]",
    "phone": "[0-9(+]",
    "api_key": "[apscrgx]",
    "credit_card": "[3-6]",
    "date": r"\d",
    "iban": "[a-z]",
    "ssn": "[0-9]",
    "username": r"[\s|ul\\]|^",
    "server_name": r"[fouscri|\[]|^",
}

# Necessary conditions in ASCII texts for Arrow's regexes, which scan a batch in a fraction of the JVM's time; all have to hold.
_SPACE = r"[\t-\r\x1c-\x20]"
_GAPS = r"[\t-\r\x1c-\x20.()-]{0,2}"
_SHORT_GUARDS = {
    "private_key": ("-----",),
    "jwt": ("(?i)eyj",),
    "connection_string": ("(?i);(?:password|pwd)=",),
    "url": ("://",),
    "email": ("@",),
    "uuid": ("-[1-5][0-9a-fA-F]{3}-",),
    "ipv4": (r"(?:[0-9]{1,3}\.){3}[0-9]",),
    "ipv6": ("::|[0-9a-fA-F]:[0-9a-fA-F]{1,4}:",),
    "hostname": (r"(?i)[a-z0-9]\.(?:" + "|".join(catalog.HOST_SUFFIXES) + r")\b",),
    "mac": (r"[:-][0-9a-fA-F]{2}[:-]|\.[0-9a-fA-F]{4}\.",),
    "phone": (rf"[0-9](?:{_GAPS}[0-9]){{6}}", rf"\+[1-9]|00[1-9]|[0-9](?:{_GAPS}[0-9]){{9}}"),
    "api_key": ("(?i)key|token|passw|pwd|credential|secret|xox|aiza|[sprak]k[-_]|gh[pousr]_", "[a-zA-Z0-9_.=+/-]{15}"),
    "path_windows": (r":\\",),
    "path_unix": ("(?i)/(?:" + "|".join(catalog.UNIX_ROOTS) + ")/",),
    "credit_card": (r"[3-6][0-9]{3}[\t-\r\x1c-\x20-]?[0-9]{4}",),
    "date": ("[0-9][/-][0-9]",),
    "iban": (rf"[a-zA-Z]{{2}}[0-9]{{2}}{_SPACE}?[a-zA-Z0-9]{{4}}{_SPACE}?[a-zA-Z0-9]{{4}}",),
    "ssn": ("[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}",),
    "username": (r"(?i)u=|user|usr|login|@[0-9]",),
    "server_name": (rf"[\[|]|^{_SPACE}*[a-zA-Z][a-zA-Z0-9]*-",),
}

# Patterns without looking around, in any case: lead and value. What comes before a value is no part of the finding before it.
_PLAIN_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\."
_SHORT_PLAIN = {
    "email": ("", rf"\b[a-z0-9](?:[a-z0-9._%+-]{{0,62}}[a-z0-9])?@(?:{_PLAIN_LABEL})+[a-z]{{2,63}}\b"),
    "ipv4": ("", catalog.TYPE_BY_NAME["ipv4"].pattern),
    "hostname": ("", rf"\b(?:{_PLAIN_LABEL})+(?:{'|'.join(catalog.HOST_SUFFIXES)})\b"),
    "path_windows": ("", r"""[a-z]:(?:\\{1,2}[^\\/:*?"<>|\t-\r\x1c-\x20]+)+"""),
    "path_unix": ("^|[^a-z0-9]", f"/(?:{'|'.join(catalog.UNIX_ROOTS)})/[a-z0-9._@%/-]+"),
    "username": (r"""(?:user|username|usr|login)[=:\t-\r\x1c-\x20]+["']?""", "[a-z][a-z0-9_.-]{1,63}"),
}

# Texts where a form of the pattern may match that is not among the plain ones.
_SHORT_UNLESS = {"username": rf"(?i)(?:^|{_SPACE}|[|])u=|@[0-9]"}

_CHECKS = {"phone": validators.phone_sql, "credit_card": validators.card_sql}


def candidates_sql(text: str, config: Config, kinds: str | None = None) -> str:
    """All candidates of ``text`` as one JVM expression, for SQL functions.

    ``kinds`` is SQL for an array of type names: others are not searched for, and not even planned where it is a literal.
    """
    if not all(p.portable for p in config.custom):
        raise ValueError("custom patterns that Python searches need a DataFrame job")
    names = [name for name in catalog.TYPE_NAMES if name in config.types]
    return _combined(text, config, names, _plain(config), None, None, kinds)


def _plain(config: Config) -> list:
    return [(ord_, p) for ord_, p in _custom(config) if p.portable]


def _custom(config: Config) -> list:
    return list(enumerate(config.custom, start=len(catalog.TYPES) + 1))


def _combined(
    text: str, config: Config, names: list, custom: list, scored: str | None, found: str | None, kinds: str | None = None, short: str | None = None
) -> str:
    def wanted(name: str) -> str | None:
        return f"array_contains({kinds}, {quote(name)})" if kinds else None

    hits = [_builtin_hits("t", name, wanted(name)) for name in names]
    hits += [
        matching.hits("t", matching.jvm_custom_regex(p.regex), ord_, wanted(catalog.CUSTOM), marked_text="g.separator")
        for ord_, p in custom
    ]
    parts = []
    if hits:
        guards = ", ".join(f"{_filled(sql, 't')} as {name}" for name, sql in _SHARED_GUARDS.items())
        located = let("n", "length(t)", matching.located(f"concat({', '.join(hits)})", "n"))
        part = let("t", text, let("g", f"struct({guards})", located))
        parts.append(f"if({short} is null, {part}, {short})" if short else part)
    if found is not None:
        parts.append(found)
    rows = [_named(_checked(part, config), config) for part in parts]
    if scored is not None:
        rows.insert(0, _admitted(scored, config))
    empty = f"cast(array() as {CANDIDATES})"
    return f"if({text} is null, {empty}, concat({', '.join(rows)}))" if rows else empty


def with_candidates(
    df: DataFrame,
    config: Config,
    text: str = "text",
    out: str = "candidates",
    scored: str | None = None,
    engine: str = "jvm",
) -> DataFrame:
    """Add ``out``: all candidates of the row's text, as an array.

    ``scored`` names an array column of outside findings that rank first. ``engine='python'``
    runs every pattern with Python's regex engine in Arrow batches instead of in the JVM;
    custom patterns with groups always run there, because a JVM expression cannot tell
    where a group begins. Short ASCII texts are searched for the built-in types in Arrow batches too, as that is
    several times faster and finds the same; others pass by.
    """
    if out in df.columns:
        raise ValueError(f"column {out!r} exists already")
    if engine not in ("jvm", "python"):
        raise ValueError("engine must be 'jvm' or 'python'")
    in_jvm = engine == "jvm"
    names = [name for name in catalog.TYPE_NAMES if name in config.types]
    slow = [] if in_jvm else [(catalog.RANK[n], catalog.TYPE_BY_NAME[n].pattern) for n in names]
    slow += [(ord_, p.regex) for ord_, p in _custom(config) if not in_jvm or not p.portable]
    if slow:
        df = df.withColumn("__found", pyengine.finder(slow)(F.col(text)))
    short = in_jvm and bool(names) and not config.custom
    if short:
        search = pyengine.short_finder([_short(n) for n in names])
        df = df.withColumn("__short", search(F.expr(f"if({pyengine.is_short(f'`{text}`')}, `{text}`, null)")))
    value = _combined(
        f"`{text}`",
        config,
        names if in_jvm else [],
        _plain(config) if in_jvm else [],
        f"`{scored}`" if scored else None,
        "__found" if slow else None,
        short="__short" if short else None,
    )
    return df.withColumn(out, F.expr(value)).drop("__found", "__short")


def _short(name: str) -> pyengine.Short:
    return pyengine.Short(
        catalog.RANK[name], catalog.TYPE_BY_NAME[name].pattern, _SHORT_GUARDS[name], _SHORT_PLAIN.get(name), _SHORT_UNLESS.get(name)
    )


def _filled(guard: str, text: str) -> str:
    return guard.replace("{t}", text)


def _builtin_hits(text: str, name: str, wanted: str | None = None) -> str:
    spec = catalog.TYPE_BY_NAME[name]
    guard = _filled(_GUARDS[name], text) if name in _GUARDS else None
    if wanted:
        guard = f"{wanted} and ({guard})" if guard else wanted
    split = matching.jvm_regex(spec.split) if spec.split else None
    pattern = f"(?={_BEGINS[name]})(?:{spec.pattern})" if name in _BEGINS else spec.pattern
    plain = ("g.ascii", matching.ascii_regex(pattern))
    return matching.hits(text, matching.jvm_regex(pattern), catalog.RANK[name], guard, split, "g.separator", plain)


def _checked(found: str, config: Config) -> str:
    """Drop findings that fail their type's check, and preserved ones."""
    keep = [
        f"(x.ord <> {catalog.RANK[name]} or ({rule('x.value')}))"
        for name, rule in _CHECKS.items()
        if name in config.types
    ]
    if config.preserve:
        keep.append(f"not {validators.preserved_sql('x.value', config.preserve)}")
    return f"filter({found}, x -> {' and '.join(keep)})" if keep else found


def _named(found: str, config: Config) -> str:
    """Name the type and prefix of a located finding by its rank."""
    types = [*catalog.TYPE_NAMES, *[catalog.CUSTOM for _ in config.custom]]
    prefixes = [catalog.PREFIXES[name] for name in catalog.TYPE_NAMES]
    prefixes += [config.prefix_of(pattern) for pattern in config.custom]
    return (
        f"cast(transform({found}, x -> struct(x.ord, x.start, x.start, x.end, "
        f"element_at({strings(types)}, x.ord), element_at({strings(prefixes)}, x.ord), x.value)) as {CANDIDATES})"
    )


def _admitted(scored: str, config: Config) -> str:
    """Scored findings of enabled types with a real span that are not preserved."""
    kept = strings([*sorted(config.types), catalog.CUSTOM])
    return (
        f"filter(coalesce({scored}, cast(array() as {CANDIDATES})), x -> x.start >= 0 and x.end > x.start "
        f"and array_contains({kept}, x.type) and not {validators.preserved_sql('x.value', config.preserve)})"
    )
