"""The DuckDB statements that give the expected rows of each Spark query."""

from __future__ import annotations

from checks import duck, planted, queries as q
from inkveil import catalog

END = '"end"'
SPAN = f"type, value, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS {END}"
TYPES = list(q.REDACT_TYPES)
GLOBAL = "''"


def find_planted(kind: str) -> str:
    t = planted.TEMPLATES[kind]
    value = planted.value_sql(kind, "duck", "event_id")
    return (
        f"SELECT event_id, '{kind}' AS type, {value} AS value, {len(t.lead)} AS start, "
        f"CAST({len(t.lead)} + length({value}) AS INTEGER) AS {END} FROM events"
    )


def find_in(source: str, key: str, text: str, kinds=None, preserve=()) -> str:
    kinds = list(kinds or catalog.TYPE_NAMES)
    return f"SELECT {key}, {SPAN} FROM ({duck.found(source, key, kinds, text, preserve)})"


def planted_case(kind: str, lead: str, value: str) -> str:
    return (
        f"SELECT event_id, '{kind}' AS type, {value} AS value, {len(lead)} AS start, "
        f"CAST({len(lead)} + length({value}) AS INTEGER) AS {END} FROM events"
    )


def resolve_scored() -> str:
    value = planted.value_sql("email", "duck", "event_id")
    text = planted.text_sql("email", "duck", "event_id")
    base = (
        f"SELECT event_id, event_id % 6 AS c, {value} AS v, {text} AS t, length({text}) - 4 AS e FROM events"
    )
    scored = (
        "SELECT event_id, 'username' AS type, substr(t, a + 1, b - a) AS value, CAST(a AS INTEGER) AS start, "
        f"CAST(b AS INTEGER) AS {END} FROM (SELECT *, CASE c WHEN 3 THEN 5 ELSE 0 END AS a, "
        f"CASE c WHEN 1 THEN e - 1 WHEN 3 THEN e + 1 ELSE 4 END AS b FROM ({base}) WHERE c IN (1, 3, 5))"
    )
    # Cases 1 (longer, partial) and 3 (covering) keep the scored span; 5 (apart) keeps both.
    mail = f"SELECT event_id, 'email' AS type, v AS value, 8 AS start, CAST(8 + length(v) AS INTEGER) AS {END} FROM ({base}) WHERE c NOT IN (1, 3)"
    return f"{scored} UNION ALL {mail}"


DOC_FOUND = duck.found("documents", "doc_id", TYPES)
SOURCE_FOUND = f"SELECT f.*, d.source, d.lang FROM ({DOC_FOUND}) f JOIN documents d USING (doc_id)"
LOG_FOUND = planted.expected_sql(planted.SERVICE_LOG, "events", "event_id, user_id, CAST(user_id AS VARCHAR) AS user_scope")
LOG_TABLE = f"(SELECT event_id, user_id, {planted.line_sql(planted.SERVICE_LOG, 'duck')} AS text FROM events)"

DOC_MAPPING = duck.mapping(DOC_FOUND, "doc_id", GLOBAL)
SOURCE_MAPPING = duck.mapping(SOURCE_FOUND, "doc_id", "source")
LOG_MAPPING = duck.mapping(LOG_FOUND, "event_id", GLOBAL)
USER_MAPPING = duck.mapping(LOG_FOUND, "event_id", "user_scope")
MAPPING = "scope, value, placeholder, prefix, n, first_seq, CAST(first_pos AS INTEGER) AS first_pos"


def mapping_incremental() -> str:
    french = f"SELECT f.* FROM ({DOC_FOUND}) f JOIN documents d USING (doc_id) WHERE d.lang = 'fr'"
    first = duck.mapping(french, "doc_id", GLOBAL)
    more = duck.mapping(DOC_FOUND, "doc_id", GLOBAL, existing=first)
    return f"SELECT {MAPPING} FROM (({first}) UNION ALL ({more}))"


def doc_scope(findings: str, doc: str) -> str:
    """A mapping per document: the scope is the document."""
    return duck.mapping(findings, doc, f"CAST({doc} AS VARCHAR)")


def custom_findings() -> str:
    cands = duck.candidates("documents", "doc_id", list(q.TOKEN_TYPES)) + " UNION ALL " + duck.custom(
        "documents", "doc_id", q.TOKEN, 21, prefix="SECRET", split=r'^(token = ")([0-9a-f]{40})"$'
    )
    return duck.resolved(cands, "doc_id")


def export_json() -> str:
    rows = f"SELECT * FROM ({USER_MAPPING})"
    pair = "to_json(value) || ':' || to_json(placeholder)"
    back = "to_json(placeholder) || ':' || to_json(value)"
    order = "ORDER BY first_seq, first_pos DESC"
    counters = (
        "SELECT scope, string_agg(to_json(prefix) || ':' || top, ',' ORDER BY prefix) AS counters FROM "
        f"(SELECT scope, prefix, CAST(max(n) AS VARCHAR) AS top FROM ({rows}) GROUP BY scope, prefix) GROUP BY scope"
    )
    maps = (
        f"SELECT scope, string_agg({pair}, ',' {order}) AS forth, string_agg({back}, ',' {order}) AS back "
        f"FROM ({rows}) GROUP BY scope"
    )
    body = (
        "'{\"mappings\":{' || forth || '},\"reverse_mappings\":{' || back || '},\"counters\":{' || counters || '}}'"
    )
    return f"SELECT scope, CAST(0 AS BIGINT) AS shard, {body} AS json FROM ({maps}) JOIN ({counters}) USING (scope)"


def escaped(text: str) -> str:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = f"replace({text}, {duck.lit(plain)}, {duck.lit(entity)})"
    return f"replace(replace({text}, chr(10), '<br>'), ' ', '&nbsp;')"


def preview_html() -> str:
    color = "CASE type " + " ".join(f"WHEN '{k}' THEN '{catalog.COLORS[k]}'" for k in TYPES) + " END"
    label = "CASE type " + " ".join(f"WHEN '{k}' THEN '{catalog.LABELS[k]}'" for k in TYPES) + " END"
    mark = (
        f"'<span class=\"detection\" data-type=\"' || type || '\" style=\"background-color: ' || {color} || "
        f"'20; border-bottom: 2px solid ' || {color} || '; padding: 1px 2px; border-radius: 2px;\" title=\"' || {label} "
        f"|| '\">' || {escaped('value')} || '</span>'"
    )
    gap = (
        "substr(d.text, coalesce(lag(f.e) OVER (PARTITION BY f.doc_id ORDER BY f.s), 0) + 1, "
        "f.s - coalesce(lag(f.e) OVER (PARTITION BY f.doc_id ORDER BY f.s), 0))"
    )
    pieces = f"SELECT f.*, {gap} AS gap FROM ({DOC_FOUND}) f JOIN documents d USING (doc_id)"
    bodies = (
        f"SELECT doc_id, string_agg({escaped('gap')} || {mark}, '' ORDER BY s) AS body, max(e) AS tail "
        f"FROM ({pieces}) GROUP BY doc_id"
    )
    return (
        f"SELECT t.doc_id, coalesce(body || {escaped('substr(t.text, tail + 1)')}, {escaped('t.text')}) AS html "
        f"FROM documents t LEFT JOIN ({bodies}) b USING (doc_id)"
    )


def preset_aws() -> str:
    arn = "concat('arn:aws:s3:eu-west-1:', lpad(cast(event_id as varchar(20)), 12, '0'), ':bucket/b', cast(event_id as varchar(20)))"
    machine = "concat('i-', lpad(printf('%x', event_id), 8, '0'))"
    net = "concat('vpc-', printf('%x', event_id % 4096))"
    parts = []
    start = "5"
    for value, gap in ((arn, 6), (machine, 4), (net, 0)):
        parts.append(
            f"SELECT event_id, 'custom' AS type, {value} AS value, CAST({start} AS INTEGER) AS start, "
            f"CAST({start} + length({value}) AS INTEGER) AS {END} FROM events"
        )
        start = f"({start} + length({value}) + {gap})"
    return " UNION ALL ".join(parts)


def preset_compare() -> str:
    splits = {
        r"(?:PLAY|TASK)\s+\[([^\]]+)\]": r"^((?:PLAY|TASK)\s+\[)([^\]]+)\]$",
        r'"[A-Z]+ ([^"]+) HTTP/[0-9.]+"': r'^("[A-Z]+ )([^"]+) HTTP/[0-9.]+"$',
    }
    each = []
    for preset in catalog.PRESETS:
        kinds = [k for k in catalog.TYPE_NAMES if k in preset["patterns"]]
        cands = duck.candidates("documents", "doc_id", kinds, preserve=preset["preserve"])
        for i, custom in enumerate(preset["custom_patterns"]):
            # RE2 does not take a class with a range right after a dash.
            regex = custom["regex"].replace("[a-zA-Z0-9-_/]", "[a-zA-Z0-9_/-]")
            found = duck.custom("documents", "doc_id", regex, 21 + i, split=splits.get(regex))
            kept = " AND ".join(f"NOT contains(lower(value), {duck.lit(p.lower())})" for p in preset["preserve"]) or "true"
            cands += f" UNION ALL SELECT * FROM ({found}) WHERE {kept}"
        each.append(f"SELECT '{preset['id']}' AS preset, type FROM ({duck.resolved(cands, 'doc_id')})")
    return f"SELECT preset, type, count(*) AS n FROM ({' UNION ALL '.join(each)}) GROUP BY preset, type"


REPORTED = (
    "SELECT event_id % 1000 AS doc, event_id AS seq, CAST(event_id % 7 AS INTEGER) AS start, "
    f"CAST(event_id % 7 + 5 AS INTEGER) AS {END}, upper(event_type) AS entity, "
    "CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS confidence, 'outside' AS source FROM events"
)


def scored_dedup() -> str:
    key = f"doc, start, {END}"
    return (
        f"SELECT doc, first_seq AS seq, start, {END}, entity, confidence, source FROM (SELECT *, "
        f"min(seq) OVER (PARTITION BY {key}) AS first_seq, "
        f"row_number() OVER (PARTITION BY {key} ORDER BY confidence DESC, seq) AS pick FROM ({REPORTED})) WHERE pick = 1"
    )


def entity_map() -> str:
    pairs = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in catalog.ENTITY_TYPES.items())
    return f"SELECT event_id, CASE upper({q.ENTITY}) {pairs} ELSE 'custom' END AS type FROM events"


def recognise_french() -> str:
    phone = (
        "concat('06 12 34 ', lpad(cast(event_id % 100 as varchar(9)), 2, '0'), ' ', "
        "lpad(cast((event_id // 100) % 100 as varchar(9)), 2, '0'))"
    )
    ssn = "concat('1850578006', lpad(cast(event_id % 1000 as varchar(9)), 3, '0'), '48')"
    # Ten digits of the long number that start with 0[1-9] also read as a phone number.
    text = f"concat('tel ', {phone}, ' ssn ', {ssn})"
    logs = f"(SELECT event_id, {text} AS text FROM events)"
    phones = duck.matches(logs, "event_id", "(?i)" + catalog.FR_PHONE_PATTERN)
    return (
        f"SELECT event_id, start, CAST(start + length(value) AS INTEGER) AS {END}, value, 'PHONE_NUMBER' AS entity, "
        f"CAST(0.75 AS DOUBLE) AS confidence, 'fr' AS language FROM ({phones}) UNION ALL "
        f"SELECT event_id, 23, 38, {ssn}, 'FR_SSN', CAST(0.85 AS DOUBLE), 'fr' FROM events"
    )


HOSTS = f"SELECT page_id, {q.HOST} AS host FROM pages"
# The parts, spelled out for each kind of host that the query makes; the pages' own hosts
# end in a suffix of one label.
PARTS = (
    "SELECT page_id, host, CASE page_id % 8 WHEN 0 THEN 'www' WHEN 2 THEN 'a' WHEN 4 THEN split_part(host, '.', 1) "
    "WHEN 7 THEN regexp_replace(host, '[.]?[^.]+[.][^.]+$', '') ELSE '' END AS subdomain, "
    "CASE page_id % 8 WHEN 0 THEN split_part(host, '.', 2) WHEN 1 THEN split_part(host, '.', 1) WHEN 2 THEN split_part(host, '.', 2) "
    "WHEN 3 THEN 'www' WHEN 4 THEN 'internal' WHEN 5 THEN '' WHEN 6 THEN 'x' ELSE split_part(host, '.', -2) END AS domain, "
    "CASE page_id % 8 WHEN 0 THEN 'co.uk' WHEN 1 THEN 'github.io' WHEN 2 THEN 'foo.ck' WHEN 3 THEN 'ck' WHEN 4 THEN '' WHEN 5 THEN 'uk' "
    f"WHEN 6 THEN 'org' ELSE split_part(host, '.', -1) END AS suffix, page_id % 8 = 1 AS is_private FROM ({HOSTS})"
)
VALID = "(domain <> '' AND suffix <> '')"
COMMON = ", ".join(duck.lit(t) for t in catalog.COMMON_TLDS)
CONFIDENCE = (
    f"least(greatest(0.5 + CASE WHEN {VALID} THEN 0.3 ELSE 0 END + CASE WHEN subdomain <> '' THEN 0.1 ELSE 0 END "
    f"+ CASE WHEN split_part(suffix, '.', -1) IN ({COMMON}) THEN 0.1 ELSE 0 END "
    "- CASE WHEN length(domain) < 3 THEN 0.2 ELSE 0 END, 0.0), 1.0)"
)


def domain_find() -> str:
    """Dotted names of the pages under the rules that occur there."""
    plain = r"(?i)\b(?:" + duck._LABEL + r")+[a-zA-Z]{2,}\b"
    found = duck.matches("pages", "page_id", plain, "html")
    known = ", ".join(duck.lit(r) for r, _ in q.SUFFIXES if "*" not in r and "!" not in r and "." not in r)
    parts = (
        "SELECT page_id, start, value, split_part(lower(value), '.', -1) AS tld, "
        f"len(string_split(value, '.')) AS labels, split_part(value, '.', -2) AS domain FROM ({found})"
    )
    scored = (
        f"SELECT *, CASE WHEN labels > 2 THEN 'FQDN' ELSE 'DOMAIN' END AS entity, round(CAST(least(0.5 + 0.3 + "
        "CASE WHEN labels > 2 THEN 0.1 ELSE 0 END + CASE WHEN split_part(value, '.', -1) IN "
        f"({COMMON}) THEN 0.1 ELSE 0 END - CASE WHEN length(domain) < 3 THEN 0.2 ELSE 0 END, 1.0) AS DOUBLE), 6) AS confidence "
        f"FROM ({parts}) WHERE tld IN ({known}) AND labels > 1"
    )
    return (
        f"SELECT page_id, start, CAST(start + length(value) AS INTEGER) AS {END}, value, entity, confidence "
        f"FROM ({scored}) WHERE confidence >= 0.7"
    )


def merge_domains() -> str:
    scored = (
        f"SELECT page_id, 0 AS ord, start AS seq, start AS s, {END} AS e, 'hostname' AS type, 'HOST' AS prefix, value "
        f"FROM ({domain_find()})"
    )
    cands = f"{scored} UNION ALL {duck.candidates('pages', 'page_id', ['email', 'ipv4', 'hostname'], 'html')}"
    return f"SELECT page_id, {SPAN} FROM ({duck.resolved(cands, 'page_id')})"


RISK = (
    "risk_pii < 0.7 AS pii_safe, risk_pii AS pii_risk, risk_secret < 0.7 AS secrets_safe, risk_secret AS secrets_risk, "
    "risk_pii < 0.7 AND risk_secret < 0.7 AS is_safe, CAST(greatest(risk_pii, risk_secret) AS DOUBLE) AS risk_score"
)


def risk_by_conversation() -> str:
    secret = ", ".join(f"'{t}'" for t in catalog.SECRET_TYPES)
    found = duck.found(
        "(SELECT *, conv_id * 100000 + turn AS id FROM conversations)", "id", list(catalog.TYPE_NAMES)
    )
    rows = (
        f"SELECT id // 100000 AS conv_id, CASE WHEN type IN ({secret}) THEN 0.0 ELSE 1.0 END AS p, "
        f"CASE WHEN type IN ({secret}) THEN 1.0 ELSE 0.0 END AS s FROM ({found}) "
        "UNION ALL SELECT conv_id, 0.0, 0.0 FROM conversations"
    )
    return (
        f"SELECT conv_id, {RISK} FROM (SELECT conv_id, CAST(max(p) AS DOUBLE) AS risk_pii, "
        f"CAST(max(s) AS DOUBLE) AS risk_secret FROM ({rows}) GROUP BY conv_id)"
    )


def store_reset() -> str:
    """User 1 starts over with the second batch; the others go on."""
    early_rows = f"SELECT * FROM ({LOG_FOUND}) WHERE event_id % 2 = 0"
    early = f"SELECT * FROM ({duck.mapping(early_rows, 'event_id', 'user_scope')}) WHERE scope <> '1'"
    late = duck.mapping(LOG_FOUND, "event_id", "user_scope", existing=early)
    return f"SELECT scope, value, placeholder FROM (({early}) UNION ALL ({late}))"


def redacted_logs(mapping: str, scope: str) -> str:
    return duck.redacted(LOG_TABLE, "event_id", LOG_FOUND, mapping, scope)


def recogniser_plugged_in() -> str:
    """The words before the address, and the address: they touch no more than in a space."""
    return (
        f"SELECT event_id, 'username' AS type, 'mail to' AS value, 0 AS start, 7 AS {END} FROM events UNION ALL {find_planted('email')}"
    )


def preserved_table() -> str:
    """Without what holds a preserved string; the host of a preserved address is a finding then."""
    strings = (
        "SELECT lower(concat('U', c_custkey, '@')) AS p FROM customer WHERE c_custkey % 2 = 0 UNION "
        "SELECT lower(concat('/APP', o_orderkey, '/')) FROM orders WHERE o_orderkey % 3 = 0"
    )
    held = f"SELECT value FROM (SELECT DISTINCT value FROM ({LOG_FOUND})) v WHERE EXISTS (SELECT 1 FROM ({strings}) k WHERE contains(lower(v.value), k.p))"
    name = "length(split_part(value, '@', 1)) + 1"
    return (
        f"SELECT event_id, {SPAN} FROM ({LOG_FOUND}) WHERE value NOT IN ({held}) UNION ALL "
        f"SELECT event_id, 'hostname' AS type, split_part(value, '@', 2) AS value, CAST(s + {name} AS INTEGER) AS start, CAST(e AS INTEGER) AS {END} "
        f"FROM ({LOG_FOUND}) WHERE type = 'email' AND value IN ({held})"
    )


def store_two_writers() -> str:
    """The odd events were committed first, whoever began."""
    half = f"SELECT * FROM ({LOG_FOUND}) WHERE event_id % 2 = "
    odd = duck.mapping(half + "1", "event_id", "user_scope")
    even = duck.mapping(half + "0", "event_id", "user_scope", existing=odd)
    return f"SELECT {MAPPING} FROM (({odd}) UNION ALL ({even}))"


def stream_bounded() -> str:
    """A scope starts over if as many others of its slot as the slot keeps came between two of its events."""
    slot = f"CAST(concat('0x', substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS UBIGINT) % {q.SLOTS}"
    touched = f"SELECT event_id, user_id, {slot} AS slot, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events"
    between = (
        f"WITH t AS ({touched}) SELECT t.event_id, any_value(t.user_id) AS user_id, any_value(t.before) IS NULL OR count(DISTINCT o.user_id) >= {q.MAX_SCOPES // q.SLOTS} AS anew "
        "FROM t LEFT JOIN t o ON o.slot = t.slot AND o.event_id > t.before AND o.event_id < t.event_id GROUP BY t.event_id"
    )
    eras = f"SELECT event_id, concat(user_id, '#', count(*) FILTER (anew) OVER (PARTITION BY user_id ORDER BY event_id)) AS era FROM ({between})"
    found = f"SELECT f.*, era FROM ({LOG_FOUND}) f JOIN ({eras}) USING (event_id)"
    return duck.redacted(LOG_TABLE, "event_id", found, duck.mapping(found, "event_id", "era"), "f.era")


FILES = f"SELECT user_id, sum(strlen(text) + 1) AS size FROM {LOG_TABLE} GROUP BY user_id"


def uploads_capped() -> str:
    return (
        f"SELECT user_id, count(*) AS n, true AS accepted FROM ({LOG_FOUND}) JOIN ({FILES}) USING (user_id) WHERE size <= {q.CAP} GROUP BY user_id "
        f"UNION ALL SELECT user_id, CAST(size AS BIGINT), false FROM ({FILES}) WHERE size > {q.CAP}"
    )


def file_in_pieces() -> str:
    """Places in the lines plus all lines before, each with its line feed."""
    lines = f"SELECT event_id, coalesce(sum(length(text) + 1) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM {LOG_TABLE}"
    return f"SELECT type, value, CAST(base + s AS BIGINT) AS start, CAST(base + e AS BIGINT) AS {END} FROM ({LOG_FOUND}) JOIN ({lines}) USING (event_id)"


def oracle_sql() -> dict[str, str]:
    doc_text = "SELECT doc_id, text AS restored FROM documents"
    log_text = f"SELECT event_id, text AS restored FROM {LOG_TABLE}"
    redacted_doc_scope = duck.redacted("documents", "doc_id", DOC_FOUND, doc_scope(DOC_FOUND, "doc_id"), "CAST(f.doc_id AS VARCHAR)")
    custom = custom_findings()
    return {
        **{f"find_{kind}": find_planted(kind) for kind in planted.TEMPLATES},
        "find_all_documents": find_in("documents", "doc_id", "text"),
        "find_all_pages": find_in("pages", "page_id", "html"),
        "find_email_documents": find_in("documents", "doc_id", "text", ["email"]),
        "find_ipv4_documents": find_in("documents", "doc_id", "text", ["ipv4"]),
        "find_phone_documents": find_in("documents", "doc_id", "text", ["phone"]),
        "find_card_luhn": find_in("documents", "doc_id", "text", ["credit_card"]),
        "find_url_pages": find_in("pages", "page_id", "url", ["url"]),
        "find_hostname_pages": find_in("pages", "page_id", "html", ["hostname"]),
        "type_filter": find_in("pages", "page_id", "html", ["email", "credit_card"]),
        "preserve_filter": find_in("documents", "doc_id", "text", TYPES, q.PRESERVE),
        "luhn_orders": "SELECT o_orderkey, "
        + duck.luhn("number")
        + " AS is_card FROM (SELECT o_orderkey, concat('4', lpad(cast(o_orderkey as varchar), 15, '0')) AS number FROM orders)",
        "phone_customers": "SELECT c_custkey, 1 + length(lpad(cast(c_custkey as varchar), CAST(6 + c_custkey % 4 AS INTEGER), '0')) >= 8 "
        "AS is_phone FROM customer",
        "resolve_equal_span": planted_case("username", "user=", "concat('a', event_id, '.example.com')"),
        "resolve_later_type": planted_case("iban", "api_key=", "concat('Zq', lpad(cast(event_id as varchar), 16, '0'))"),
        "resolve_contained": planted_case("email", "to ", "concat('jd', event_id, '@acme-corp.com')"),
        "preserve_then_inner": planted_case("hostname", "see https://", "concat('h', event_id, '.example.com')"),
        "resolve_scored": resolve_scored(),
        "mapping_global": f"SELECT {MAPPING} FROM ({DOC_MAPPING})",
        "mapping_by_source": f"SELECT {MAPPING} FROM ({SOURCE_MAPPING})",
        "mapping_incremental": mapping_incremental(),
        "mapping_logs_global": f"SELECT {MAPPING} FROM ({LOG_MAPPING})",
        "mapping_logs_by_user": f"SELECT {MAPPING} FROM ({USER_MAPPING})",
        "mapping_counters": f"SELECT scope, prefix, count(*) AS n_values FROM ({USER_MAPPING}) GROUP BY scope, prefix",
        "mapping_pairs": f"SELECT placeholder, value FROM ({DOC_MAPPING})",
        "forget_scope": f"SELECT {MAPPING} FROM ({SOURCE_MAPPING}) WHERE scope NOT IN ('src0', 'src1')",
        "redact_doc_scope": redacted_doc_scope,
        "redact_global": duck.redacted("documents", "doc_id", DOC_FOUND, DOC_MAPPING, GLOBAL),
        "redact_by_source": duck.redacted("documents", "doc_id", SOURCE_FOUND, SOURCE_MAPPING, "f.source"),
        "redact_logs_by_user": redacted_logs(USER_MAPPING, "f.user_scope"),
        "redact_logs_doc_scope": redacted_logs(doc_scope(LOG_FOUND, "event_id"), "CAST(f.event_id AS VARCHAR)"),
        "restore_global": doc_text,
        "restore_logs_by_user": log_text,
        "restore_unknown_kept": "SELECT event_id, concat('check ', i.value, ' and [IP_999] or [', p.value, ']') AS restored FROM events "
        f"JOIN ({LOG_MAPPING}) i ON i.placeholder = printf('[IP_%03d]', 1 + event_id % 150) "
        f"JOIN ({LOG_MAPPING}) p ON p.placeholder = '[PATH_001]'",
        "stats_by_type": f"SELECT type, count(*) AS n FROM ({DOC_FOUND}) GROUP BY type",
        "stats_by_source_lang": f"SELECT source, lang, type, count(*) AS n FROM ({SOURCE_FOUND}) GROUP BY source, lang, type",
        "total_replacements": f"SELECT doc_id, count(*) AS total_replacements FROM ({DOC_FOUND}) GROUP BY doc_id",
        "export_text": f"SELECT placeholder, placeholder || ' -> ' || value AS line FROM ({DOC_MAPPING})",
        "export_json": export_json(),
        "preview_html": preview_html(),
        "custom_token": f"SELECT doc_id, {SPAN} FROM ({custom})",
        "custom_token_declared": duck.redacted("documents", "doc_id", custom, doc_scope(custom, "doc_id"), "CAST(f.doc_id AS VARCHAR)"),
        "custom_plain": f"SELECT doc_id, {SPAN} FROM ({duck.custom('documents', 'doc_id', '[0-9a-f]{40}', 21)})",
        "preset_aws": preset_aws(),
        "preset_compare": preset_compare(),
        "scored_dedup": scored_dedup(),
        "scored_threshold": f"SELECT * FROM ({REPORTED}) WHERE confidence >= 0.7",
        "entity_map": entity_map(),
        "recognise_french": recognise_french(),
        "domain_split": f"SELECT page_id, host, subdomain, domain, suffix, CASE WHEN {VALID} THEN host ELSE '' END AS fqdn, "
        f"{VALID} AS is_valid, is_private FROM ({PARTS})",
        "domain_confidence": f"SELECT page_id, round(CAST({CONFIDENCE} AS DOUBLE), 6) AS confidence, CASE WHEN subdomain <> '' THEN 'FQDN' "
        f"WHEN {VALID} THEN 'DOMAIN' ELSE 'TLD' END AS entity FROM ({PARTS})",
        "domain_find": domain_find(),
        "merge_domains": merge_domains(),
        "risk_by_user": "SELECT user_id, " + RISK + " FROM (SELECT user_id, CAST(user_id % 3 = 1 AS DOUBLE) AS risk_pii, "
        "CAST(user_id % 3 = 0 AS DOUBLE) AS risk_secret FROM events GROUP BY user_id)",
        "risk_by_conversation": risk_by_conversation(),
        "store_reset": store_reset(),
        "forget_twice": f"SELECT {MAPPING} FROM ({SOURCE_MAPPING}) WHERE scope NOT IN ('src0', 'src1')",
        "export_entries": f"SELECT {MAPPING} FROM ({SOURCE_MAPPING})",
        "import_scopes": f"SELECT scope, value, placeholder, prefix, n FROM ({SOURCE_MAPPING})",
        "session_mapping": f"SELECT {MAPPING} FROM ({SOURCE_MAPPING})",
        "redacted_written": redacted_doc_scope,
        "sql_redact": redacted_doc_scope,
        "sql_findings": find_in("documents", "doc_id", "text", TYPES),
        "stream_document": redacted_logs(doc_scope(LOG_FOUND, "event_id"), "CAST(f.event_id AS VARCHAR)"),
        "stream_global": redacted_logs(LOG_MAPPING, GLOBAL),
        "stream_keyed": redacted_logs(USER_MAPPING, "f.user_scope"),
        "stream_restore": log_text,
        "stream_restore_growing": log_text,
        "stream_bounded": stream_bounded(),
        "stream_counts": f"SELECT user_id, type, count(*) AS n FROM ({LOG_FOUND}) GROUP BY user_id, type",
        "resolve_scored_odd": find_planted("email"),
        "recogniser_plugged_in": recogniser_plugged_in(),
        "preserved_table": preserved_table(),
        "sql_table_function": find_in("documents", "doc_id", "text", TYPES),
        "session_saved_twice": f"SELECT {MAPPING} FROM ({SOURCE_MAPPING})",
        "store_two_writers": store_two_writers(),
        "files_read_whole": f"SELECT user_id, type, value, count(*) AS n FROM ({LOG_FOUND}) GROUP BY user_id, type, value",
        "files_read_by_line": f"SELECT user_id, type, value, count(*) AS n, count(DISTINCT event_id) AS n_lines FROM ({LOG_FOUND}) GROUP BY user_id, type, value",
        "uploads_capped": uploads_capped(),
        "file_in_pieces": file_in_pieces(),
        "presets_loaded": preset_compare(),
    }
