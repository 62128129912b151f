"""DuckDB statements of vector codes, chat formatting and the prefix trie."""

from __future__ import annotations

from inkveil.llm import chat, codes, prefixes


def _nearest(book: str) -> str:
    gap = "list_sum([(x[j] - c[j]) * (x[j] - c[j]) for j in range(1, len(x) + 1)])"
    return f"SELECT r, p, min({{'gap': {gap}, 'k': k}}) AS best FROM parts JOIN {book} USING (p) GROUP BY r, p"


def _moved(book: str, assigned: str) -> str:
    """Components are summed one by one; ``//`` cuts towards zero, so negative sums are shifted first."""
    return f"""
  SELECT p, k, coalesce(mean, c) AS c FROM {book} LEFT JOIN (
    SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS mean FROM (
      SELECT p, k, j, sum(v) AS s, count(*) AS n FROM (
        SELECT p, best.k AS k, unnest(range(1, len(x) + 1)) AS j, unnest(x) AS v FROM {assigned} JOIN parts USING (r, p)) GROUP BY p, k, j)
    GROUP BY p, k) USING (p, k)"""


def vector_codes() -> str:
    rounds = "".join(f", a{i} AS ({_nearest(f'b{i}')}), b{i + 1} AS ({_moved(f'b{i}', f'a{i}')})" for i in range(codes.ROUNDS))
    last = codes.ROUNDS
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, * FROM (
    SELECT vec_id, label, [CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0)),
parts AS MATERIALIZED (
  SELECT r, p, v[p * len(v) // {codes.PARTS} + 1 : (p + 1) * len(v) // {codes.PARTS}] AS x FROM (SELECT r, v, unnest(range({codes.PARTS})) AS p FROM kept)),
b0 AS (SELECT p, r - 1 AS k, x AS c FROM parts WHERE r <= {codes.ENTRIES})
{rounds},
a{last} AS ({_nearest(f"b{last}")}),
coded AS (SELECT r, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, CAST(sum(best.gap) AS BIGINT) AS error FROM a{last} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r) CROSS JOIN digest
"""


def chat_formats() -> str:
    """Lengths are counted by what escaping adds; ``valid`` looks at neighbours only, which the default machine allows."""
    t = chat.Template()
    moves = ", ".join(f"('{state}', '{role}')" for state, role in sorted(t.moves))

    def added(column: str) -> str:
        runs = f"list_sum([len(y) - 2 for y in array_append(regexp_extract_all({column}, '#{{3,}}'), '##')])"
        return f"len({column}) - len(replace({column}, chr(92), '')) + {runs} + len(regexp_extract_all({column}, '</turn>'))"

    marks = len(t.opening + t.middle + t.closing)
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, concat(chr(92), '### Assistant: </turn> ok') FROM range(2) AS _(i))),
placed AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    {marks} + len(text) + {added("text")} + len(role) + {added("role")} + len(regexp_extract_all(role, ': ')) AS size
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars,
  bool_and((coalesce(before, 'start'), role) IN ({moves}) AND (i < n OR role = 'assistant')) AS valid
FROM placed GROUP BY conv_id
"""


#: The polynomial of the usual CRC-32, bit by bit: a fixed value.
_CRC = """CAST(xor(list_reduce([CAST(ord(y) AS BIGINT) for y in string_split(CAST(conv AS VARCHAR), '')],
    lambda a, b: list_reduce(range(8), lambda v, i: xor(v >> 1, (v & 1) * 3988292384), xor(a, b)), 4294967295), 4294967295) AS BIGINT)"""


def prefix_trie() -> str:
    """Prefixes are compared by their digests of role, length and text, joined; paths of smallest members make subtrees."""
    return f"""
WITH said AS (
  SELECT CAST(conv_id AS BIGINT) AS conv, turn, len(coalesce(text, '')) AS chars, sha256(concat(len(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS said
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, said) AS pos FROM said),
ids AS (SELECT conv, conv - conv % {prefixes.FAMILY} AS head, {_CRC} % {prefixes.HEADS} AS h FROM (SELECT DISTINCT conv FROM said)),
rows_ AS (
  SELECT conv, 0 AS src, own.pos, own.said, own.chars FROM ids JOIN (SELECT conv AS head, pos, said, chars FROM own) own USING (head) WHERE own.pos <= h
  UNION ALL SELECT conv, 1, pos, said, chars FROM own JOIN ids USING (conv) WHERE pos > h),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY src, pos) AS depth FROM rows_),
path AS (
  SELECT conv, depth, chars, string_agg(said, '/') OVER w AS key, coalesce(string_agg(said, '/') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS parent
  FROM placed WINDOW w AS (PARTITION BY conv ORDER BY depth)
  UNION ALL SELECT conv, 0, 0, '', NULL FROM ids),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv) AS last FROM path),
node AS (
  SELECT key, min(conv) AS m, any_value(depth) AS depth, any_value(parent) AS parent, count(*) AS n, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (last), '')) AS ends FROM ended GROUP BY key),
kids AS (SELECT parent AS key, count(*) AS kids FROM node WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT path.key, sum(node.saved) AS saved, count(*) FILTER (kids IS NULL) AS leaves
  FROM node LEFT JOIN kids USING (key) JOIN path ON path.conv = node.m AND path.depth <= node.depth GROUP BY path.key)
SELECT node.m AS conv_id, CAST(node.depth AS BIGINT) AS depth, up.m AS parent_conv_id, node.n AS n_convs, coalesce(kids, 0) AS n_children,
  below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN below USING (key) LEFT JOIN kids USING (key) LEFT JOIN node up ON up.key = node.parent
"""
