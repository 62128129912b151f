"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from inkveil.functions.lineage import scratch_folder
from inkveil.llm import chat, codes, cotraining, language, lines, mixing, personal, postings, prefixes, rules, simhash, statements, token_files, wrappers


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return cotraining.scored(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return postings.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")).drop("n_near")


def op3_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.cleaned(_table(spark, sf, "documents")).select("doc_id", "n_removed", "text")


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf, "documents"))


def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{scratch_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    token_files.write(_table(spark, sf, "documents"), path)
    return token_files.read(spark, path).drop("part", "place")


def op6_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(_table(spark, sf, "documents"))


def op7_pages(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.main_texts(_table(spark, sf, "pages"))


def op8_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rules.judged(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.positions(_table(spark, sf, "documents"))


def op10_personal(spark: SparkSession, sf: str) -> DataFrame:
    return personal.find(_table(spark, sf, "documents"))


def op11_codes(spark: SparkSession, sf: str) -> DataFrame:
    return codes.codes(_table(spark, sf, "embeddings"))


def op12_chat(spark: SparkSession, sf: str) -> DataFrame:
    return chat.read_back(chat.formatted(chat.control_case(_table(spark, sf, "conversations")))).withColumnRenamed("id", "conv_id")


def op13_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return prefixes.trie(_table(spark, sf, "conversations"))


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per session: they need not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_inkveil_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(), "inkveil.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(top, "inkveil")):
            for name in names:
                if name.endswith(".py"):
                    archive.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
    context.addPyFile(path)
    context._inkveil_shipped = True


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return query(spark, sf)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_quality, op2_decontamination, op3_lines, op4_simhash, op5_token_files,
        op6_language, op7_pages, op8_rules, op9_mixing, op10_personal,
        op11_codes, op12_chat, op13_prefixes,
    )
    return {f.__name__: _shipped(f) for f in operators} | {"pipeline": _shipped(corpus_pipeline.run)}


#: A window is looked for by the text of its words, with single spaces; documents are cut into the
#: windows of every length that items have.
_OP2 = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
owned AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS win
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 12, 1))) AS i FROM item WHERE len(w) > 0)),
cut AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM folded, (SELECT DISTINCT n FROM owned) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, cut.n, item FROM cut JOIN owned ON cut.win = owned.win AND cut.n = owned.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM folded LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _strict() -> str:
    """How many steps reject a document, as SQL."""
    each = (f"len([c for c in {rules.path(rule)} if ({measure}) > c])" for rule, (measure, _) in rules.RULES.items())
    return f"CASE WHEN base_failed THEN NULL ELSE greatest({', '.join(each)}) END"


#: Equal windows are counted by their text; the binomial tail is summed by logarithms of factorials.
_OP8 = rf"""
WITH t AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS content FROM documents),
w AS (
  SELECT *, regexp_extract_all(content, '[^\x20\x09-\x0D]+') AS w,
    [y for y in string_split(content, chr(10)) if regexp_matches(y, '[^\x20\x09-\x0D]')] AS l FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 3], ' ') AS win FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM w WHERE len(w) >= 3)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
counted AS (
  SELECT w.doc_id, stratum, content, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(content, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(content, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
judged AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
placed AS (SELECT *, @STRICT@ AS strict FROM judged),
evidence AS (
  SELECT stratum, content, any_value(strict) AS strict FROM placed WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY stratum, content),
sizes AS (SELECT stratum, count(*) AS own FROM evidence GROUP BY stratum),
level AS (SELECT {rules.DELTA}::DOUBLE / greatest(1, count(*)) AS level FROM sizes),
tried AS (SELECT stratum, own < ceil(ln(level) / ln({1 - rules.ALPHA!r}::DOUBLE)) AS joint FROM sizes, level),
pooled AS (
  SELECT joint, CASE WHEN joint THEN NULL ELSE tried.stratum END AS g, strict FROM evidence JOIN tried ON evidence.stratum IS NOT DISTINCT FROM tried.stratum),
tested AS (SELECT joint, g, j, count(*) AS n, count(*) FILTER (strict >= {rules.STEPS} - j) AS k FROM pooled, range({rules.STEPS}) AS _(j) GROUP BY joint, g, j),
safe AS (
  SELECT *, k < n * {rules.ALPHA!r}::DOUBLE AND level >= list_sum([
    exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({rules.ALPHA!r}::DOUBLE) + (n - x) * ln({1 - rules.ALPHA!r}::DOUBLE))
    for x in range(0, k + 1)]) AS safe
  FROM tested, level),
chosen AS (
  SELECT joint, g, max(j) AS step FROM (
    SELECT *, min(CASE WHEN safe THEN NULL ELSE j END) OVER (PARTITION BY joint, g) AS stop FROM safe) WHERE stop IS NULL OR j < stop GROUP BY joint, g),
steps AS (SELECT stratum, step FROM tried JOIN chosen ON tried.joint = chosen.joint AND (tried.joint OR tried.stratum IS NOT DISTINCT FROM chosen.g))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(strict < {rules.STEPS} - step, true) AS kept
FROM placed LEFT JOIN steps ON placed.stratum IS NOT DISTINCT FROM steps.stratum
"""


def _op8() -> str:
    return _OP8.replace("@STRICT@", _strict())


#: Chunks and levels of sums are only for Spark: here one running sum per source gives the places, and
#: a recursive query deals the slots one by one.
_OP9 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS k FROM documents),
placed AS (
  SELECT doc_id, source, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, CAST(doc_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
weighted AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS i,
    greatest(1, CAST(floor({mixing.PERIOD} * sqrt(size) / greatest((SELECT sum(sqrt(size)) FROM sized), 1) + 0.5) AS BIGINT)) AS w FROM sized),
constants AS (SELECT list(w ORDER BY i) AS ws, CAST(sum(w) AS BIGINT) AS total FROM weighted),
dealt AS (
  SELECT CAST(-1 AS BIGINT) AS t, [CAST(0 AS BIGINT) for x in ws] AS done, CAST(0 AS BIGINT) AS pick FROM constants
  UNION ALL
  SELECT t + 1, [done[i] + CASE WHEN i = p THEN 1 ELSE 0 END for i in range(1, len(done) + 1)], p FROM (
    SELECT t, done, list_min([{{'due': ((done[i] + 1) * total + ws[i] - 1) // ws[i], 'i': i}}
      for i in range(1, len(ws) + 1) if (done[i] * total) // ws[i] <= t + 1]).i AS p, total FROM dealt, constants) WHERE t + 1 < total),
slots AS (SELECT pick, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM dealt WHERE t >= 0)
SELECT doc_id, placed.source, before, before // {mixing.BLOCK} AS block, (before // {mixing.BLOCK} // w) * total + slot AS slot
FROM placed JOIN weighted ON placed.source IS NOT DISTINCT FROM weighted.source CROSS JOIN constants
JOIN slots ON pick = i AND turn = before // {mixing.BLOCK} % w
"""


#: Sites are counted exactly; with so few sites the sketches are exact as well.
_OP3 = rf"""
WITH cut AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
line AS (
  SELECT doc_id, source, i, l, trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g')) AS h
  FROM (SELECT doc_id, source, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM cut)),
wide AS (SELECT h FROM line WHERE length(h) >= {lines.MIN_CHARS} GROUP BY h HAVING count(DISTINCT source) >= {lines.SITES}),
kept AS (
  SELECT doc_id, count(*) FILTER (wide.h IS NOT NULL) AS n_removed, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (wide.h IS NULL), '') AS text
  FROM line LEFT JOIN wide USING (h) GROUP BY doc_id)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, kept.text AS text FROM cut LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {"op2_decontamination": _OP2, "op3_lines": _OP3, "op8_rules": _op8(), "op9_mixing": _OP9} | {
        "op11_codes": statements.vector_codes(),
        "op12_chat": statements.chat_formats(),
        "op13_prefixes": statements.prefix_trie(),
    }
