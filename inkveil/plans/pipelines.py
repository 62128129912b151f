"""The jobs users call: find, redact, restore, preview, compare presets."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from inkveil import catalog
from inkveil.config import Config
from inkveil.functions.arrays import let, quote
from inkveil.functions.lineage import written
from inkveil.functions.validators import preserved_sql
from inkveil.operators import audit
from inkveil.operators.candidates import with_candidates
from inkveil.operators.mapping import assign, keyed_values
from inkveil.operators.numbering import with_document_numbers
from inkveil.operators.preserved import without_preserved
from inkveil.operators.resolve import spans_sql, with_spans
from inkveil.operators.rewrite import apply_edits, edits_by_lookup
from inkveil.sources.versions import VersionedStore


@dataclass(frozen=True)
class Redaction:
    """Results of one redaction: texts, all mapping entries, and the entries new in this run.

    Texts are planned when they are first asked for, as finding the right join counts the rows of each value.
    """

    mapping: DataFrame
    added: DataFrame
    rewriting: Callable[[], DataFrame] = field(repr=False)

    @cached_property
    def redacted(self) -> DataFrame:
        return self.rewriting()


def spanned(
    df: DataFrame, config: Config, text: str = "text", scored: str | None = None, engine: str = "jvm"
) -> DataFrame:
    """Documents with a ``spans`` array: their findings, disjoint and in order."""
    return with_spans(with_candidates(df, config, text, scored=scored, engine=engine))


def spanned_without(
    df: DataFrame, config: Config, keep: Iterable[str], preserved: DataFrame, text: str = "text", scored: str | None = None, engine: str = "jvm"
) -> DataFrame:
    """The columns ``keep`` and ``spans``, without values that hold a string of the one column of ``preserved``."""
    found = with_candidates(df, config, text, scored=scored, engine=engine).select(*keep, "candidates")
    return with_spans(without_preserved(found, preserved, preserved.columns[0]))


def find(
    df: DataFrame,
    config: Config,
    keys: Iterable[str],
    text: str = "text",
    scored: str | None = None,
    engine: str = "jvm",
    preserved: DataFrame | None = None,
) -> DataFrame:
    """One row per finding. Only the keys and the text are read.

    ``preserved``: a table of preserved strings (its first column), beside those of ``config``.
    """
    keys = list(keys)
    extra = [scored] if scored else []
    slim = df.select(*dict.fromkeys([*keys, text, *extra]))
    if preserved is None:
        return audit.findings(spanned(slim, config, text, scored, engine), *keys)
    return audit.findings(spanned_without(slim, config, dict.fromkeys(keys), preserved, text, scored, engine), *keys)


def redact_documents(
    df: DataFrame, config: Config, text: str = "text", out: str = "redacted", scored: str | None = None, engine: str = "jvm"
) -> DataFrame:
    """Redact each row on its own: adds ``out`` and a ``mapping`` array. No shuffle."""
    numbered = with_document_numbers(spanned(df, config, text, scored, engine))
    return apply_edits(numbered.drop("spans"), text, out)


def redact(
    df: DataFrame,
    config: Config,
    *,
    doc: str,
    scope: str = "global",
    seq: str | None = None,
    existing: DataFrame | None = None,
    text: str = "text",
    out: str = "redacted",
    scored: str | None = None,
    engine: str = "jvm",
    preserved: DataFrame | None = None,
) -> Redaction:
    """Redact with placeholders shared over a scope: ``'global'`` or the values of a column.

    ``doc`` must be unique; ``seq`` (default ``doc``) orders documents for numbering and
    must be unique within a scope. ``existing`` is an earlier mapping of the same scopes to
    go on from. Texts are searched once; they meet their edits in one join on ``doc``. ``preserved``: a table of
    preserved strings, as in ``find``.
    """
    keyed = _keyed(df, config, doc, scope, seq or doc, text, scored, engine, preserved)
    return _replaced(df, keyed, existing, written(assign(keyed, existing)), doc, text, out)


def redact_into(
    df: DataFrame,
    config: Config,
    store: VersionedStore,
    *,
    doc: str,
    scope: str = "global",
    seq: str | None = None,
    text: str = "text",
    out: str = "redacted",
    writer: str = "",
    batch: int = -1,
) -> Redaction:
    """``redact`` on top of a store that others may write to at the same time; new entries are committed.

    Texts are searched once, however often numbering has to start over. Only stored entries that may concern
    the scopes of ``df`` are read, so ``mapping`` holds those. A ``batch`` that ``writer`` has committed before gives
    the same placeholders again.
    """
    keyed = _keyed(df, config, doc, scope, seq or doc, text, None, "jvm", None)
    before, added = store.add(lambda known, tops: assign(keyed, known, tops), keyed.select("scope").distinct(), writer, batch)
    return _replaced(df, keyed, before, added, doc, text, out)


def _keyed(
    df: DataFrame, config: Config, doc: str, scope: str, seq: str, text: str, scored: str | None, engine: str, preserved: DataFrame | None
) -> DataFrame:
    keys = dict.fromkeys([doc, seq, *([] if scope == "global" else [scope])])
    slim = df.select(*dict.fromkeys([*keys, text, *([scored] if scored else [])]))
    if preserved is None:
        return keyed_values(spanned(slim, config, text, scored, engine), doc, scope, seq)
    return keyed_values(spanned_without(slim, config, keys, preserved, text, scored, engine), doc, scope, seq)


def _replaced(df: DataFrame, keyed: DataFrame, existing: DataFrame | None, added: DataFrame, doc: str, text: str, out: str) -> Redaction:
    mapping = added if existing is None else existing.select(added.columns).unionByName(added)

    def rewriting() -> DataFrame:
        edits = edits_by_lookup(keyed, mapping, ["scope", "value"], "placeholder", "doc", of="of")
        joined = df.join(edits.withColumnRenamed("doc", doc), doc, "left")
        return apply_edits(joined, text, out)

    return Redaction(mapping, added, rewriting)


def redacting(config: Config, **options) -> Callable[[DataFrame], DataFrame]:
    """For ``df.transform``: document-scope redaction with a fixed configuration."""
    return lambda df: redact_documents(df, config, **options)


def preview(df: DataFrame, config: Config, text: str = "text", out: str = "html") -> DataFrame:
    return audit.preview(spanned(df, config, text), text, out=out)


def compare_presets(
    df: DataFrame, presets: Iterable[Mapping], keys: Iterable[str], text: str = "text"
) -> DataFrame:
    """Findings that each preset would give on one corpus, with a ``preset`` column.

    Texts are searched once for everything any preset asks for; each preset then filters
    the candidates and resolves overlaps among its own.
    """
    keys = list(keys)
    configs = {preset["id"]: Config().load_preset(preset) for preset in presets}
    union = Config().only_types(name for config in configs.values() for name in config.types)
    ords: dict[str, list[int]] = {}
    for id_, config in configs.items():
        first = len(catalog.TYPES) + 1 + len(union.custom)
        ords[id_] = [catalog.RANK[name] for name in config.types] + list(range(first, first + len(config.custom)))
        union = replace(union, custom=union.custom + config.custom)
    found = with_candidates(df.select(*dict.fromkeys([*keys, text])), union, text)
    each = []
    for id_, config in configs.items():
        own = (
            f"filter(candidates, x -> array_contains(array({', '.join(map(str, ords[id_]))}), x.ord) "
            f"and not {preserved_sql('x.value', config.preserve)})"
        )
        each.append(f"named_struct('preset', {quote(id_)}, 'spans', {let('own', own, spans_sql('own'))})")
    rows = found.select(*keys, F.expr(f"explode(array({', '.join(each)}))").alias("p"))
    return rows.select(*keys, "p.preset", F.expr("explode(transform(p.spans, x -> x))").alias("f")).select(
        *keys, "preset", "f.type", "f.value", "f.start", "f.end"
    )
