"""Personal data by candidates and gradient boosting, in DataFrame operations (and Spark ML) only.

Strict patterns with checks (``BASE``) give the spans that always stay. Generators (``LOOSE``) propose
many more spans, overlapping ones too: spelled-out addresses, numbers with other separators or side by
side, checks not passed. Boosted trees learn from format and context (lengths, digits, groups, checks,
neighbours, cue words) what separates strict spans from the other proposals.
Proposals are unlabelled, not wrong: so the trees' score is divided by its mean over all strict
spans of the kind that the trees have not learned from, which makes it the chance that a proposal is such a
span, and proposals of ``CHANCE`` or more are added.

The trees are fitted on a bounded sample of at most about ``SAMPLE`` spans, chosen by hash alike from each kind and
label, weighted by what they stand for; all texts are searched whole, and all strict spans and proposals are scored.

Defined results: null and empty texts have no spans. Without strict spans or without proposals to
learn from, nothing is added. Rows are documents; repeated or null ids stay. Offsets count code
points. Other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkveil.functions.arrays import chunks, let, quote, slice_chunks
from inkveil.functions.lineage import written
from inkveil.functions.matching import hits, located

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 20_000
CHANCE = 0.9
CONTEXT = 16

#: Strict patterns. Loops are possessive and starts are guarded, which changes no match (a match can
#: only begin where a run begins or the last match ended) but keeps the search linear.
BASE = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)

#: Generators: the same kinds, spelled freely.
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+){1,6}+",
    r"(?<![0-9A-Za-z])(?:[0-9]{1,4}+[.,:]){3}+[0-9]{1,4}+(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])[0-9](?:[ ./-]?[0-9]){11,18}+(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])(?:\([0-9]{2,4}\)|[0-9]{2,4}+)(?:[ ./-]{1,2}+(?:\([0-9]{2,4}\)|[0-9]{2,4}+)){1,4}+(?![0-9A-Za-z])",
)

#: What a text must hold for a pattern to be tried.
_GUARDS = ("contains(t, '@')", "contains(t, '.')", None, "contains(t, '+')", "rlike(t, r'@|[(\\[{]at')", None, None, None)

FEATURES = (
    "kind", "length", "digits", "letters", "groups", "longest", "spaces", "brackets",
    "valid", "before_letter", "before_space", "before_mark", "after_letter", "after_space", "after_mark", "cue", "assigned", "quoted",
)

_CUES = r"(?i)(tel|phone|call|fax|mail|contact|card|visa|pay|addr|host|server|ip)"


def _valid() -> str:
    """Whether ``x`` passes the check of its kind."""
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    part = "trim(LEADING '0' FROM p)"
    parts = f"forall(split(x.value, '[.,:]'), p -> length({part}) <= 3 and coalesce(cast(nullif({part}, '') as int), 0) <= 255)"
    card = f"length({digits}) between 14 and 19 and luhn_check({digits})"
    return f"case x.ord % 4 when 0 then true when 1 then {parts} when 2 then {card} else length({digits}) between 10 and 15 end"


def _spans(text: str) -> Column:
    """All strict spans that pass their check, and all proposals, with their features."""
    found = ", ".join(hits("t", regex, i, guard) for i, (regex, guard) in enumerate(zip((*BASE, *LOOSE), _GUARDS, strict=True)))
    # Digits of a strict card pattern that fail are no proposal; the generators make their own.
    useful = f"filter({located(f'concat({found})', 'length(t)')}, x -> x.ord >= 4 or {_valid()})"
    before = slice_chunks("parts", f"greatest(x.start - {CONTEXT}, 0)", "x.start")
    after = slice_chunks("parts", "x.end", "least(x.end + 1, length(t))")
    split = "split(x.value, '[^0-9A-Za-z]+')"
    features = {
        "kind": "x.ord % 4",
        "length": "length(x.value)",
        "digits": "length(regexp_replace(x.value, '[^0-9]+', ''))",
        "letters": "length(regexp_replace(x.value, '[^A-Za-z]+', ''))",
        "groups": f"size({split})",
        "longest": f"array_max(transform({split}, g -> length(g)))",
        "spaces": "length(regexp_replace(x.value, '[^ ]+', ''))",
        "brackets": "int(rlike(x.value, '[()\\\\[{]'))",
        "valid": f"int({_valid()})",
        "before_letter": r"int(rlike(c.b, r'\p{L}$'))",
        "before_space": r"int(rlike(c.b, r'\s$') or c.b = '')",
        "before_mark": r"int(rlike(c.b, r'[^\s\p{L}0-9]$'))",
        "after_letter": r"int(rlike(c.a, r'^\p{L}'))",
        "after_space": r"int(rlike(c.a, r'^\s') or c.a = '')",
        "after_mark": r"int(rlike(c.a, r'^[^\s\p{L}0-9]'))",
        "cue": f"int(rlike(c.b, {quote(_CUES)}))",
        "assigned": "int(rlike(c.b, '[=:][ \"]*$'))",
        "quoted": "int(rlike(c.b, '[\"\\'][^\"\\']*$'))",
    }
    made = ", ".join(f"'{name}', cast({value} as double)" for name, value in features.items() if name != "kind")
    each = let("c", f"struct({before} AS b, {after} AS a)", f"named_struct('kind', x.ord % 4, 'start', x.start, 'end', x.end, 'base', x.ord < 4, {made})")
    return F.expr(let("t", f"coalesce({text}, '')", let("parts", chunks("t"), f"transform({useful}, x -> {each})")))


def candidates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``, both written: a number per document, and all its spans with features.

    ``free`` marks the proposals that touch no strict span.
    """
    whole = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    found = written(whole.select("row", "doc_id", _spans("__text").alias("spans")))
    spans = found.select("row", F.inline("spans"))
    order = Window.partitionBy("row").orderBy("start", F.desc("base"))
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # Backwards, as a frame that reaches to the end is summed up anew for each row.
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.asc("base")).rowsBetween(Window.unboundedPreceding, -1)
    begins = F.min(F.when(F.col("base"), F.col("start"))).over(back)
    free = ~F.col("base") & (F.coalesce(ended, F.lit(0)) <= F.col("start")) & (F.coalesce(begins, F.col("end")) >= F.col("end"))
    return found.select("row", "doc_id"), written(spans.withColumn("free", free).dropDuplicates(["row", "kind", "start", "end", "base"]))


def _assembled(spans: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(spans)


def added(spans: DataFrame) -> DataFrame:
    """``row``, ``kind``, ``start``, ``end`` of the proposals that the calibrated trees select."""
    usable = spans.where("base or free")
    groups = usable.groupBy("kind", "base").count().collect()  # eight at most
    none = spans.select("row", "kind", "start", "end").where("false")
    if len({r["base"] for r in groups}) < 2:
        return none
    # Each kind and label has its part of the sample, and the weight that makes up for it.
    shares = {(r["kind"], r["base"]): min(1.0, SAMPLE / len(groups) / r["count"]) for r in groups}
    name = F.concat_ws(":", F.col("kind").cast("string"), F.col("base").cast("string"))
    share = F.create_map(*(F.lit(v) for (kind, base), part in shares.items() for v in (f"{kind}:{str(base).lower()}", part)))
    drawn = F.pmod(F.xxhash64("row", "start", "kind"), F.lit(1 << 20)) < F.try_element_at(share, name) * (1 << 20)
    # A quarter of all spans never trains, however small the table.
    trains = (F.pmod(F.xxhash64("start", "row"), F.lit(4)) != 0) & drawn
    train = _assembled(written(usable.where(trains).withColumn("weight", 1 / F.try_element_at(share, name)).coalesce(4)))
    train = train.withColumn("label", F.col("base").cast("double"))
    if train.select("label").distinct().count() < 2:
        return none
    model = GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.3, seed=7, cacheNodeIds=False, weightCol="weight").fit(train)
    score = vector_to_array("probability")[1]
    # All strict spans that have not trained; a kind without any is measured by those that have.
    strict = model.transform(_assembled(spans.where("base").withColumn("trained", trains)))
    mean = strict.groupBy("kind").agg(F.coalesce(F.avg(F.when(~F.col("trained"), score)), F.avg(score)).alias("usual"))
    usual = {r["kind"]: r["usual"] for r in mean.collect()}  # four kinds at most
    least = F.create_map(*(F.lit(v) for kind, m in usual.items() for v in (kind, CHANCE * m)))
    scored = model.transform(_assembled(spans.where("free"))).where(score >= F.try_element_at(least, "kind"))
    return scored.select("row", "kind", "start", "end")


def find(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the numbers of strict spans, their digest, and all spans as ``kind:start:end``."""
    rows, spans = candidates(docs, doc, text)
    strict = spans.where("base").select("row", "kind", "start", "end", F.lit(True).alias("base"))
    every = strict.unionByName(added(spans).withColumn("base", F.lit(False)))
    names = F.array(*(F.lit(k) for k in KINDS))
    said = F.sort_array(F.collect_list(F.struct("start", "kind", "end", "base")))
    kept = every.groupBy("row").agg(said.alias("s"))
    listed = rows.join(kept, "row", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean>>")))
    spelled = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x.kind], x.start, x.end)), ",")
    base = F.filter("s", lambda x: x.base)
    counted = [F.expr(f"cast(size(filter(s, x -> x.base and x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return listed.select(F.col("doc_id").alias(doc), *counted, F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(F.col("s")).alias("spans"))
