"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source is a stream of its documents in the order of their ids' hashes, cut into blocks of
``BLOCK`` bytes: a document belongs to the block in which it starts. Integer weights ``w`` that
sum to ``W`` give block ``i`` (from 0) of a source the release time ``floor(i * W / w)`` and the
deadline ``ceil((i + 1) * W / w)``, in slots of one block. In every slot the released block with the
earliest deadline goes first (ties: the source that sorts first). So after any number of slots each
source is less than one block away from its weight. The schedule repeats after ``W`` slots, so only
one period is computed: a fold in one row for sources of weight 2 or more, which are few, and a
formula for each of the others, whatever their number.

Whole results: every document gets a slot. When a source has run out its slots stay empty, and the
others go on in their weights.

Where a document starts in its source is a running sum that no task computes alone: documents are
cut by the first digits of their hash into chunks of about ``CHUNK`` rows, sums run within chunks, and
chunk totals are summed up two digits at a time, so no window meets more than 256 rows there.

Targets default to the square root of each source's bytes. Every source is scheduled, and its weight is 1
at least, so a period has some ``PERIOD`` slots and one more for each small source.

Defined results: a null source is a source of its own, null and empty texts have size 0, a null id is
ordered by its text; repeated rows each get their place. Weights that name unknown sources are
ignored, and sources without a positive weight get 1. Other columns are kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkveil.functions.lineage import written

BLOCK = 16_384
PERIOD = 1000
#: Sources are sorted and numbered in ranges of about so many, in ``MOST_RANGES`` ranges at most.
SOURCES = 400
MOST_RANGES = 1000
CHUNK = 2000
FILE_BYTES = 32 << 20


def _key(doc: str, text: str) -> Column:
    return F.md5(F.coalesce(F.col(doc).cast("string"), F.col(text).cast("string"), F.lit("")).cast("binary"))


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """``src`` (null for null) and ``size`` in bytes."""
    size = F.sum(F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0))).cast("bigint")
    return docs.groupBy(F.col(source).cast("string").alias("src")).agg(size.alias("size"))


def target_weights(sizes: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """``src`` (null for null) and its weight ``w`` of every source."""
    if weights is None:
        # Summed as decimals, so that the sum is the same in any order.
        roots = sizes.agg(F.sum(F.sqrt("size").cast("decimal(38,12)")).cast("double").alias("roots"))
        share = F.floor(PERIOD * F.sqrt("size") / F.greatest("roots", F.lit(1.0)) + 0.5).cast("bigint")
        return sizes.join(F.broadcast(roots)).select("src", F.greatest(F.lit(1).cast("bigint"), share).alias("w"))
    given = F.create_map(*(F.lit(v) for k, w in weights.items() for v in (k, int(w)))) if weights else F.create_map().cast("map<string,int>")
    known = F.when(F.col("src").isNotNull(), F.try_element_at(given, F.coalesce("src", F.lit(""))))
    return sizes.select("src", F.greatest(F.lit(1), F.coalesce(known, F.lit(1))).cast("bigint").alias("w"))


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds ``g``: the place of the source among all, sorted by ``src`` with null first; written."""
    first = F.asc_nulls_first("src")
    parts = max(1, min(MOST_RANGES, -(-sources.count() // SOURCES)))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = written(sources.repartitionByRange(parts, first).sortWithinPartitions(first).select("*", F.spark_partition_id().alias("part"), place.alias("place")))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not sources
    bases = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    return written(dealt.join(F.broadcast(bases), "part").select("src", "w", (F.col("base") + F.col("place")).alias("g")))


def _upto(array: str, value: str) -> str:
    """How many entries of the sorted ``array`` are at most ``value``, by halving."""
    step = f"if(p + b <= size({array}) and coalesce(get({array}, p + b - 1) <= {value}, false), p + b, p)"
    return f"aggregate(transform(sequence(0, 30), i -> shiftleft(1, 30 - i)), 0, (p, b) -> {step})"


def schedule(weights: DataFrame) -> DataFrame:
    """One period: ``src``, ``w``, ``turn`` (its k-th block of the period), ``slot`` and ``period``.

    The last block of every source in the period, which is the only one of a source of weight 1, is due at the
    period's end, all others earlier. So the others are dealt first, as if they were alone; the last
    ones fill the slots between, sorted by source as far as they are released. Only sources of weight 2 or more, at most
    ``PERIOD / 1.5`` of them by default, are folded; those of weight 1 take what is left by their rank.
    """
    every = _numbered(weights)
    total = every.agg(F.sum("w").alias("total"), F.count("*").alias("sources"))
    large = every.where("w > 1").agg(F.array_sort(F.collect_list(F.struct("g", "w"))).alias("ls"))
    one = written(total.join(large).where("total > 0"))

    # All blocks but the last of each source, by deadline; the slot moves on to the next release if none is released.
    due = "((s.done[i] + 1) * total + x.w - 1) div x.w"
    ready = f"transform(ls, (x, i) -> if(s.done[i] < x.w - 1, named_struct('at', greatest(s.t, (s.done[i] * total) div x.w), 'due', {due}, 'i', i), null))"
    step = (
        f"transform(array(array_min({ready})), p -> named_struct('t', p.at + 1L, 'done', transform(s.done, (d, i) -> if(i = p.i, d + 1L, d)), "
        "'slots', concat(s.slots, array(named_struct('i', p.i, 'turn', s.done[p.i], 'slot', p.at)))))[0]"
    )
    slots = "cast(array() as array<struct<i:int,turn:bigint,slot:bigint>>)"
    start = f"named_struct('t', 0L, 'done', transform(ls, x -> 0L), 'slots', {slots})"
    jobs = "total - sources"
    fold = f"if({jobs} > 0, aggregate(sequence(1L, greatest(1L, {jobs})), {start}, (s, n) -> {step}, s -> s.slots), {slots})"
    one = written(one.select("ls", "total", F.expr(fold).alias("early")))

    # The last blocks of large sources: ``free`` is the first slot left (counted among those left) in which the block is
    # released and its source's others are done, ``p`` the sources of weight 1 that sort before it.
    mine = "filter(early, e -> e.i = i and e.turn = x.w - 2)[0].slot + 1"
    one = one.withColumn("last", F.expr(f"transform(ls, (x, i) -> named_struct('a', greatest(((x.w - 1) * total) div x.w, {mine}), 'p', x.g - i))"))
    one = one.withColumn("taken", F.expr("transform(early, e -> e.slot)"))
    one = one.withColumn("gaps", F.expr("transform(taken, (t, i) -> t - i)"))
    one = written(one.withColumn("last", F.expr("transform(last, x -> named_struct('free', x.a - size(filter(taken, t -> t < x.a)), 'p', x.p))")))
    next_k = "greatest(s.k, x.free, s.k + greatest(0L, x.p - s.c))"
    nearest = f"array_min(transform(last, (x, i) -> if(array_contains(s.out.i, i), null, named_struct('k', {next_k}, 'i', i))))"
    step = (
        f"transform(array({nearest}), p -> named_struct('k', p.k + 1L, 'c', s.c + p.k - s.k, 'out', concat(s.out, array(named_struct('i', p.i, 'k', p.k)))))[0]"
    )
    none = "cast(array() as array<struct<i:int,k:bigint>>)"
    fold = f"if(size(last) > 0, aggregate(last, named_struct('k', 0L, 'c', 0L, 'out', {none}), (s, n) -> {step}, s -> s.out), {none})"
    one = written(one.withColumn("ends", F.expr(fold)))
    late = f"transform(ends, e -> named_struct('i', e.i, 'turn', ls[e.i].w - 1L, 'slot', e.k + {_upto('gaps', 'e.k')}))"
    one = one.select("ls", "total", F.expr(f"concat(early, {late})").alias("slots"))
    one = one.withColumn("held", F.expr("transform(array_sort(transform(slots, e -> e.slot)), (t, i) -> t - i)"))
    one = F.broadcast(written(one.withColumn("gs", F.expr("transform(ls, x -> x.g)"))))

    dealt = one.select("total", "ls", F.inline("slots")).select("total", F.expr("ls[i].g").alias("g"), "turn", "slot")
    of_large = every.where("w > 1").join(F.broadcast(dealt), "g").select("src", "w", "turn", "slot", F.col("total").alias("period"))
    rank = every.where("w = 1").join(one).withColumn("r", F.expr(f"g - {_upto('gs', 'g')}"))
    of_small = rank.select("src", "w", F.lit(0).cast("bigint").alias("turn"), F.expr(f"r + {_upto('held', 'r')}").alias("slot"), F.col("total").alias("period"))
    return of_large.unionByName(of_small)


def _before(rows: DataFrame, digits: int, of_source: DataFrame) -> DataFrame:
    """Adds ``__before``, the sizes of the source's documents that come earlier in its order, and ``of_source`` (by ``s1``).

    What holds for a source joins its chunks, not its rows: no task meets all rows of a large source.
    """
    chunk = F.substring("__key", 1, digits)
    within = Window.partitionBy("__src", "__chunk").orderBy("__key", "__id", "__hash").rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("__chunk", chunk).withColumn("__before", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    if not digits:
        return inner.join(of_source, F.col("__src").eqNullSafe(F.col("s1"))).drop("s1", "__chunk")
    sums = written(rows.groupBy("__src", chunk.alias("__chunk")).agg(F.sum("__size").alias("total")))
    base, level = sums.select("__src", "__chunk", F.lit(0).cast("bigint").alias("base")), digits
    while level > 0:
        parent, own = F.substring("__part", 1, level - 2), F.substring("__chunk", 1, level)
        parts = sums.groupBy("__src", own.alias("__part")).agg(F.sum("total").alias("total"))
        earlier = Window.partitionBy("__src", parent).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        step = parts.select(F.col("__src").alias("s"), F.col("__part").alias("p"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("add"))
        base = base.join(step, F.col("__src").eqNullSafe(F.col("s")) & (own == F.col("p"))).select("__src", "__chunk", (F.col("base") + F.col("add")).alias("base"))
        level -= 2
    base = base.join(of_source, F.col("__src").eqNullSafe(F.col("s1"))).drop("s1").withColumnsRenamed({"__src": "s", "__chunk": "c"})
    placed = inner.join(written(base), F.col("__src").eqNullSafe(F.col("s")) & (F.col("__chunk") == F.col("c")))
    return placed.withColumn("__before", F.col("__before") + F.col("base")).drop("s", "c", "base", "__chunk")


def placed(
    docs: DataFrame, keep: list[str], weights: dict[str, int] | None = None, doc: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """The columns ``keep`` with ``__src``, ``__before``, ``__block`` and ``__slot`` of every row.

    Rows sorted by ``__slot`` and ``__before`` are the mix.
    """
    whole = F.col(text).cast("string")
    rows = docs.select(
        *keep,
        F.col(source).cast("string").alias("__src"),
        _key(doc, text).alias("__key"),
        F.col(doc).cast("string").alias("__id"),
        F.xxhash64(whole).alias("__hash"),
        F.coalesce(F.octet_length(whole), F.lit(0)).cast("bigint").alias("__size"),
    )
    count = docs.count()
    digits = 0
    while count > CHUNK * 16**digits:
        digits += 2
    weighted = written(target_weights(written(source_sizes(docs, source, text)), weights))
    slots = written(schedule(weighted))
    # A source of weight 1 has one slot a period, the others (at most the sum of their weights) are looked up.
    of_source = slots.where("turn = 0").select(F.col("src").alias("s1"), F.col("w").alias("__w"), F.col("period").alias("__period"), F.when(F.col("w") == 1, F.col("slot")).alias("__one"))
    ranked = _before(rows, digits, of_source).withColumn("__block", F.expr(f"__before div {BLOCK}"))
    turns = F.broadcast(slots.where("w > 1").select(F.col("src").alias("s2"), "turn", "slot"))
    found = ranked.join(turns, F.col("__src").eqNullSafe(F.col("s2")) & (F.col("__block") % F.col("__w") == F.col("turn")), "left")
    return found.withColumn("__slot", F.expr("(__block div __w) * __period + coalesce(__one, slot)")).select(*keep, "__src", "__before", "__block", "__slot", "__key", "__id", "__hash")


def positions(docs: DataFrame, weights: dict[str, int] | None = None, doc: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per row: id, source, where it starts in its source, its block and the block's slot in the mix."""
    at = placed(docs, [doc], weights, doc, source, text)
    return at.select(doc, F.col("__src").alias("source"), F.col("__before").alias("before"), F.col("__block").alias("block"), F.col("__slot").alias("slot"))


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, doc: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """All rows and columns, partitioned and sorted so that the written files hold the mix in order."""
    order = ["__slot", "__src", "__before", "__key", "__id", "__hash"]
    # All columns go along as one, so that no name can clash.
    packed = docs.select(F.struct("*").alias("__row"), F.col(doc).alias("d"), F.col(source).alias("s"), F.col(text).alias("t"))
    at = placed(packed, ["__row"], weights, "d", "s", "t")
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    files = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    return at.repartitionByRange(files, *order).sortWithinPartitions(*order).select("__row.*")
