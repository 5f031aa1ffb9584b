"""Mixing sources to target weights: fixed-length blocks, multinomial shard draws, index permutations.

DataFrame operations only. Each source's documents, laid end to end, are cut into blocks of
``block`` words. Output shards of ``shard`` slots draw their sources multinomially by target;
the n-th slot of a source becomes index n, which a keyed permutation of the source's blocks
(a new one for every pass over the source) turns into the block that fills the slot. Draws that
run past a source's quota of slots go, in order, to the sources whose draws fell short of
theirs, so every source is taken as often as its target asks and none more than three times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, stored

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 256
ROUNDS = 6  #: of the permutation
CELLS = 4096  #: of the table that turns a draw into a source
TASK_SLOTS = 50_000  #: slots whose blocks one task draws
RUN = 1024  #: shards, or parts of a queue, whose counts are summed first
QUEUE_ROWS = 2_000  #: documents in one part of a source's queue
SPAN = float(1 << 60)
WORD = r"[^\x20\x09-\x0D]+"


def digest(*parts) -> Column:
    """60 pseudorandom bits of the parts."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def with_sizes(docs: DataFrame) -> DataFrame:
    """docs with row_key and size, its number of words (null text: 0)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.withColumns({"row_key": F.monotonically_increasing_id(), "size": size})


def so_far(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """rows with base, the sum of value over the rows before in order, within keys; summed within runs and over runs."""
    x = rows.withColumn("run", F.expr(f"{order} div {RUN}"))
    within = Window.partitionBy(*keys, "run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = x.groupBy(*keys, "run").agg(F.sum(value).alias("m")).withColumn("runs_before", F.coalesce(F.sum("m").over(across), F.lit(0))).drop("m")
    return x.withColumn("rows_before", F.coalesce(F.sum(value).over(within), F.lit(0))).join(runs, [*keys, "run"]).withColumn("base", F.col("runs_before") + F.col("rows_before")).drop("run", "runs_before", "rows_before")


def source_plan(base: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """One row a source: rank by code point (null last), source_size, target, blocks, quota of slots.

    Targets are min(3 * size, level * weight) with the level at which they add up to all sizes,
    which is where sharing out the excess by weight ends. The only windows over all rows here
    are over one row a source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    s = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", (F.row_number().over(ordered) - 1).cast("bigint")).withColumn("weight", weight.cast("bigint"))
    s = s.withColumn("cap", REPEATS * F.col("source_size")).withColumn("all", F.sum("source_size").over(everything))
    s = s.withColumn("room", F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("rest", F.sum("weight").over(onward))
    s = s.withColumn("open", F.col("cap") * F.col("rest") > F.col("weight") * F.col("room"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "rank", "room", "rest"))).over(everything)
    s = s.withColumn("level", first)
    target = F.when(F.col("open"), F.col("weight") * F.col("level.room") / F.col("level.rest")).otherwise(F.col("cap").cast("double"))
    s = s.withColumn("target", target.cast("double")).withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("bigint"))
    quota = F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("bigint")
    s = s.withColumn("quota", F.when(F.col("source_size") > 0, F.least(quota, REPEATS * F.col("blocks"))).otherwise(F.lit(0)))
    up = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("quota_from", F.coalesce(F.sum("quota").over(up), F.lit(0)))
    return s.select("source", "rank", "source_size", "target", "blocks", "quota", "quota_from")


def draw(plan: DataFrame, shard: int = SHARD_SLOTS) -> DataFrame:
    """(shard, rank, epoch, block): what fills each slot of each shard of the mix."""
    spark = plan.sparkSession
    slots = plan.agg(F.sum("quota")).first()[0] or 0
    cell = max(1, -(-slots // CELLS))
    live = plan.where(F.col("quota") > 0)
    cells = live.select("rank", "quota", F.col("quota_from").alias("lo"), (F.col("quota_from") + F.col("quota")).alias("hi"))
    cells = cells.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))))
    at = F.least(F.floor(digest("slot", F.col("slot")) * F.lit(float(slots)) / F.lit(SPAN)), F.lit(slots - 1)).cast("bigint")
    drawn = spark.range(slots).select(F.expr(f"id div {shard}").alias("shard"), F.col("id").alias("slot")).select("shard", at.alias("at"))
    drawn = drawn.withColumn("cell", F.expr(f"at div {cell}")).join(cells, "cell").where("at >= lo and at < hi")
    # the multinomial counts, and where each source's numbering of them starts in each shard
    counts = settled(drawn.groupBy("shard", "rank").agg(F.count("*").alias("n")))
    # few rows until here, and many from here on: dealt by shard to as many tasks as the slots need
    tasks = max(1, -(-slots // TASK_SLOTS))
    got = so_far(counts, ["rank"], "shard", "n").repartition(tasks, "shard").select("shard", "rank", F.explode(F.expr("sequence(base, base + n - 1)")).alias("i"))
    # draws beyond a quota fill, in order, the places of sources that came out short
    total = counts.groupBy("rank").agg(F.sum("n").alias("got"))
    up = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ends = live.select("rank", "quota").join(total, "rank", "left").select("rank", "quota", F.coalesce("got", F.lit(0)).alias("got"))
    ends = ends.withColumn("over", F.greatest(F.col("got") - F.col("quota"), F.lit(0))).withColumn("short", F.greatest(F.col("quota") - F.col("got"), F.lit(0)))
    ends = ends.withColumns({"over_from": F.coalesce(F.sum("over").over(up), F.lit(0)), "short_from": F.coalesce(F.sum("short").over(up), F.lit(0))})
    got = got.join(ends.select("rank", "quota", "over_from"), "rank")
    kept = got.where("i < quota").select("shard", "rank", "i")
    spare = got.where("i >= quota").select("shard", (F.col("over_from") + F.col("i") - F.col("quota")).alias("r"))
    gaps = ends.where("short > 0").select("rank", (F.col("got") - F.col("short_from")).alias("d"), F.explode(F.sequence("short_from", F.expr("short_from + short - 1"))).alias("r"))
    slots_by_index = kept.unionByName(spare.join(gaps, "r").select("shard", "rank", (F.col("r") + F.col("d")).alias("i")))
    x = slots_by_index.join(live.select("rank", "blocks"), "rank")
    x = x.select("shard", "rank", "blocks", F.expr("i div blocks").alias("epoch"), (F.col("i") % F.col("blocks")).alias("x"))
    return permuted(x).select("shard", "rank", "epoch", F.col("x").alias("block"))


def permuted(x: DataFrame) -> DataFrame:
    """x mapped by a permutation of 0 .. blocks - 1 keyed by source and epoch (swap or not)."""
    for r in range(ROUNDS):
        key = digest("key", F.col("rank"), F.col("epoch"), F.lit(r)) % F.col("blocks")
        x = x.withColumn("other", (key + F.col("blocks") - F.col("x")) % F.col("blocks"))
        coin = digest("coin", F.col("rank"), F.col("epoch"), F.lit(r), F.greatest("x", "other")) % 2 == 1
        x = x.withColumn("x", F.when(coin, F.col("other")).otherwise(F.col("x")))
    return x.drop("other")


def document_blocks(base: DataFrame, plan: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(row_key, rank, block, begin, words): which words of a document lie in which block.

    A source's queue is ordered by part (a hash of the id), then id; places are summed within
    parts, over runs of parts and over runs, so that no task sorts a whole source.
    """
    parts = max(1, -(-base.count() // QUEUE_ROWS))
    q = base.where(F.col("size") > 0).join(plan.select("source", "rank").hint("broadcast") if plan.count() < 10_000 else plan.select("source", "rank"), base["source"].eqNullSafe(plan["source"]))
    q = q.select("row_key", "doc_id", "size", "rank", (digest("part", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts).alias("part"))
    within = Window.partitionBy("rank", "part").orderBy("doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    sums = so_far(q.groupBy("rank", "part").agg(F.sum("size").alias("m")), ["rank"], "part", "m").select("rank", "part", "base")
    q = q.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["rank", "part"]).withColumn("at", F.col("at") + F.col("base"))
    q = q.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
    begin, end = F.greatest(F.col("block") * block, F.col("at")), F.least((F.col("block") + 1) * block, F.col("at") + F.col("size"))
    return q.select("row_key", "rank", "block", (begin - F.col("at")).alias("begin"), (end - begin).alias("words"))


def mix(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs.

    Null texts and texts without words have size 0 and are taken 0 times; null sources form
    one source, the last; rows that repeat count as often as they stand there. An empty table
    gives none. Only doc_id, text and source are read.
    """
    base = settled(with_sizes(docs.select("doc_id", "text", "source")).drop("text"))
    plan = settled(source_plan(base, block))
    # settled before it is joined: inferring filters through the permutation's rounds would expand them
    takes = settled(draw(plan).groupBy("rank", "block").agg(F.count("*").alias("times")))
    words = document_blocks(base, plan, block).join(takes, ["rank", "block"]).groupBy("row_key").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    p = plan.select(F.col("source").alias("s"), "source_size", "target")
    out = base.join(p, F.col("source").eqNullSafe(F.col("s"))).join(words, "row_key", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents, in docs's columns: a row for each document and pass that takes words of it.

    A document taken whole keeps its text; one taken in part keeps its taken words, in order,
    joined by one space. n_chars, if a column, is the new text's length. Other columns, whatever
    their names, stay as they are. An empty table gives no rows.
    """
    given = docs.select(F.struct(*docs.columns).alias("row"), "text")
    base = stored(with_sizes(given).drop("text"), "mix")
    known = base.select("row_key", "size", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"))
    plan = settled(source_plan(known, block))
    pieces = document_blocks(known, plan, block).join(settled(draw(plan).select("rank", "block", "epoch")), ["rank", "block"])
    passes = pieces.groupBy("row_key", "epoch").agg(F.sort_array(F.collect_list(F.struct("begin", "words"))).alias("runs"), F.sum("words").alias("got"))
    words = F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0))
    partial = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(F.col("all_words"), (r["begin"] + 1).cast("int"), r["words"].cast("int")))), " ")
    out = base.join(passes, "row_key").withColumn("all_words", F.when(F.col("got") < F.col("size"), words))
    out = out.withColumn("new_text", F.when(F.col("got") < F.col("size"), partial).otherwise(F.col("row.text")))
    changed = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def mix_sql(block: int = BLOCK_WORDS) -> str:
    """The rows of mix() in DuckDB's SQL. Which shard gets a slot does not matter to what is taken."""
    def hashed(*parts: str) -> str:
        return "('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 15))::BIGINT"

    rounds, last = "", "x0"
    for r in range(ROUNDS):
        key = hashed("'key'", "rank", "epoch", str(r)) + " % blocks"
        coin = hashed("'coin'", "rank", "epoch", str(r), "greatest(x, other)") + " % 2 = 1"
        rounds += f", y{r} AS (SELECT *, ({key} + blocks - x) % blocks AS other FROM {last}), x{r + 1} AS (SELECT rank, epoch, blocks, CASE WHEN {coin} THEN other ELSE x END AS x FROM y{r})"
        last = f"x{r + 1}"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, row_number() OVER () AS rk FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, list_extract({list(WEIGHTS)}, (rank % {len(WEIGHTS)} + 1)::INT) AS weight, {REPEATS} * source_size AS cap, sum(source_size) OVER () AS every FROM s),
o AS (SELECT *, every - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
      sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
p AS (SELECT *, cap * rest > weight * room AS free FROM o),
l AS (SELECT room::DOUBLE AS room0, rest::DOUBLE AS rest0 FROM p WHERE free ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT p.*, CASE WHEN free THEN weight * room0 / rest0 ELSE cap::DOUBLE END AS target, ceil(source_size / {block})::BIGINT AS blocks FROM p LEFT JOIN l ON true),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target * blocks / source_size + 0.5)::BIGINT, {REPEATS} * blocks) ELSE 0 END AS quota FROM t),
i AS (SELECT rank, blocks, unnest(range(quota)) AS i FROM u WHERE quota > 0),
x0 AS (SELECT rank, i // blocks AS epoch, blocks, i % blocks AS x FROM i){rounds},
takes AS (SELECT rank, x AS block, count(*) AS times FROM {last} GROUP BY ALL),
q AS (SELECT d.*, rank, coalesce(sum(size) OVER (PARTITION BY rank ORDER BY {hashed("'part'", "coalesce(doc_id::VARCHAR, '')")} % (SELECT greatest(1, ceil(count(*) / {QUEUE_ROWS}))::BIGINT FROM d), doc_id NULLS FIRST, size, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source WHERE size > 0),
b AS (SELECT rk, rank, start, size, unnest(range(start // {block}, (start + size - 1) // {block} + 1)) AS block FROM q),
k AS (SELECT rk, sum((least((block + 1) * {block}, start + size) - greatest(block * {block}, start)) * times)::BIGINT AS taken FROM b JOIN takes USING (rank, block) GROUP BY rk)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source LEFT JOIN k USING (rk)
"""
