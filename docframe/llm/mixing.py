"""Mixing sources to target weights by pivotal dependent rounding: built-in functions only.

Each document is to be copied target / source_size times: its whole part for sure, the fraction by rounding. Rounding
is dependent: within a block of documents of one source the pivot meets the next document, and words are moved at
random from one to the other until one of them is whole; the other goes on as the pivot. A move keeps the sum of
words, and each document's expected words. The pivots that blocks leave are rounded in blocks again, and so on: a
reduction tree with BLOCK branches, whose last pivot alone is rounded by chance. The last pivot is often among the
largest documents, so each source is rounded in classes of size, large documents first, and what a class took too much
or too little is made up by the next one's shares. So a source misses its target by less than one small document, if
it has enough small ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, shuffle_parts

BLOCK = 64
MOST = 3
#: Classes of size, as shares of the source's mean size: above the first, down to the next, and so on.
CUTS = (1.0, 0.125)
BROADCAST_SOURCES = 10_000


def words_of(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def ranked(s: DataFrame) -> DataFrame:
    """s, of one row a source, with its rank from 0: by code point, null last.

    Sources are sorted in ranges; only the number of rows of each range comes to the driver.
    """
    order = (F.col("source").isNull(), F.col("source"))
    s = s.repartitionByRange(shuffle_parts(s.sparkSession), *order).withColumn("range", F.spark_partition_id())
    s = checkpointed(s)
    before, at = [], 0
    for r in s.groupBy("range").count().orderBy("range").collect():
        before.append((r["range"], at))
        at += r["count"]
    if not before:
        return s.withColumn("rank", F.lit(0)).drop("range")
    first = F.broadcast(s.sparkSession.createDataFrame(before, "range int, first long"))
    return s.join(first, "range").withColumn("rank", F.col("first") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1).drop("range", "first")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, n, source_size, target) from (source, size, n): sums by source, then shares of the total by weight.

    Sources by code point, null last, weigh `weights`, repeating. A target stops at `most` times its source's size; the
    excess is shared by weight among the others, until none is above. Each round needs two sums only.
    """
    s = sizes.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = checkpointed(ranked(s).withColumn("weight", weight.cast("long")))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    ceiling = F.col("source_size") * most
    level, full = 0.0, F.lit(False)
    while True:
        rest, w, n = s.agg(F.sum(F.when(full, ceiling).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.sum(F.when(full, 1).otherwise(0))).first()
        if not w:
            break
        level = (total - rest) / w
        full = F.col("weight") * level > ceiling
        if s.filter(full).count() == n:
            break
    return s.select("source", "n", "source_size", F.when(full, ceiling.cast("double")).otherwise(F.col("weight") * level).alias("target"))


def _chance(*of) -> Column:
    """A number in [0, 1) that depends on `of` alone."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _round_block(members: Column) -> Column:
    """Sequential pivotal rounding of an array of (key, size, words, u): what became whole, and the last pivot.

    words is what the member holds of its size; u its random number.
    """
    def step(acc, b):
        a = acc["pivot"]
        to_a = F.least(a["size"] - a["words"], b["words"])  # what can move to the pivot, and away from it
        to_b = F.least(a["words"], b["size"] - b["words"])
        draw = b["u"] * (to_a + to_b) < to_b  # moves to the pivot with chance to_b / (to_a + to_b): no one's mean changes
        a_whole = F.when(draw, a["size"] - a["words"] <= b["words"]).otherwise(a["words"] <= b["size"] - b["words"])
        both = a["words"] + b["words"]
        # the one that isn't whole holds the rest
        b_left = F.when(draw, both - a["size"]).otherwise(both)
        a_left = F.when(draw, both).otherwise(both - b["size"])
        whole = lambda x, up: F.struct(x["key"].alias("key"), up.alias("up"))
        out = F.when(a_whole, whole(a, draw)).otherwise(whole(b, ~draw))
        pivot = F.when(a_whole, F.struct(b["key"].alias("key"), b["size"].alias("size"), b_left.alias("words"))).otherwise(F.struct(a["key"].alias("key"), a["size"].alias("size"), a_left.alias("words")))
        return F.struct(pivot.alias("pivot"), F.array_append(acc["done"], out).alias("done"))

    first = F.struct(members[0]["key"].alias("key"), members[0]["size"].alias("size"), members[0]["words"].alias("words"))
    start = F.struct(first.alias("pivot"), F.array().cast("array<struct<key:bigint,up:boolean>>").alias("done"))
    return F.aggregate(F.slice(members, 2, F.size(members)), start, step)


def rounded(units: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(key, up) for units (source, key, size, words): whether each is rounded up to its size or down to nothing.

    key is unique; size > 0 and 0 <= words <= size. Blocks are dealt by a hash of the key.
    """
    stats = checkpointed(units.groupBy("source").agg(F.count("*").alias("blocks")))
    n, largest = stats.agg(F.count("*"), F.max("blocks")).first()
    stats = stats.withColumnRenamed("source", "of")
    stats = F.broadcast(stats) if n <= BROADCAST_SOURCES else stats
    level, left = 0, largest or 0
    open_ = units.join(stats, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    found = None
    while left:
        last = left <= block
        blocks = F.ceil(F.col("blocks") / block)
        dealt = open_.withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed), F.lit(level)), blocks)).withColumn("u", _chance("key", F.lit(seed + 1), F.lit(level)))
        order = F.struct(F.xxhash64("key", F.lit(seed + 2), F.lit(level)).alias("o"), "key", "size", "words", "u")
        groups = dealt.groupBy("source", "blocks", "block").agg(F.sort_array(F.collect_list(order)).alias("members"))
        made = checkpointed(groups.select("source", blocks.alias("blocks"), _round_block(F.col("members")).alias("r")))
        done = made.select(F.explode("r.done").alias("d")).select("d.key", "d.up")
        pivots = made.select("source", "blocks", "r.pivot.*")
        if last:
            done = done.union(pivots.select("key", (_chance("key", F.lit(seed + 3)) * F.col("size") < F.col("words")).alias("up")))
        found = done if found is None else found.union(done)
        if last:
            break
        # hashing fills blocks unevenly: go by the largest source's number of blocks
        left, level, open_ = -(-left // block), level + 1, pivots
    return found if found is not None else units.select("key", F.lit(False).alias("up"))


def _made_up(units: DataFrame, missing: DataFrame, few: bool) -> DataFrame:
    """units with shares raised (or lowered) alike within each source, by the words that are missing."""
    whole = units.groupBy("source").agg(F.sum("words").alias("w"), F.sum("size").alias("s")).join(missing, F.col("source").eqNullSafe(F.col("of"))).drop("source")
    joined = units.join(F.broadcast(whole) if few else whole, F.col("source").eqNullSafe(F.col("of")), "left")
    # room: up to size where words are missing, down to nothing where too many were taken
    up = F.col("words") + (F.col("size") - F.col("words")) * F.least(F.lit(1.0), F.col("missing") / (F.col("s") - F.col("w")))
    down = F.col("words") * F.greatest(F.lit(0.0), 1 + F.col("missing") / F.col("w"))
    words = F.when((F.col("missing") > 0) & (F.col("s") > F.col("w")), up).when((F.col("missing") < 0) & (F.col("w") > 0), down).otherwise(F.col("words"))
    return joined.select("source", "key", "size", words.alias("words"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: int = 7, tell: Column | None = None) -> DataFrame:
    """How often the mix takes each document: (id_col, source_col, repeat, size, source_size, target, copies, taken).

    A row for each row of docs; repeat numbers the rows that agree in id, source and size (they are interchangeable),
    and in tell, a long, if that is given. _made_up() moves the shares of a source's smaller documents by what its larger
    ones took too much or too little, so a single document's mean is near, not at, its share; the mean of a class is.
    Sums of taken words come near each target (see above), and no document has more than `most` copies. The
    result depends on (id, source, size) and seed alone, so reruns agree however rows are dealt. Null sources are one
    source, the last; null texts have size 0; documents of size 0 take nothing and have one copy; null ids are ids like
    others. Other columns are not read. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_of(F.col(text_col)).alias("size"), *([] if tell is None else [tell.alias("tell")]))
    of = rows.columns
    grouped = checkpointed(rows.groupBy(*of).agg(F.count("*").alias("n")))
    t = targets(grouped, weights, most)
    few = t.count() <= BROADCAST_SOURCES
    t = checkpointed(t.select(F.col("source").alias("of"), F.col("n").alias("source_n"), "source_size", "target"))
    every = grouped.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    every = every.join(F.broadcast(t) if few else t, F.col("source").eqNullSafe(F.col("of"))).drop("of", "n")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mean = F.col("source_size") / F.col("source_n")
    cls = sum((F.when(F.col("size") <= mean * c, 1).otherwise(0) for c in CUTS), F.lit(0))
    every = every.withColumn("key", F.xxhash64(*of, "repeat")).withColumns({"base": F.floor(share), "words": (share - F.floor(share)) * F.col("size"), "cls": cls})
    every = checkpointed(every)
    open_ = every.filter("size > 0 AND words > 0").select("source", "key", "size", "words", "cls")
    ups, missing = None, None
    for k in range(len(CUTS) + 1):
        units = open_.filter(F.col("cls") == k).drop("cls")
        if missing is not None:
            units = _made_up(units, missing, few)
        done = rounded(units, seed=seed + 10 * k)
        done = checkpointed(done.filter("up").select("key").distinct())
        ups = done if ups is None else ups.union(done)
        if k < len(CUTS):
            # words wanted so far and not taken
            so_far = open_.filter(F.col("cls") <= k).join(ups.withColumn("one", F.lit(1)), "key", "left")
            missing = so_far.groupBy("source").agg(F.sum(F.col("words") - F.coalesce("one", F.lit(0)) * F.col("size")).alias("missing"))
            missing = checkpointed(missing.withColumnRenamed("source", "of"))
    ups = ups.withColumn("one", F.lit(1))
    out = every.join(ups, "key", "left").withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.least(F.col("base") + F.coalesce("one", F.lit(0)), F.lit(most))).cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), *of[3:], "repeat", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: Groups of equal rows that are broadcast at most; fewer than so many have more than this share of all rows.
LARGE_GROUPS = 4096


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: int = 7) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; columns are those of docs.

    Rows find their copies by id, source, number of words and a hash of the text. Rows that agree in all four share
    the copies of their group: each has the group's mean, rounded down or up. Rows of a group are numbered for that; a
    group with more than 1 / LARGE_GROUPS of all rows within each of the tasks that read it, so it stays dealt.
    """
    columns = docs.columns
    tell = F.xxhash64(F.col(text_col))
    plan = mixed(docs, id_col, text_col, source_col, weights, most, seed, tell).groupBy(F.col(id_col).alias("p_id"), F.col(source_col).alias("p_source"), F.col("size").alias("p_size"), F.col("tell").alias("p_tell"))
    plan = checkpointed(plan.agg(F.count("*").alias("n"), F.sum("copies").alias("copies")))
    total = plan.agg(F.sum("n")).first()[0] or 0
    large = plan.filter(F.col("n") > max(total // LARGE_GROUPS, 1))
    some_large = not large.isEmpty()
    pairs = [("_id", "p_id"), ("_source", "p_source"), ("_size", "p_size"), ("_tell", "p_tell")]
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words_of(F.col(text_col)).alias("_size"), tell.alias("_tell"))
    on = reduce(lambda x, y: x & y, (F.col(x).eqNullSafe(F.col(y)) for x, y in pairs))
    rest = row.join(F.broadcast(large), on, "left_anti") if some_large else row
    # numbered and joined by one hash, so that texts are dealt once; the columns themselves decide, counted so that they are no join keys
    rest = rest.withColumn("_k", F.xxhash64(*(x for x, _ in pairs))).withColumn("k", F.row_number().over(Window.partitionBy("_k").orderBy("_k")))
    alike = sum((F.when(F.col(x).eqNullSafe(F.col(y)), 1).otherwise(0) for x, y in pairs), F.lit(0)) == len(pairs)
    small = rest.join(plan.withColumn("p_k", F.xxhash64(*(y for _, y in pairs))), (F.col("_k") == F.col("p_k")) & alike)
    share = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("k") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    every = small.select("_row", share.cast("long").alias("copies"))
    if some_large:
        group = F.xxhash64("p_id", "p_source", "p_size", "p_tell")
        held = checkpointed(row.join(F.broadcast(large), on).select("_row", "n", "copies", group.alias("g"), F.spark_partition_id().alias("task")))
        first = Window.partitionBy("g").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        before = held.groupBy("g", "task").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(first), F.lit(0))).drop("c")
        numbered = held.withColumn("k", F.row_number().over(Window.partitionBy("g", "task").orderBy(F.lit(0)))).join(before, ["g", "task"]).withColumn("k", F.col("k") + F.col("before"))
        every = every.union(numbered.select("_row", share.cast("long").alias("copies")))
    return every.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
