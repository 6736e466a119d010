"""Quality rules, with verdicts on whole hosts: built-in functions only.

Each text is measured in its own row, without a shuffle. Failures are added up by host (partial sums first, so a hot
host is one row a task), and each host's failure rate is shrunk towards the mean of all hosts by a beta prior. The
prior's weight is fitted by moments: the spread of the hosts' rates, less the binomial noise that hosts of their sizes
show anyway. Hosts whose shrunk rate is more than SPREADS standard deviations of the prior above its mean lose all their
documents; the bar is LEAST_BAR at least, so that no host goes while most of its documents pass, and MOST_BAR at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

BLANKS = " \t\n\x0b\x0c\r"
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Weight of the prior in documents: what the spread of rates gives, within these.
PRIOR_LEAST, PRIOR_MOST = 1.0, 1000.0
#: The bar for hosts: standard deviations of the prior above its mean, and the bar's bounds.
SPREADS, LEAST_BAR, MOST_BAR = 3.0, 0.5, 0.9
#: Hosts that are sent to all executors at most, and characters of their names; beyond, hosts are joined by a shuffle.
BROADCAST_HOSTS, BROADCAST_CHARS = 50_000, 4_000_000


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated(w: Column) -> Column:
    """Words of array w that lie in a 3-word window found twice: windows sorted, equal neighbours kept, places joined."""
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))))

    def twice(s):
        at = F.transform(s, lambda x, k: F.when((x["t"] == F.get(s, k - 1)["t"]) | (x["t"] == F.get(s, k + 1)["t"]), x["i"]))
        return F.sort_array(F.filter(at, lambda x: x.isNotNull()))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto"))
    step = lambda acc, x: F.struct((acc["total"] + x + 3 - F.greatest(x, acc["upto"])).alias("total"), (x + 3).alias("upto"))
    return F.aggregate(let(windows, twice), start, step, lambda acc: acc["total"])


def measures(text: Column, exact: bool = True) -> Column:
    """A struct of the measures of a text; a null text measures as an empty one.

    exact=False serves the rules alone: n_repeat_words is 0 where it can't be over half of the words. k windows more
    than distinct ones mean at most 2 k windows found twice, and 6 k words in them.
    What is used twice is bound by let(): the optimizer may move or copy the whole expression, never its parts.
    """
    text = F.coalesce(text, F.lit(""))
    bare = F.btrim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK))

    def of_words(w: Column) -> Column:
        hashes = F.when(F.size(w) > 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
        alike = let(hashes, lambda g: F.size(g) - F.size(F.array_distinct(g)))  # no equal hash: no equal window
        alike = F.coalesce(alike > 0 if exact else alike * 12 > F.size(w), F.lit(False))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.when(alike, _repeated(w)).otherwise(0).cast("long").alias("n_repeat_words"))

    def all_of(w: Column, x: Column) -> Column:
        return F.struct(
            w["n_words"].alias("n_words"),
            F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
        )

    return let(let(words, of_words), lambda w: let(lines, lambda x: all_of(w, x)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)


def failed(m: Column) -> Column:
    """Any rule: too short, repetitive, full of symbols, or with many repeated lines."""
    return base_failed(m) | (m["n_symbols"] * 10 > m["word_chars"]) | (m["n_dup_lines"] * 10 > m["n_lines"] * 3)


def fitted(hosts: DataFrame) -> tuple[float, float]:
    """Mean and weight of the beta prior from (n, f) of each host.

    The variance of observed rates is the hosts' own plus, for a host of n documents, about mean (1 - mean) / n; the
    second part is taken off before the weight is fitted. Hosts that differ by no more than that get PRIOR_MOST.
    """
    rate = F.col("f") / F.col("n")
    mean, spread, noise = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n"))).first()
    mean, spread, noise = mean or 0.0, spread or 0.0, noise or 0.0
    own = spread - noise * mean * (1 - mean)
    weight = mean * (1 - mean) / own - 1 if own > 0 else PRIOR_MOST
    return mean, min(max(weight, PRIOR_LEAST), PRIOR_MOST)


def bar(mean: float, weight: float) -> float:
    """The shrunk rate above which a host is rejected."""
    return min(max(mean + SPREADS * (mean * (1 - mean) / (weight + 1)) ** 0.5, LEAST_BAR), MOST_BAR)


def shrunk_hosts(marks: DataFrame) -> DataFrame:
    """(host, n, f, rate, bar) from (host, failed): the failure rate under the fitted prior, and the bar that follows from it."""
    hosts = checkpointed(marks.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f")))
    mean, weight = fitted(hosts)
    return hosts.withColumns({"rate": (F.col("f") + mean * weight) / (F.col("n") + weight), "bar": F.lit(bar(mean, weight))})


def bad_hosts(marks: DataFrame, max_rate: float | None) -> DataFrame:
    """The hosts to reject, with a hint to broadcast them where their number and names are small."""
    bad = shrunk_hosts(marks).filter(F.col("rate") > (F.col("bar") if max_rate is None else max_rate)).select("host")
    n, chars = bad.agg(F.count("*"), F.sum(F.length("host"))).first()
    return F.broadcast(bad) if n <= BROADCAST_HOSTS and (chars or 0) <= BROADCAST_CHARS else bad


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float | None = None) -> DataFrame:
    """Measures and verdict for each row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept. kept is false where base_failed, or where the host's shrunk failure rate is above max_rate, by
    default the bar that follows from the prior.

    Null texts count as empty, and fail. Null hosts are one host. Repeated ids and rows each get a row. Other columns
    are not read. An empty table gives an empty table.
    """
    m = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), measures(F.col(text_col)).alias("m")))
    bad = bad_hosts(m.select("host", failed(F.col("m")).alias("failed")), max_rate).withColumn("bad", F.lit(True)).withColumnRenamed("host", "bad_host")
    out = m.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    fails = base_failed(F.col("m"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("id").alias(id_col), *(F.col("m")[c].alias(c) for c in names), fails.alias("base_failed"), (~fails & F.col("bad").isNull()).alias("kept"))


def kept(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float | None = None) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' columns. Texts are never shuffled unless the bad hosts are many."""
    marks = docs.select(F.col(host_col).alias("host"), let(measures(F.col(text_col), exact=False), failed).alias("failed"))
    bad = bad_hosts(marks, max_rate).select(F.col("host").alias("_bad_host"))
    good = docs.filter(let(measures(F.col(text_col), exact=False), lambda m: ~base_failed(m)))
    return good.join(bad, F.col(host_col).eqNullSafe(F.col("_bad_host")), "left_anti")
