"""URL filters: a sort-merge range join of URLs with host and path rules.

A host's canonical key is its labels reversed, each followed by a dot (www.example.com: com.example.www.), so a rule's
host and all its subdomains are one interval of keys, and intervals of different rules nest or are disjoint. Keys are
dealt to ranges; each range gets the rules whose interval meets it, which are the rules that begin in it and, at its
start, at most one host for each label of the first key. A sweep over the sorted range keeps a stack of the rules that
are open; a URL looks at the stack only.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts

#: Sampled keys for each range; only the balance of the ranges depends on them. No more than SAMPLE_MOST in all.
SAMPLE, SAMPLE_MOST = 20, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"


def parts_of(url):
    """Columns host and path of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host):
    """Column: labels reversed, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class Frame:
    """The open rules of one host."""

    def __init__(self, key: str):
        self.key, self.paths, self.lengths = key, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        old = self.paths.get(path)
        if old is None or old[1] != "block":
            self.paths[path] = (rule, verdict)
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def longest(self, path: str):
        for n in self.lengths:
            if n <= len(path) and (found := self.paths.get(path[:n])):
                return found
        return None


def _sweep(default: str):
    def run(batches):
        stack: list[Frame] = []
        for batch in batches:
            keys, rules, verdicts, paths = (batch.column(i).to_pylist() for i in (1, 6, 7, 5))
            out_rule, out_verdict = [], []
            for key, rule, verdict, path in zip(keys, rules, verdicts, paths, strict=True):
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if rule is not None:
                    if not stack or stack[-1].key != key:
                        stack.append(Frame(key))
                    stack[-1].add(path, rule, verdict)
                    continue
                best = None
                for frame in stack:  # deeper hosts come later and win ties
                    if (found := frame.longest(path)) and (best is None or len(found[0]) >= len(best[0])):
                        best = found
                out_rule.append(best and best[0])
                out_verdict.append(best[1] if best else default)
            urls = batch.filter(batch.column(6).is_null())
            yield pa.RecordBatch.from_arrays([urls.column(3), urls.column(4), urls.column(5), pa.array(out_rule, pa.string()), pa.array(out_verdict, pa.string())], names=["id", "host", "path", "rule", "verdict"])

    return run


def _dealt(bounds: list[str]):
    """Ranges of each row: a URL has one, a rule all that its interval meets."""

    def run(batches):
        for batch in batches:
            take, part = [], []
            for i, (key, spread, rule) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 6)), strict=True)):
                first = bisect_right(bounds, spread)
                last = first if rule is None else bisect_right(bounds, key + LAST)
                take += [i] * (last - first + 1)
                part += range(first, last + 1)
            out = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *out.columns[1:]], schema=batch.schema)

    return run


def judge_urls(pages: DataFrame, rules, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Verdict for each URL: that of the longest rule that fits, else `default`.

    rules: pairs (verdict, rule), or a DataFrame (verdict, rule); a rule is host + path, like example.com/en/. It fits
    its host and all subdomains where the URL's path starts with the rule's. Of two equally long rules the one with
    the longer host wins, of the same rule twice block. Rules without a host or a slash raise ValueError (given as
    pairs) or never fit. Returns (id_col, host, path, rule, verdict), a row for each row of pages; other columns are
    not read. A null URL, or one without ://, has host and path '' and fits no rule. Null and repeated ids are kept.
    """
    spark = pages.sparkSession
    parts = shuffle_parts(spark)
    if not isinstance(rules, DataFrame):
        for _, rule in rules:
            if not rule.partition("/")[0] or "/" not in rule:
                raise ValueError(f"a rule is host/path: {rule!r}")
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule string")
    host, path = parts_of(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    salt = F.hex(F.xxhash64("id", "url", "path"))
    urls = urls.select(F.lit(0).alias("part"), host_key(F.col("host")).alias("key"), "id", "host", "path", salt.alias("salt"))
    spread = F.concat_ws("\0", "key", "path", "salt")
    drawn = urls.select(spread.alias("x")).orderBy(F.xxhash64("x"), "x").limit(min(SAMPLE * parts, SAMPLE_MOST))
    keys = sorted(r.x for r in drawn.collect())
    bounds = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []

    null = F.lit(None).cast("string")
    rows = urls.select("part", "key", spread.alias("spread"), "id", "host", "path", null.alias("rule"), null.alias("verdict"))
    r_host, r_path = F.substring_index("rule", "/", 1), F.expr("substring(rule, instr(rule, '/'))")
    r_key = host_key(F.translate(r_host, UPPER, LOWER))
    held = rules.filter(F.col("rule").contains("/") & ~F.col("rule").startswith("/")).select(
        F.lit(0).alias("part"), r_key.alias("key"), r_key.alias("spread"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), r_host.alias("host"), r_path.alias("path"), "rule", "verdict"
    )
    every = rows.union(held)
    dealt = every.mapInArrow(_dealt(bounds), every.schema).repartitionById(parts, F.col("part"))
    swept = dealt.sortWithinPartitions(F.col("key"), F.col("rule").isNull(), F.col("path"))
    out = swept.mapInArrow(_sweep(default), f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
