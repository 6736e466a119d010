"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts, one scan of each document.

Texts are normalised as bytes: A-Z in lower case, whatever separates words one space. The automaton holds all windows
of `window` words of all items, each between spaces, so it matches whole words only. Matches are mapped to word
numbers by the spaces before them, and words to places in the original text.

The windows are made in the cluster; only those of one block at a time, of about BLOCK_BYTES, come to the driver and go
to the executors as a broadcast. A benchmark of more than one block is dealt to blocks by a hash of the windows, and
the documents pass one block's automaton after another, written to the shared folder in between. Each task builds an
automaton once.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_ALNUM, Words, flushes, utf8, written

WINDOW = 10
BLOCK_BYTES = 4_000_000
_to_space = bytes(0x20 if NOT_ALNUM[LOWER[b]] else int(LOWER[b]) for b in range(256))


def item_windows(text: str | None, window: int) -> list[bytes]:
    """Each window of an item's words, between spaces; an item of fewer words is one window, of none has none."""
    words = (text or "").encode().translate(_to_space).split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))]


@lru_cache(maxsize=1)
def _automaton(block: _Block):
    """The automaton of a block's windows (text, item), built once a task. None of no windows."""
    held: dict[bytes, set] = {}
    for w, item in block.value:
        held.setdefault(w, set()).add(item)
    a = ahocorasick.Automaton()
    for w, ids in held.items():
        a.add_word(w.decode("latin-1"), (len(w), w.count(b" ") - 1, frozenset(ids)))
    if held:
        a.make_automaton()
    return a if held else None


class _Block:
    """A broadcast with a hash of its name, so that the cache needs no look at its value."""

    def __init__(self, shared):
        self.shared, self.name = shared, uuid.uuid4().hex

    @property
    def value(self):
        return self.shared.value

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other) -> bool:
        return self.name == other.name


def _windows(window: int):
    schema = pa.schema([("w", pa.binary()), ("item", pa.string())])

    def run(batches):
        for batch in batches:
            out = [(w, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in item_windows(t, window)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.binary()), pa.array([i for _, i in out], pa.string())], schema=schema)

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
    """The windows (text, item) of each block, one block at a time; item ids are texts."""
    made = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).mapInArrow(_windows(window), "w binary, item string").distinct()
    size = made.agg(F.sum(F.octet_length("w") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    many = -(-size // block_bytes)
    if many > 1:
        made = written(made, "windows")
    for k in range(many):
        part = made if many == 1 else made.filter(F.pmod(F.xxhash64("w"), F.lit(many)) == k)
        yield [(bytes(r.w), r.item) for r in part.collect()], k == many - 1


def _joined(edges: list[int], more: list[tuple[int, int]]) -> list[int]:
    """Borders of the union of word ranges: those between pairs of edges, and more."""
    out: list[int] = []
    for a, b in sorted([*zip(edges[::2], edges[1::2], strict=True), *more]):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _scan(text_col: str, block: _Block | None, schema: pa.Schema, first: bool, spans: bool):
    """Adds a block's matches: n_words, edges (borders of hit word ranges), items; with spans, places in the text."""
    keep = [f.name for f in schema][: -3 - spans]

    def run(batches):
        auto = _automaton(block) if block is not None else None
        for batch in flushes(batches, text_col):
            data, off = utf8(batch.column(batch.schema.get_field_index(text_col)))
            n = batch.num_rows
            old = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            edges, items = ([[] for _ in range(n)], [[] for _ in range(n)]) if first else (old("edges"), old("items"))
            n_words, places = np.zeros(n, np.int64), [[] for _ in range(n)]
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                text = b" ".join([b"", *data[a:b].tobytes().translate(_to_space).split(), b""]) if b > a else b""
                n_words[i] = max(0, text.count(b" ") - 1)
                marks, ids = [], set()
                if auto is not None and n_words[i]:
                    for end, (length, words, held) in auto.iter(text.decode("latin-1")):
                        marks.append((end + 1 - length, words))
                        ids |= held
                if marks:
                    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
                    at = np.searchsorted(gaps, [s for s, _ in marks]).tolist()
                    edges[i] = _joined(edges[i], [(s, s + w) for s, (_, w) in zip(at, marks, strict=True)])
                    items[i] = sorted(ids.union(items[i]) - {None})
                if spans and edges[i]:
                    raw = data[a:b]
                    words = Words(raw, np.array([0, len(raw)]), LOWER, NOT_ALNUM)
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
                    places[i] = [{"start": int(chars[words.start[s]]), "end": int(chars[words.end[e - 1]])} for s, e in zip(edges[i][::2], edges[i][1::2], strict=True)]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = [pa.array(n_words), pa.array(edges, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            if spans:
                made.append(pa.array(places, schema.field("spans").type))
            yield pa.RecordBatch.from_arrays([*cols, *made], schema=schema)
        _automaton.cache_clear()  # workers live on

    return run


def _scanned(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, window: int, block_bytes: int, spans: bool) -> DataFrame:
    """docs with n_words, edges, items and spans added; they replace columns of these names."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    names = ["n_words", "edges", "items", "spans"]
    docs = docs.drop(*names)
    more = StructType.fromDDL("n_words long, edges array<long>, items array<string>, spans array<struct<start:int,end:int>>")
    fields, out, found = docs.schema.fields, docs, False
    for rows, last in _blocks(benchmark, item_col, item_text, window, block_bytes):
        block = _Block(spark.sparkContext.broadcast(rows))
        schema = StructType([*fields, *more.fields[: 3 + (spans and last)]])
        out = out.mapInArrow(_scan(text_col, block, to_arrow_schema(schema), not found, spans and last), schema)
        if not last:
            out = written(out, "scanned")
            block.shared.unpersist()
        found = True
    if not found:
        schema = StructType([*fields, *more.fields[: 3 + spans]])
        out = docs.mapInArrow(_scan(text_col, None, to_arrow_schema(schema), True, spans), schema)
    return out


def _hits() -> Column:
    """Number of hit words from the borders of their ranges."""
    return F.aggregate(F.transform("edges", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window.

    Returns (id_col, n_words, n_hit, items, spans): items are the ids, as sorted texts, whose windows occur; spans the
    hit passages of the original text as (start, end) in code points. A row for each row of docs. Null and word-less
    texts have no words. Items without words match nothing; a null item id marks words but is no item, an empty one is
    an item like others; repeated ids are one item. An empty benchmark hits nothing. block_bytes changes the cost only.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = _scanned(rows, "text", benchmark, item_col, item_text, window, block_bytes, True)
    return out.select(F.col("id").alias(id_col), "n_words", _hits().alias("n_hit"), "items", "spans")


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query returns, from find_contamination()."""
    return found.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256), "contaminated": F.col("n_hit") > 0}).drop("items", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs without a hit word, with docs' columns."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("_row"), F.col(text_col).alias("_text"))
    out = _scanned(row, "_text", benchmark, item_col, item_text, window, block_bytes, False).filter("size(edges) = 0")
    return out.select("_row.*", F.col("_text").alias(text_col)).select(*(f"`{c}`" for c in docs.columns))
