"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

One pass over the texts hashes each document's distinct word shingles. Shingles travel as sorted 64-bit numbers with
small owner numbers, packed per flush and bucket, to be counted; their document frequencies travel back the same way,
and each document orders its shingles by (frequency, number): rare ones first. Two sets of n and m shingles with a
Jaccard similarity t or more share one of the first n - ceil(t n) + 1 in that order. Shingles of one document only
can't be shared, so a document whose prefix holds nothing else has no partner and goes no further.

A shingle that a share of a flush's sets holds (HOT, HOT_SHARE) is hot: only its number of owners in the flush travels
to be counted, never the owners. Hot shingles rank behind all others. Only sets whose prefix reaches into their hot
shingles need the order among those; they are joined with the hot shingles' frequencies afterwards.

What is left is joined on the shared prefix shingles. Of a pair, the smaller set's shingle must stand in the first
n (1 - t) / (1 + t), so only such rows look for partners, among sets that are no smaller: sets that have a common
shingle late in their prefix never meet there. Shingles with many owners are first joined within chunks of CHUNK
owners, two ways; that finds the bulk of a group of copies in linear work. Then only pairs whose documents are not yet
known to be connected are joined across chunks: owners outside a shingle's largest component with all its owners, so
that a large group of copies isn't joined with itself. Every row knows its shingle's frequency, so that the rows of a
common one are dealt to many tasks by a salt. Every pair passes the length, positional and suffix filters and is
verified once. Nothing is capped: the second join covers all that the first left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACES, U64, Words, checkpointed, flushes, folded, mix, pack, rows_of, runs, shuffle_parts, sized, trim, unpack, utf8, written
from .components import components, relabelled

#: Shingles that so many sets of one flush share, and one in HOT_SHARE of them, aren't sent with their owners.
HOT, HOT_SHARE = 32, 64
HOT_DF = 0xFFFFFFFF
#: Owners of a shingle that are joined all with all; rows of a shingle that meet in one task.
CHUNK, SPLIT = 16, 512
#: Bytes of text that a task hashes at a time: its arrays take about thirty times as much.
SCAN_BYTES = 2_000_000
#: Buckets for each partition; a task holds one at a time. Entries that a task gathers before it sends them on.
BUCKETS, HELD = 4, 1_000_000
#: Rows of the most common hot shingles that are broadcast.
BROADCAST_HOT = 1_000_000
#: Rows to drop that are broadcast; beyond, they are joined by a shuffle.
BROADCAST_DROPPED = 1_000_000
META, TOKENS, HOTS, BACK, PREFIX, SET, LATE = range(7)
WIRE = "kind int, part int, bucket int, doc_id {id}, n long, cls long, tok binary, own binary, ocls binary, on_ binary, df binary"
FOUND = "kind int, doc_id {id}, n long, cls long, token long, pos int, h long, df long, toks array<long>"
LATER = "cls long, n long, token long, pos int, h long, df long"


def _arrow(ddl: str, id_type: pa.DataType) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "{id}": id_type, "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and the text of each. Fewer words: the whole sequence as one."""
    h, text, counts = words.hash, words.text, np.diff(words.first)
    s = folded(h, width)
    own = text[: len(s)]
    good = own == text[width - 1 :] if len(s) else np.zeros(0, bool)
    s, own = s[good], own[good]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        more = np.array([folded(h[words.first[i] : words.first[i + 1]], counts[i])[0] for i in short], U64)
        s, own = np.concatenate([s, more]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        s, own = s[order], own[order]
    at = np.searchsorted(own, np.arange(words.n_texts + 1))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            s[a:b].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
    return s[keep], own[keep]


def _blobs(token: np.ndarray, owner: np.ndarray, place: np.ndarray, cls: np.ndarray, n: np.ndarray, df: np.ndarray | None, kind: int) -> list[dict]:
    """Rows for each place, a bucket's number; place is sorted, token sorted within. Owner numbers of a row are dense."""
    out = []
    cut = np.append(runs(place), len(place)).tolist()
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        who, own = np.unique(owner[a:b], return_inverse=True)
        small = np.uint16 if len(who) < 65536 else np.uint32
        p = int(place[a])
        out.append(
            {"kind": kind, "part": p // BUCKETS, "bucket": p % BUCKETS, "tok": pack(token[a:b], True), "own": bytes([small().itemsize]) + pack(own.astype(small)), "ocls": pack(cls[who]), "on_": pack(n[who].astype(np.uint32)), "df": pack(df[a:b]) if df is not None else None}
        )
    return out


def _opened(rows: list[dict]) -> tuple[np.ndarray, ...] | None:
    """token, owner and df of all rows; class and size of each owner, a class once."""
    tokens, owners, classes, sizes, dfs, at = [], [], [], [], [], 0
    for r in rows:
        own = unpack(r["own"][1:], {2: np.uint16, 4: np.uint32}[r["own"][0]])
        cls = unpack(r["ocls"], U64)
        tokens.append(unpack(r["tok"], U64, True))
        owners.append(own.astype(np.int32) + np.int32(at))
        classes.append(cls)
        sizes.append(unpack(r["on_"], np.uint32))
        if r["df"] is not None:
            dfs.append(unpack(r["df"], np.uint32))
        at += len(cls)
    if not tokens:
        return None
    cls, same, number = np.unique(np.concatenate(classes), return_index=True, return_inverse=True)
    df = np.concatenate(dfs) if dfs else None
    return np.concatenate(tokens), number.astype(np.int32)[np.concatenate(owners)], df, cls, np.concatenate(sizes)[same].astype(np.int64)


def _place(token: np.ndarray, parts: int) -> np.ndarray:
    """Number of the bucket of each token; buckets are ranges, BUCKETS to a part."""
    many = parts * BUCKETS
    return np.searchsorted(np.array([(i << 64) // many for i in range(1, many)], U64), token, "right")


def _back(token, owner, cls, n, df, parts):
    """Rows that take (token, df) to the bucket of their owner's class."""
    place = ((cls % U64(parts)) * U64(BUCKETS) + (cls // U64(parts)) % U64(BUCKETS)).astype(np.int64)[owner]
    order = np.lexsort((token, place))
    return _blobs(token[order], owner[order], place[order], cls, n, df[order], BACK)


def _hot_rows(token: np.ndarray, count: np.ndarray, parts: int) -> list[dict]:
    """Rows that take (token, number of owners) to the bucket of the token; tokens are sorted."""
    place = _place(token, parts)
    cut = np.append(runs(place), len(place)).tolist()
    return [{"kind": HOTS, "part": int(place[a]) // BUCKETS, "bucket": int(place[a]) % BUCKETS, "tok": pack(token[a:b], True), "df": pack(count[a:b].astype(np.int64))} for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _scan(width: int, parts: int, id_type: pa.DataType):
    schema = _arrow(WIRE, id_type)

    def run(batches):
        for batch in flushes(batches, "text", SCAN_BYTES):
            texts = batch.num_rows
            s, own = shingle_sets(Words(*utf8(batch.column(1)), LOWER, SPACES), width)
            n = np.bincount(own, minlength=texts)
            sums = np.zeros(texts, U64)
            if len(s):
                heads = runs(own)
                sums[own[heads]] = np.add.reduceat(mix(s + U64(width)), heads)
            cls = mix(sums + n.astype(U64))
            at = [pa.array(np.full(len(n), META, np.int32)), pa.array((cls % U64(parts)).astype(np.int32)), pa.array(np.full(len(n), -1, np.int32))]
            yield pa.RecordBatch.from_arrays([*at, batch.column(0), pa.array(n.astype(np.int64)), pa.array(cls.view(np.int64), mask=n == 0), *[pa.nulls(len(n), pa.binary())] * 5], schema=schema)
            # exact copies within the flush send their shingles once
            first = np.zeros(texts, bool)
            first[np.unique(cls, return_index=True)[1]] = True
            s, own = s[first[own]], own[first[own]]
            if not len(s):
                continue
            order = np.argsort(s, kind="stable")
            token, owner = s[order], own[order]
            heads = runs(token)
            size = np.diff(np.append(heads, len(token)))
            common = size >= max(HOT, int(first.sum()) // HOT_SHARE)
            rows: list[dict] = []
            if common.any():
                rows += _hot_rows(token[heads[common]], size[common], parts)
                hot = np.repeat(common, size)
                rows += _back(token[hot], owner[hot], cls, n, np.full(hot.sum(), HOT_DF, np.uint32), parts)
                token, owner = token[~hot], owner[~hot]
            if len(token):
                rows += _blobs(token, owner, _place(token, parts), cls, n, None, TOKENS)
            yield from sized(rows, schema)

    return run


def _split(batches, kinds: tuple[int, ...]):
    """(batch, None) for rows of other kinds, at once, and (None, rows) for each bucket of these kinds."""
    held: list[dict] = []
    for batch in batches:
        mine = np.isin(batch.column(0).to_numpy(zero_copy_only=False), kinds)
        if not mine.all():
            yield batch.filter(pa.array(~mine)), None
        for row in batch.filter(pa.array(mine)).to_pylist() if mine.any() else ():
            if held and held[-1]["bucket"] != row["bucket"]:
                yield None, held
                held = []
            held.append(row)
    if held:
        yield None, held


def _count(parts: int, id_type: pa.DataType):
    """Frequencies of one range of shingles, sent back to their owners where two or more sets hold them."""
    schema = _arrow(WIRE, id_type)

    def counted(rows: list[dict]):
        hot = [r for r in rows if r["kind"] == HOTS]
        hot_token, hot_n = np.zeros(0, U64), np.zeros(0, np.int64)
        if hot:
            token = np.concatenate([unpack(r["tok"], U64, True) for r in hot])
            hot_token, number = np.unique(token, return_inverse=True)
            hot_n = np.zeros(len(hot_token), np.int64)
            np.add.at(hot_n, number, np.concatenate([unpack(r["df"], np.int64) for r in hot]))
        if (found := _opened([r for r in rows if r["kind"] == TOKENS])) is None:
            return None, hot_token, hot_n
        token, owner, _, cls, n = found
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[new], owner[new]
        heads = runs(token)
        size = np.diff(np.append(heads, len(token)))
        df = np.minimum(size, HOT_DF - 1).astype(np.uint32)
        if len(hot_token):
            at = np.minimum(np.searchsorted(hot_token, token[heads]), len(hot_token) - 1)
            is_hot = hot_token[at] == token[heads]
            np.add.at(hot_n, at[is_hot], size[is_hot])
            df[is_hot] = HOT_DF
        df = np.repeat(df, size)
        shared = df > 1
        return (token[shared], owner[shared], cls, n, df[shared]), hot_token, hot_n

    def run(batches):
        held: list[tuple] = []
        for passed, rows in _split(batches, (TOKENS, HOTS)):
            if passed is not None:
                yield passed
                continue
            entries, hot_token, hot_n = counted(rows)
            if len(hot_token):
                yield from sized(_hot_rows(hot_token, hot_n, parts), schema)
            if entries is not None and len(entries[0]):
                held.append(entries)
            if sum(len(e[0]) for e in held) >= HELD:
                yield from sized(_sent_back(held, parts), schema)
                held = []
        if held:
            yield from sized(_sent_back(held, parts), schema)
        trim()

    return run


def _sent_back(held: list[tuple], parts: int) -> list[dict]:
    """_back() of several buckets' (token, owner, cls, n, df) at once."""
    before = np.concatenate([[0], np.cumsum([len(e[2]) for e in held])])
    owner = np.concatenate([e[1].astype(np.int64) + b for e, b in zip(held, before[:-1], strict=True)])
    return _back(np.concatenate([e[0] for e in held]), owner, *(np.concatenate([e[i] for e in held]) for i in (2, 3, 4)), parts)


def _behind(mine: np.ndarray) -> np.ndarray:
    """How many shingles stand behind each position, in four classes of 16 bits."""
    left = [np.cumsum((mine[::-1] & 3) == b)[::-1] - ((mine & 3) == b) for b in range(4)]
    return sum(np.minimum(x, 65535).astype(U64) << U64(16 * b) for b, x in enumerate(left)).view(np.int64)


def _order(percent: int, id_type: pa.DataType):
    """Rare-first order of each set, and the shared shingles of its prefix. Where the prefix reaches into hot shingles,
    their order isn't known here: LATE rows hold them, pos being where they begin and h how many the prefix takes."""
    schema = _arrow(FOUND, id_type)

    def filled(kind: int, rows: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows, kind, np.int32)), *(columns.get(f.name, pa.nulls(rows, f.type)) for f in list(schema)[1:])], schema=schema)

    def run(batches):
        for passed, rows in _split(batches, (BACK,)):
            if passed is None:
                yield from ordered(rows)
                continue
            kinds = passed.column(0).to_numpy(zero_copy_only=False)
            meta = passed.filter(pa.array(kinds == META))
            if meta.num_rows:
                yield filled(META, meta.num_rows, doc_id=meta.column(3), n=meta.column(4), cls=meta.column(5))
            for r in passed.filter(pa.array(kinds == HOTS)).to_pylist():
                token = unpack(r["tok"], U64, True)
                yield filled(HOTS, len(token), token=pa.array(token.view(np.int64)), df=pa.array(unpack(r["df"], np.int64)))
        trim()

    def ordered(rows: list[dict]):
        token, owner, df, cls, n = _opened(rows)
        order = np.lexsort((token, df, owner))
        token, owner, df = token[order], owner[order], df[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner, df = token[new], owner[new], df[new]
        at = np.searchsorted(owner, np.arange(len(cls) + 1))
        k = np.diff(at)
        prefix = n - (n * percent + 99) // 100 + 1
        many = np.minimum(prefix - (n - k), k)  # shared shingles in the prefix; n - k belong to this set only
        plain = np.bincount(owner[df != HOT_DF], minlength=len(cls))  # shared shingles that aren't hot come first
        out: list[dict] = []
        for i in np.flatnonzero(many > 0).tolist():
            mine = token[at[i] : at[i + 1]].view(np.int64)
            lone, c, size, now = int(n[i] - k[i]), int(cls[i].view(np.int64)), int(n[i]), int(min(many[i], plain[i]))
            h, seen = _behind(mine), df[at[i] : at[i] + now]
            out.append({"kind": SET, "n": size, "cls": c, "toks": mine})
            out += [{"kind": PREFIX, "n": size, "cls": c, "token": int(mine[j]), "pos": lone + j, "h": int(h[j]), "df": int(seen[j])} for j in range(now)]
            if many[i] > now:
                out.append({"kind": LATE, "n": size, "cls": c, "pos": lone + now, "h": int(many[i]) - now, "toks": mine[plain[i] :]})
            if len(out) > 5000:
                yield rows_of(schema, out)
                out = []
        if out:
            yield rows_of(schema, out)

    return run


def _late(batches):
    """Prefix rows of hot shingles, which come in their order with their frequencies."""
    schema = _arrow(LATER, pa.int64())
    for batch in batches:
        out: list[dict] = []
        for r in batch.to_pylist():
            h = _behind(np.array(r["toks"], np.int64))
            out += [{"cls": r["cls"], "n": r["n"], "token": r["toks"][j], "pos": r["pos"] + j, "h": int(h[j]), "df": r["dfs"][j]} for j in range(r["want"])]
        if out:
            yield rows_of(schema, out)


def _late_prefix(out: DataFrame) -> DataFrame:
    """Prefix rows of the sets whose prefix reaches into hot shingles, by these shingles' frequencies.

    The most common hot shingles, BROADCAST_HOT at most, are broadcast; of the others none has more owners than the
    share that leaves, so a join by shingle has no large group.
    """
    late = out.filter(F.col("kind") == LATE).select("cls", "n", "pos", F.col("h").cast("int").alias("want"), "toks")
    hot = out.filter(F.col("kind") == HOTS).select("token", "df")
    most = max(4096, (hot.agg(F.sum("df")).first()[0] or 0) // BROADCAST_HOT)
    common = F.broadcast(hot.filter(F.col("df") > most))
    each = late.select("cls", F.explode("toks").alias("token"))
    rest = each.join(common.select("token"), "token", "left_anti").join(hot.filter(F.col("df") <= most), "token")
    ranked = each.join(common, "token").unionByName(rest).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("r"))
    rows = late.drop("toks").join(ranked, "cls").select("cls", "n", "pos", "want", F.col("r.token").alias("toks"), F.col("r.df").alias("dfs"))
    return rows.mapInArrow(_late, LATER)


def _byte(h: str, i: int):
    return F.shiftrightunsigned(F.col(h), 16 * i).bitwiseAND(F.lit(0xFFFF))


def _pairs(left: DataFrame, right: DataFrame, on: list[str], percent: int, also=None) -> DataFrame:
    """Pairs (one, other), one < other, of a row x of left and y of right that agree on the columns `on` and pass the filters.

    x is the smaller set (of equal ones the one with the lesser number), whose first common shingle stands in its first
    n (100 - p) / (100 + p). also(x, y): what must hold besides.
    """
    a, b = left.filter(F.col("pos") * (100 + percent) <= F.col("n") * (100 - percent)).alias("x"), right.alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    short, long_ = F.least(x("n"), y("n")), F.greatest(x("n"), y("n"))
    length = short * 100 >= long_ * percent
    # overlap o of sizes n and m: 100 o >= p (n + m - o)
    need = (x("n") + y("n")) * percent
    position = F.least(x("n") - x("pos"), y("n") - y("pos")) * (100 + percent) >= need
    behind = F.lit(1)
    for i in range(4):
        behind = behind + F.least(_byte("x.h", i), _byte("y.h", i))
    suffix = (long_ >= 65535) | (behind * (100 + percent) >= need)
    ok = ((x("n") < y("n")) | ((x("n") == y("n")) & (x("cls") < y("cls")))) & length & position & suffix
    if also is not None:
        ok = ok & also(x, y)
    for c in on:
        ok = ok & (x(c) == y(c))
    return a.join(b, ok).select(F.least(x("cls"), y("cls")).alias("one"), F.greatest(x("cls"), y("cls")).alias("other")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each pair once, with link: whether it reaches the similarity."""
    a = sets.select(F.col("cls").alias("one"), F.col("n").alias("a_n"), F.col("toks").alias("a_toks"))
    b = sets.select(F.col("cls").alias("other"), F.col("n").alias("b_n"), F.col("toks").alias("b_toks"))
    both = pairs.join(a, "one").join(b, "other").withColumn("o", F.size(F.array_intersect("a_toks", "b_toks")))
    return both.select("one", "other", (F.col("o") * 100 >= (F.col("a_n") + F.col("b_n") - F.col("o")) * percent).alias("link"))


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Documents with their connected component under shingle Jaccard similarity >= percent / 100.

    Returns (id_col, n_shingles, component_id), one row for each row of docs; other columns of docs are not read.
    component_id is the least id of the component, the row's own included. Null and word-less texts have no shingles
    and link with nothing: component_id is their own id. Null ids get the component's least id that is not null, or
    null if it has none; repeated ids and repeated rows each get a row. An empty table gives an empty table.
    Shingles are compared by 64-bit fingerprints within a pair; sets whose 64-bit sums of fingerprints are equal count as equal.
    """
    joined = _labelled(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), width, percent)
    least = joined.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return joined.join(least, "label", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _labelled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, cls, label) for each row of docs (doc_id, text): label is the component's, null without shingles.

    doc_id is only passed through and may be of any type.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    id_type, id_arrow = docs.schema["doc_id"].dataType.simpleString(), _id_arrow(docs)
    wire, found = WIRE.replace("{id}", id_type), FOUND.replace("{id}", id_type)
    sent = docs.mapInArrow(_scan(width, parts, id_arrow), wire).repartitionById(parts, F.col("part")).sortWithinPartitions("bucket")
    back = sent.mapInArrow(_count(parts, id_arrow), wire).repartitionById(parts, F.col("part")).sortWithinPartitions("bucket")
    out = written(back.mapInArrow(_order(percent, id_arrow), found), "jaccard")

    members = out.filter(F.col("kind") == META).select("doc_id", "n", "cls")
    sets = out.filter(F.col("kind") == SET).select("cls", "n", "toks")
    prefix = out.filter(F.col("kind") == PREFIX).select("token", "cls", "n", "pos", "h", "df")
    if not out.filter(F.col("kind") == LATE).isEmpty():
        prefix = checkpointed(prefix.unionByName(_late_prefix(out)))
    wide = prefix.filter(F.col("df") > CHUNK)

    def chunked(rows: DataFrame, salt: int) -> DataFrame:
        dealt = rows.withColumn("chunk", _salt("cls", salt, F.ceil(F.col("df") / CHUNK)))
        return _pairs(dealt, dealt, ["token", "chunk"], percent)

    first = chunked(prefix, 0).union(chunked(wide, 1)).distinct()
    verified = checkpointed(_verified(first, sets, percent))
    links = verified.filter("link").select(F.col("one").alias("a"), F.col("other").alias("b"))

    # what chunks left out: shingles of more than one chunk whose owners aren't all connected yet
    known = components(links)
    labels = known.select(F.col("a").alias("cls"), "label")
    wide = wide.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    shares = wide.groupBy("token", "label").agg(F.count("*").alias("c"), F.max("df").alias("df"))
    torn = shares.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("k"), F.sum("c").alias("g"), F.max("df").alias("df")).filter("k > 1")
    by_df, by_g = (F.ceil(F.col(c) / SPLIT).cast("int") for c in ("df", "g"))
    torn = torn.select("token", "main", "g", F.explode(F.sequence(F.lit(0), by_df - 1)).alias("salt"))
    wide = wide.withColumn("salt", _salt("cls", 2, by_df)).join(torn, ["token", "salt"])
    wide = checkpointed(wide.withColumn("main", F.col("label") == F.col("main")).withColumn("salt", _salt("cls", 2, by_g)))
    # most owners of a common shingle are in one component by now: only the others look for partners, or are looked for
    others = wide.filter(~F.col("main")).drop("salt").withColumn("salt", F.explode(F.sequence(F.lit(0), by_g - 1)))
    apart = lambda x, y: x("label") != y("label")
    across = _pairs(others, wide, ["token", "salt"], percent, apart).union(_pairs(wide.filter("main"), others, ["token", "salt"], percent, apart)).distinct()
    across = across.join(verified.select("one", "other"), ["one", "other"], "left_anti")
    more = _verified(across, sets, percent).filter("link").select("one", "other")
    # these join components: the label of a document without links is itself
    ends = more.join(known.select(F.col("a").alias("one"), F.col("label").alias("x")), "one", "left").join(known.select(F.col("a").alias("other"), F.col("label").alias("y")), "other", "left")
    joins = components(ends.select(F.coalesce("x", "one").alias("a"), F.coalesce("y", "other").alias("b")))
    new = joins.join(known.select("a"), "a", "left_anti").unionByName(relabelled(known, joins))
    labels = checkpointed(new.select(F.col("a").alias("cls"), "label"))

    return members.join(labels, "cls", "left").select("doc_id", "n", "cls", F.coalesce("label", "cls").alias("label"))


def _salt(col: str, seed: int, many: Column) -> Column:
    return F.pmod(F.xxhash64(col, F.lit(seed)), many).cast("int")


def _id_arrow(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """docs without the rows whose component holds a lesser id. Columns are those of docs.

    Rows without shingles, with a null id, or that repeat the id which stays are kept. Rows are judged by id and text,
    told apart by a 64-bit hash of it: of an id that repeats with several texts, only those go that have a lesser copy.
    """
    key = F.xxhash64(F.col(text_col))
    row = f"struct<id:{docs.schema[id_col].dataType.simpleString()},key:bigint>"  # the cast lets key be null, as the wire format does
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), key.alias("key")).cast(row).alias("doc_id"), F.col(text_col).alias("text"))
    joined = _labelled(keyed, width, percent).select("label", F.col("doc_id.id").alias("_gone"), F.col("doc_id.key").alias("_key"))
    least = joined.groupBy("label").agg(F.min("_gone").alias("least"))
    dropped = checkpointed(joined.join(least, "label").filter(F.col("_gone") != F.col("least")).select("_gone", "_key").distinct())
    if docs.schema[id_col].dataType.simpleString() == "bigint" and dropped.count() <= BROADCAST_DROPPED:
        dropped = F.broadcast(dropped)  # texts stay where they are
    return docs.join(dropped, (F.col(id_col) == F.col("_gone")) & (key == F.col("_key")), "left_anti")
