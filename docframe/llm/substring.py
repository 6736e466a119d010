"""Substring dedup by recompression: words of passages that an earlier document holds are removed.

A text is a row of symbols, at first its words. A level renames them twice: each run of one symbol becomes one symbol,
named by the symbol and the run's length; then symbols are dealt to a left and a right side by a bit of their name's
hash, and a left one followed by a right one becomes one symbol, named by the two. Names follow from content, so equal
passages get equal names wherever they are; what stands around them decides only symbols near their ends. Each symbol
carries the words that decided it, `lo` to `hi`: in a window that holds these words, the symbol is there.

Each level is a Spark round that settles its names for the whole corpus: every flush of texts sends the names that it
made to the task of their range, once, and that task tells the owner of a name that no other document holds that the
name is alone. A window with a lone symbol occurs in one document, and goes no further; nor does a symbol made of a
lone one. After LEVELS rounds one more names, for each window that is left, its block: the words that decided its least
symbol of the highest level. Windows whose block is not alone are sent, words and all, to the block's task, and
compared there word for word. Hashes only leave windows out that can't be repeats; none decides that two are equal.

Texts are dealt once, by a hash of (id, text); all steps read that one exchange. Names travel as sorted numbers in
compressed blobs, in buckets that a task works through one at a time, with half of that hash, the tag, as address: texts
that share a tag are told of each other's lone names, which they don't hold. A name that several texts of a flush hold
is one entry of that flush without owners, so very common names gather no owners anywhere.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import M1, SAME, SPACES, U64, Words, buckets, flushes, mix, pack, powers, rows_of, runs, shuffle_parts, sized, trim, unpack, utf8

LEVELS = 2
#: Buckets for each partition; a task holds one at a time. Numbers that it gathers before it sends them on.
BUCKETS, HELD = 2, 1_000_000
#: Bits of a name that travel; fewer only make more names look shared.
NAME_BITS = 48
NONE = U64(0xFFFFFFFFFFFFFFFF)
POS = U64((1 << 24) - 1)
WIRE = "part int, bucket int, tok binary, own binary, tag binary, many binary"
WIRE_ARROW = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("tok", "own", "tag", "many"))])
BACK = "part int, tag binary, rk binary, own binary, found binary"
BACK_ARROW = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("tag", "rk", "own", "found"))])


# --- symbols -------------------------------------------------------------------------------------------------------


@dataclass
class Symbols:
    """The symbols of some texts in order: name, text, words lo to hi that decide it (None where no one asks), the
    symbols that this level made, and whether each is known to be in one document only."""

    name: np.ndarray
    text: np.ndarray
    lo: np.ndarray | None
    hi: np.ndarray | None
    made: np.ndarray
    alone: np.ndarray

    @classmethod
    def of(cls, words: Words, placed: bool) -> Symbols:
        n, at = len(words), np.arange(len(words))
        return cls(words.hash, words.text, at if placed else None, at + 1 if placed else None, np.zeros(0, np.int64), np.zeros(n, bool))

    def __len__(self) -> int:
        return len(self.name)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """lo of the symbol before and hi of the one behind; beyond any window at a text's ends."""
        n = len(self)
        lo, hi = np.full(n, -1), np.full(n, 1 << 62)
        lo[1:], hi[:-1] = self.lo[:-1], self.hi[1:]
        ends = np.flatnonzero(self.text[1:] != self.text[:-1])
        lo[ends + 1], hi[ends] = -1, 1 << 62
        return lo, hi


def name_runs(s: Symbols, salt: int) -> Symbols:
    """Each run of one symbol as one symbol. Both neighbours of a run decide where it ends."""
    if not len(s):
        return s
    heads = np.flatnonzero(np.concatenate([[True], (s.name[1:] != s.name[:-1]) | (s.text[1:] != s.text[:-1])]))
    many = np.diff(np.append(heads, len(s)))
    lo, hi = s.neighbours() if s.lo is not None else (None, None)
    name, made = s.name[heads], np.flatnonzero(many > 1)
    name[made] = mix((name[made] ^ U64(salt)) * M1 + many[made].astype(U64))
    return Symbols(name, s.text[heads], None if lo is None else lo[heads], None if hi is None else hi[heads + many - 1], made, s.alone[heads])


def name_pairs(s: Symbols, salt: int, bit: int) -> Symbols:
    """Each left symbol followed by a right one as one symbol. A lone left one looks behind it, a right one before it."""
    n = len(s)
    if not n:
        return s
    right = (s.name >> U64(bit)) & U64(1) == 1
    first = np.zeros(n, bool)
    first[:-1] = ~right[:-1] & right[1:] & (s.text[:-1] == s.text[1:])
    at = np.flatnonzero(first)
    keep = np.ones(n, bool)
    keep[at + 1] = False
    name, alone = s.name.copy(), s.alone.copy()
    name[at] = mix((s.name[at] ^ U64(salt)) * M1 + s.name[at + 1])
    alone[at] |= s.alone[at + 1]
    first[s.made] = True  # runs that this level made, unless they went into a pair
    made = np.flatnonzero(first[keep])
    if s.lo is None:
        return Symbols(name[keep], s.text[keep], None, None, made, alone[keep])
    before, behind = s.neighbours()
    lo, hi = np.where(right, before, s.lo), np.where(right, s.hi, behind)
    lo[at], hi[at] = s.lo[at], s.hi[at + 1]
    return Symbols(name[keep], s.text[keep], lo[keep], hi[keep], made, alone[keep])


def cut_name(name: np.ndarray, bits: int) -> np.ndarray:
    return name >> U64(64 - bits)


def levels_of(words: Words, upto: int, lone: np.ndarray, bits: int, placed: bool = True) -> list[Symbols]:
    """The symbols of each level. lone: sorted keys (name, text) of names that are known to be alone."""
    out, s = [], Symbols.of(words, placed)
    for level in range(upto):
        s = name_pairs(name_runs(s, 0x51ED27 + 2 * level), 0xA24BAE + 2 * level, 3 + level)
        if len(lone):
            s.alone[s.made] |= _among(_keys(cut_name(s.name[s.made], bits), s.text[s.made]), lone)
        out.append(s)
    return out


def _keys(name48: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A number for each (name, text of the flush)."""
    return (name48 << U64(16)) | text.astype(U64)


def _among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether each x is in the sorted numbers."""
    at = np.searchsorted(held, x)
    at[at == len(held)] = 0
    return held[at] == x


# --- windows -------------------------------------------------------------------------------------------------------


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def alive(words: Words, levels: list[Symbols], width: int) -> np.ndarray:
    """First words of the windows within a text that hold no lone symbol."""
    many = max(0, len(words) - width + 1)
    good = words.text[:many] == words.text[width - 1 :] if many else np.zeros(0, bool)
    for s in levels:
        bad = np.flatnonzero(s.alone)
        if many and len(bad):
            bad = bad[(s.lo[bad] >= 0) & (s.hi[bad] - s.lo[bad] <= width)]
            from_, to = np.maximum(s.hi[bad] - width, 0), np.minimum(s.lo[bad], many - 1)
            fits = from_ <= to
            step = np.bincount(from_[fits], minlength=many + 1) - np.bincount(to[fits] + 1, minlength=many + 1)
            good &= np.cumsum(step)[:many] == 0
    return np.flatnonzero(good)


def anchors(words: Words, s: Symbols, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows that begin at `at`: the words (lo, hi) that decide each one's anchor, its least symbol that it holds
    with all that decides it; the window itself where there is none, as within runs."""
    many = max(0, len(words) - width + 1)
    best = np.full(many, NONE, U64)
    inside = np.flatnonzero((s.lo >= 0) & (s.hi - s.lo <= width))
    value = (s.name[inside] & ~POS) | (np.arange(len(inside)).astype(U64) & POS)
    lo, hi = s.lo[inside], s.hi[inside]
    spare = width - (hi - lo)
    for k in range(width):  # symbols that k + 1 windows hold, the last of them the one that begins with lo
        mine = np.flatnonzero(spare == k)
        if len(mine):
            held = np.full(many + k, NONE, U64)
            np.minimum.at(held, lo[mine], value[mine])
            best = np.minimum(best, _slide(held, k + 1)[:many])
    best = best[at]
    own = best == NONE
    near = np.searchsorted(lo, at)  # the low bits count on from the first symbol that can be in the window
    which = near + ((best & POS).astype(np.int64) - near) % (1 << 24)
    which[own] = 0
    if not len(inside):
        return at, at + width
    return np.where(own, at, lo[which]), np.where(own, at + width, hi[which])


def block_names(words: Words, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Names of the blocks lo to hi: hashes of their words."""
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, U64)
    np.cumsum(mix(words.hash) * up[: len(words)], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(U64))


# --- rounds --------------------------------------------------------------------------------------------------------


def _place(token: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Number of the bucket of each token; buckets are ranges, BUCKETS to a part."""
    many = parts * BUCKETS
    return np.searchsorted(np.array([(i << bits) // many for i in range(1, many)], U64), token, "right")


def _columns(batch: pa.RecordBatch):
    """tag, rk, id, and whether the id is known."""
    ids = batch.column(2)
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)


TEXT = 3  # column of the text; those behind it hold names that are alone


def _known(batch: pa.RecordBatch) -> np.ndarray:
    """Sorted (name, text) keys from the columns behind the text."""
    out = [np.zeros(0, U64)]
    for c in range(TEXT + 1, batch.num_columns):
        for i, x in enumerate(batch.column(c)):
            if x.is_valid:
                out.append(_keys(unpack(x.as_py(), U64, True), np.full(1, i)))
    return np.sort(np.concatenate(out))


def _cuts(place: np.ndarray):
    """(a, b) of the runs of a sorted array."""
    cut = np.append(runs(place), len(place)).tolist()
    return zip(cut[:-1], cut[1:], strict=True)


def _sent(token: np.ndarray, owner: np.ndarray, tag: np.ndarray, rk: np.ndarray, parts: int, bits: int) -> list[dict]:
    """Rows that take the distinct names of a flush to their tasks: with their owner's tag, or, held by several texts, without."""
    order = np.lexsort((rk[owner], token))
    token, owner = token[order], owner[order]
    heads = runs(token)
    ends = np.append(heads[1:], len(token)) - 1
    many = rk[owner[heads]] != rk[owner[ends]]
    token, owner = token[heads], owner[heads]
    place = _place(token, parts, bits)
    out = []
    for a, b in _cuts(place):
        m = many[a:b]
        who, own = np.unique(owner[a:b][~m], return_inverse=True)
        p = int(place[a])
        out.append({"part": p // BUCKETS, "bucket": p % BUCKETS, "tok": pack(token[a:b][~m], True), "own": pack(own.astype(np.uint32)), "tag": pack(tag[who]), "many": pack(token[a:b][m], True)})
    return out


def _named(width: int, level: int, parts: int, bits: int):
    """The names that a round settles: the symbols that its level makes, or the blocks of windows."""

    def run(batches):
        for batch in flushes(batches, "text"):
            tag, rk, _, known = _columns(batch)
            words = Words(*utf8(batch.column(TEXT)), SAME, SPACES)
            levels = levels_of(words, min(level, LEVELS), _known(batch), bits, level > LEVELS)
            if level <= LEVELS:
                s = levels[-1]
                new = s.made[~s.alone[s.made] & known[s.text[s.made]]]
                token, owner = cut_name(s.name[new], bits), s.text[new]
            else:
                at = alive(words, levels, width)
                at = at[known[words.text[at]]]
                lo, hi = anchors(words, levels[-1], at, width)
                first = np.flatnonzero(np.diff(lo, prepend=-1) | np.diff(hi, prepend=-1))
                token, owner = cut_name(block_names(words, lo[first], hi[first]), bits), words.text[at[first]]
            if len(token):
                key = np.unique(_keys(token, owner))
                yield from sized(_sent(key >> U64(16), (key & U64(0xFFFF)).astype(np.int64), tag, rk, parts, bits), WIRE_ARROW)

    return run


def _to_owner(tag: np.ndarray, owner: np.ndarray, value: np.ndarray, parts: int, rk: np.ndarray | None = None) -> list[dict]:
    """Rows that take numbers to the partition of their owner, which its tag gives, or its tag and rk."""
    part = (tag.astype(np.int64) % parts)[owner]
    order = np.lexsort((value, part))
    part, owner, value = part[order], owner[order], value[order].astype(U64)
    out = []
    for a, b in _cuts(part):
        who, own = np.unique(owner[a:b], return_inverse=True)
        out.append({"part": int(part[a]), "tag": pack(tag[who]), "rk": None if rk is None else pack(rk[who]), "own": pack(own.astype(np.uint32)), "found": pack(value[a:b], True)})
    return out


def _lone(parts: int):
    """Names that one text sent once, to that text. Two texts of one tag are two entries, so their names aren't alone."""

    def alone(rows: list[dict]):
        tokens, owners, tags, many, at = [], [], [], [], 0
        for r in rows:
            tag = unpack(r["tag"], np.int32)
            tokens.append(unpack(r["tok"], U64, True))
            owners.append(unpack(r["own"], np.uint32).astype(np.int64) + at)
            tags.append(tag)
            many.append(unpack(r["many"], U64, True))
            at += len(tag)
        token, owner, tag = map(np.concatenate, (tokens, owners, tags))
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        heads = runs(token)
        one = np.diff(np.append(heads, len(token))) == 1
        one &= ~np.isin(token[heads], np.concatenate(many))
        return tag, owner[heads[one]], token[heads[one]]

    def run(batches):
        held: list[tuple] = []
        for rows in buckets(batches):
            held.append(alone(rows))
            if sum(len(x[2]) for x in held) >= HELD:
                yield from sized(_told(held, parts), BACK_ARROW)
                held = []
        if held:
            yield from sized(_told(held, parts), BACK_ARROW)
        trim()

    return run


def _told(held: list[tuple], parts: int) -> list[dict]:
    """_to_owner() of several buckets' (tag, owner, value[, rk]) at once."""
    before = np.cumsum([0, *(len(x[0]) for x in held)])
    owner = np.concatenate([x[1] + b for x, b in zip(held, before[:-1], strict=True)])
    rk = np.concatenate([x[3] for x in held]) if len(held[0]) > 3 else None
    return _to_owner(np.concatenate([x[0] for x in held]), owner, np.concatenate([x[2] for x in held]), parts, rk) if len(owner) else []


def _gather(batches):
    """A row for each tag: sorted numbers; of places, those of each rk."""
    schema = pa.schema([("tag", pa.int32()), ("found", pa.binary()), ("rks", pa.list_(pa.int64())), ("places", pa.list_(pa.binary()))])
    owners, tags, rks, values, at = [], [], [], [], 0
    for batch in batches:
        for r in batch.to_pylist():
            tag = unpack(r["tag"], np.int32)
            tags.append(tag)
            rks.append(np.zeros(len(tag), np.int64) if r["rk"] is None else unpack(r["rk"], np.int64))
            owners.append(unpack(r["own"], np.uint32).astype(np.int64) + at)
            values.append(unpack(r["found"], U64, True))
            at += len(tag)
            placed = r["rk"] is not None
    trim()
    if not tags:
        return
    tag, rk, owner, value = map(np.concatenate, (tags, rks, owners, values))
    both = np.empty(len(tag), [("tag", np.int32), ("rk", np.int64)])
    both["tag"], both["rk"] = tag, rk
    both, number = np.unique(both, return_inverse=True)
    owner = number[owner]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    rows: list[dict] = []
    for a, b in _cuts(owner):
        t, r = both[owner[a]].item()
        blob = pack(value[a:b], True)
        if not placed:
            rows.append({"tag": t, "found": blob, "rks": None, "places": None})
        elif rows and rows[-1]["tag"] == t:
            rows[-1]["rks"].append(r)
            rows[-1]["places"].append(blob)
        else:
            rows.append({"tag": t, "found": None, "rks": [r], "places": [blob]})
    yield from sized(rows, schema)


# --- comparison ----------------------------------------------------------------------------------------------------


def _passages(width: int, parts: int, bits: int):
    """Windows whose block is not alone, with their words: those that follow each other with one anchor of the first
    level, which is in more windows than one of the highest, are one passage.

    A passage that several texts of a flush hold goes on from the least id only; the others' windows are repeats.
    """

    def run(batches):
        for batch in flushes(batches, "text"):
            tag, rk, ids, known = _columns(batch)
            data, off = utf8(batch.column(TEXT))
            words = Words(data, off, SAME, SPACES)
            lone = _known(batch)
            levels = levels_of(words, LEVELS, lone, bits)
            at = alive(words, levels, width)
            at = at[known[words.text[at]]]
            if len(lone) and len(at):
                lo, hi = anchors(words, levels[-1], at, width)
                at = at[~_among(_keys(cut_name(block_names(words, lo, hi), bits), words.text[at]), lone)]
            if not len(at):
                continue
            lo, hi = anchors(words, levels[0], at, width)
            first = np.flatnonzero(np.diff(lo, prepend=-1) | np.diff(hi, prepend=-1) | (np.diff(at, prepend=-1) != 1))
            n_windows = np.diff(np.append(first, len(at)))
            at, place = at[first], _place(cut_name(block_names(words, lo[first], hi[first]), bits), parts, bits)
            owner = words.text[at]
            plain = b" ".join(b" ".join(data[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)).split())
            size = words.end - words.start
            start = np.concatenate([[0], np.cumsum(size + 1)])
            last = at + n_windows + width - 2
            texts = [plain[a:b] for a, b in zip(start[at].tolist(), (start[last] + size[last]).tolist(), strict=True)]
            number: dict[bytes, int] = {}
            same = np.array([number.setdefault(t, len(number)) for t in texts])
            least = np.full(len(number), np.iinfo(np.int64).max)
            np.minimum.at(least, same, ids[owner])
            later = ids[owner] > least[same]
            pos = at - words.first[owner]
            if later.any():
                yield from sized(_spread(tag, rk, owner[later], pos[later], n_windows[later], parts), _CUT_ARROW)
            # identical rows of a flush send a passage once
            on = np.flatnonzero(~later)
            on = on[np.sort(np.unique(np.rec.fromarrays([rk[owner[on]], pos[on]]), return_index=True)[1])]
            on = on[np.argsort(place[on], kind="stable")]
            rows = []
            for a, b in _cuts(place[on]):
                mine = on[a:b]
                who, own = np.unique(owner[mine], return_inverse=True)
                joined = b"\n".join([texts[i] for i in mine.tolist()])
                p = int(place[mine[0]])
                rows.append(
                    {"part": p // BUCKETS, "bucket": p % BUCKETS, "own": pack(own.astype(np.uint32)), "tag": pack(tag[who]), "rk": pack(rk[who]), "id": pack(ids[who]), "pos": pack(pos[mine].astype(np.uint32)), "words": zstandard.ZstdCompressor(level=3, write_content_size=True).compress(joined), "gone": None}
                )
            yield from sized(rows, _CUT_ARROW)

    return run


_CUT = "part int, bucket int, own binary, tag binary, rk binary, id binary, pos binary, words binary, gone binary"
_CUT_ARROW = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("own", "tag", "rk", "id", "pos", "words", "gone"))])


def _spread(tag, rk, owner, pos, n_windows, parts: int) -> list[dict]:
    """Rows that take the places of windows to the partition of their owner; they pass the comparison by."""
    owner = np.repeat(owner, n_windows)
    each = np.repeat(pos - np.concatenate([[0], np.cumsum(n_windows)[:-1]]), n_windows) + np.arange(int(n_windows.sum()))
    return [{"part": r["part"], "bucket": BUCKETS, "own": r["own"], "tag": r["tag"], "rk": r["rk"], "id": None, "pos": None, "words": None, "gone": r["found"]} for r in _to_owner(tag, owner, each, parts, rk)]


def _compare(width: int, parts: int):
    """Places of windows whose words an earlier id holds too, to their owners. Windows are compared as texts."""

    def plain(batches, back: list):
        for batch in batches:
            gone = batch.column("gone").is_valid()
            if gone.true_count:
                ready = batch.filter(gone)
                back.append(pa.RecordBatch.from_arrays([ready.column(c) for c in ("part", "tag", "rk", "own", "gone")], schema=BACK_ARROW))
            yield batch.filter(pa.compute.invert(gone))

    def compared(rows: list[dict]):
        held: dict[bytes, list[tuple[int, int, int]]] = {}
        tags, rks, at = [], [], 0
        for r in rows:
            rk, ids = unpack(r["rk"], np.int64), unpack(r["id"], np.int64)
            own = unpack(r["own"], np.uint32).astype(np.int64)
            texts = zstandard.ZstdDecompressor().decompress(r["words"]).split(b"\n")
            for t, *of in zip(texts, ids[own].tolist(), (own + at).tolist(), unpack(r["pos"], np.uint32).tolist(), strict=True):
                held.setdefault(t, []).append(of)
            tags.append(unpack(r["tag"], np.int32))
            rks.append(rk)
            at += len(rk)
        least: dict[bytes, int] = {}
        windows = {}
        for t, found in held.items():
            first = min(found)[0]
            w = t.split(b" ")
            windows[t] = mine = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]
            for x in mine:
                if (old := least.get(x)) is None or first < old:
                    least[x] = first
        owner, pos = [], []
        for t, found in held.items():
            before = [least[x] for x in windows[t]]
            most = max(found)[0]
            if min(before) < most:
                for d, o, p in found:
                    later = [p + i for i, x in enumerate(before) if x < d]
                    owner += [o] * len(later)
                    pos += later
        return np.concatenate(tags), np.array(owner, np.int64), np.array(pos, np.int64), np.concatenate(rks)

    def run(batches):
        back: list[pa.RecordBatch] = []
        held: list[tuple] = []
        for rows in buckets(plain(batches, back)):
            held.append(compared(rows))
            if sum(len(x[2]) for x in held) >= HELD:
                yield from sized(_told(held, parts), BACK_ARROW)
                held = []
            yield from back
            back.clear()
        if held:
            yield from sized(_told(held, parts), BACK_ARROW)
        yield from back
        trim()

    return run


def _cut(width: int, with_text: bool):
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept_text", pa.string())] if with_text else [])])

    def run(batches):
        for batch in batches:
            rows = []
            data, off = utf8(batch.column(2))
            ids = batch.column(1).to_pylist()
            for i, (rk, rks) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = data[off[i] : off[i + 1]].tobytes().split()
                n = len(words)
                if rks and rk in rks:
                    step = np.zeros(n + 1, np.int64)
                    at = np.unique(unpack(batch.column(4)[i][rks.index(rk)].as_py(), U64, True).astype(np.int64))
                    np.add.at(step, at, 1)
                    np.add.at(step, at + width, -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                kept = b" ".join(words)
                row = {"id": ids[i], "n_words": n, "n_removed": n - len(words), "kept_sha256": hashlib.sha256(kept).hexdigest()}
                rows.append(row | ({"kept_text": kept.decode("utf-8", "replace")} if with_text else {}))
                if len(rows) == 2000:
                    yield rows_of(schema, rows)
                    rows = []
            if rows:
                yield rows_of(schema, rows)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, with_text: bool = False, name_bits: int = NAME_BITS) -> DataFrame:
    """Removes every word that a window of `width` words covers which also starts in a document with a smaller id.

    Returns a row for each row of docs: (id_col, n_words, n_removed, kept_sha256[, kept_text]); the kept words are
    joined by one space. Other columns are not read. id_col must be integral (else ValueError). Null and word-less texts
    have no words; rows with a null id neither remove nor lose words; rows that share an id don't remove each other's;
    windows repeated within a document stay unless an earlier document holds them. An empty table gives an empty table.
    width is 13 or more, so that a window holds symbols of the highest level. name_bits, 48 at most, changes the cost only.
    """
    if width < 13:
        raise ValueError("width must be 13 or more")
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be integral")
    parts = shuffle_parts(docs.sparkSession)
    rk = F.xxhash64(id_col, text_col)
    x = docs.select(F.shiftrightunsigned(rk, 33).cast("int").alias("tag"), rk.alias("rk"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartition(parts, "tag")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartitionById(parts, F.col("part"))

    def back(df: DataFrame) -> DataFrame:
        """What came back, a row for each tag."""
        return dealt(df).mapInArrow(_gather, "tag int, found binary, rks array<long>, places array<binary>")

    state = x
    for level in range(1, LEVELS + 2):
        sent = dealt(state.mapInArrow(_named(width, level, parts, name_bits), WIRE)).sortWithinPartitions("bucket")
        lone = back(sent.mapInArrow(_lone(parts), BACK)).select("tag", F.col("found").alias(f"lone{level}"))
        state = state.join(lone.hint("shuffle_hash"), "tag", "left")
    sent = dealt(state.mapInArrow(_passages(width, parts, name_bits), _CUT)).sortWithinPartitions("bucket")
    places = back(sent.mapInArrow(_compare(width, parts), BACK)).select("tag", "rks", "places")
    out = x.join(places.hint("shuffle_hash"), "tag", "left").select("rk", "id", "text", "rks", "places")
    made = out.mapInArrow(_cut(width, with_text), "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))
    return made.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *made.columns[1:])
