"""Secret scans with multipart credential linking.

Base findings are assignments, access identifiers and long hexadecimal runs, by pattern. Weaker candidates - account
names, mixed tokens, endpoints - mean nothing alone. Within a text, the parts are intervals in order of place; each is
widened by `reach` code points but not past its paragraph, and a sweep joins intervals that meet. A weak
candidate is reported only when parts of both other roles, or a strong part of another role, stand in its scope.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flushes, utf8

# The patterns of the base kinds, in their order.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "account", "mixed", "endpoint")
IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"
ROLE = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET, "account": IDENTIFIER, "mixed": SECRET, "endpoint": ENDPOINT}
STRONG = {"assign", "access", "hex"}

ACCOUNT = re.compile(r"""(?ai:client_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""")
MIXED = re.compile(r"[A-Za-z0-9+/_-]{32,}")
ENDPOINT_AT = re.compile(r"""(?ai:https?|jdbc:\w+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[A-Za-z0-9._~:@-]+""")
REACH = 200
#: What a text must contain, in lower case, for a pattern to be tried.
ASSIGN_HAS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_hex_runs = bytes(0x78 if b in b"0123456789abcdef" else 0x20 for b in range(256))


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind."""
    out = []
    low = raw.lower()
    if any(k in low for k in ASSIGN_HAS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if b"x" * 24 in raw.translate(_hex_runs):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def linked(text: str, base: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """Weak candidates whose scope holds their complement. Candidates that overlap a base span don't count."""
    weak = [(m.start(), m.end(), kind) for kind, pattern in (("account", ACCOUNT), ("endpoint", ENDPOINT_AT)) for m in pattern.finditer(text)]
    weak += [(m.start(), m.end(), "mixed") for m in MIXED.finditer(text) if all(any(f(c) for c in m[0]) for f in (str.isdigit, str.isupper, str.islower))]
    if not weak:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[\x20\t]*\n", text)]
    parts = sorted([(s, e, k, True) for s, e, k in base] + [(s, e, k, False) for s, e, k in weak])
    out, open_, i, seen = [], [], 0, 0
    clear, last = [], -1
    for p in parts:  # a weak part under a base part is that part
        if p[3]:
            last = max(last, p[1])
            while clear and not clear[-1][3] and clear[-1][1] > p[0]:
                clear.pop()
        elif p[0] < last:
            continue
        clear.append(p)
    # open_: parts whose widened interval still meets the one at hand; scopes end at blank lines
    met: list[set] = [set() for _ in clear]
    for n, (s, _, k, strong) in enumerate(clear):
        while i < len(breaks) and breaks[i] < s:
            i += 1
        if i != seen:
            open_, seen = [], i
        open_ = [m for m in open_ if clear[m][1] + reach >= s]
        for m in open_:  # as many as parts fit into the reach
            met[n].add((ROLE[clear[m][2]], clear[m][3]))
            met[m].add((ROLE[k], strong))
        open_.append(n)
    for n, (s, e, k, strong) in enumerate(clear):
        if not strong:
            others = {r for r, _ in met[n] if r != ROLE[k]}
            if len(others) == 2 or any(is_strong for r, is_strong in met[n] if r != ROLE[k]):
                out.append((s, e, k))
    return out


def scan(text: str, raw: bytes, reach: int = REACH) -> tuple[list, list]:
    base = base_spans(text, raw)
    low = raw.lower()
    weak = b"://" in raw or any(k in low for k in (b"client", b"account", b"user", b"login")) or (base and len(raw) >= 32)
    return base, linked(text, base, reach) if weak else []


def _run(reach: int):
    schema = pa.schema([("text_n", pa.int64()), ("base", pa.list_(_SPAN)), ("found", pa.list_(_SPAN))])

    def run(batches):
        for batch in flushes(batches, "text"):
            data, off = utf8(batch.column(1))
            base, found = [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                raw = data[a:b].tobytes()
                x, y = scan(raw.decode("utf-8", "replace"), raw, reach) if raw else ([], [])
                base.append([{"kind": k, "start": s, "end": e} for s, e, k in x])
                found.append([{"kind": k, "start": s, "end": e} for s, e, k in sorted([*x, *y], key=lambda s: (s[0], KINDS.index(s[2])))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, schema.field("base").type), pa.array(found, schema.field("found").type)], names=["id", "base", "found"])

    return run


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(id_col, base, found): arrays of (kind, start, end) in code points, end exclusive; found is base and linked spans.

    A row for each row of docs; other columns are not read. Null texts are empty ones. Texts are scanned whole and
    each in its own row, so nothing is shuffled and a repeated text is found again in each row.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(_run(reach), f"id {rows.schema['id'].dataType.simpleString()}, base {span}, found {span}").withColumnRenamed("id", id_col)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query returns, from find_secrets()."""
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    n = {f"n_{k}": count(k) for k in ("assign", "access", "hex")}
    return found.withColumns(n | {"base_sha256": F.sha2(_joined(F.col("base")), 256), "spans": _joined(F.col("found"))}).drop("base", "found")
