"""Secret scans: multipart credential linking.

Strong findings (``assign``, ``access``, ``hex``) stand alone. Weak candidates
are parts of a credential: identifiers (``id``: user, login, account, client or
key ids, their names in any case, and mail addresses), keys (``key``: mixed runs
of 20 or more letters and digits, high in entropy, bare or behind ``NAME=``) and
endpoints (``endpoint``: URLs, host names with ports, IPv4 addresses). Parts are
linked by an interval join inside a scope, a line block (text between blank lines);
with ``reach`` they are also at most so many code points apart, by default anywhere in
the block. A weak candidate is reported only if it is linked to complementary parts: a
key needs an identifier or an endpoint, these need a secret (a linked key, or a strong
finding that is no access identifier).

Defined results: a null or empty text has no spans; repeated rows are scanned
each; very long texts are swept in linear time (each run of characters is read a
bounded number of times, links come from sorted starts and running ends), no pair
list is kept; of overlapping endpoints (or identifiers) the one that starts first
counts, of those the first form listed; extra columns are ignored.

Scale: documents are independent; there is no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

# The patterns of the base findings and of the weak parts.
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMED = re.compile(r"""(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Kk][Ee][Yy]_?[Ii][Dd])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""")
MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
URL = re.compile(r"[a-z][a-z0-9+]{1,9}://[^\s\"'<>]++")
IPV4 = re.compile(r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{2,5})?\b")
PORT = re.compile(r"(?<![a-z0-9.-])[a-z0-9.-]++(?=:[0-9]{2,5}\b)")
HOST = re.compile(r"\b(?:[a-z0-9-]++\.)++[a-z]{2,}:[0-9]{2,5}\b")
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
STRONG = KINDS[:3]
ENTROPY = 3.5


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def weak_parts(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "key") for m in KEY.finditer(text) if _mixed(m[0])]
    if ":" in text or "=" in text or "@" in text:
        mails = (m.span() for m in MAIL.finditer(text)) if "@" in text else ()
        found += [(*m, "id") for m in _leftmost((m.span() for m in NAMED.finditer(text)), mails)]
    if ":" in text or "." in text:
        urls = (m.span() for m in URL.finditer(text)) if "://" in text else ()
        found += [(*m, "endpoint") for m in _leftmost(urls, (m.span() for m in IPV4.finditer(text)), _hosts(text))]
    return found


def _leftmost(*forms) -> Iterator[tuple[int, int]]:
    """Spans that do not overlap, the first to start first; ties by form."""
    at = 0
    for s, _, e in sorted((s, k, e) for k, spans in enumerate(forms) for s, e in spans):
        if s >= at:
            yield s, e
            at = e


def _hosts(text: str) -> Iterator[tuple[int, int]]:
    """Host names with ports: a run of their characters before a port is read once;
    the name starts behind its last empty label, at a word's edge."""
    if ":" not in text:
        return
    for m in PORT.finditer(text):
        start, end = m.span()
        run = m[0]
        last = run.rpartition(".")[2]
        if "." in run and len(last) > 1 and last.isalpha():
            empty = run.rfind("..")
            start += empty + 2 if empty >= 0 else run.startswith(".")
            if h := HOST.search(text, start, end + 6):
                yield h.span()


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= ENTROPY


def _scopes(text: str) -> list[int]:
    """Starts of the blocks between blank lines."""
    return [0, *(m.end() for m in re.finditer(r"\n[ \t]*\n", text))]


class Parts:
    """Sorted parts, for interval joins: whether any is at most ``reach`` away from a
    span, in the same scope. No part goes over the end of a line, so none leaves its
    scope; the largest end so far in the scope tells of all that start in time."""

    def __init__(self, spans: list, blocks: list[int], reach: float):
        self.reach = reach
        self.blocks, self.starts, self.ends, block = blocks, [s for s, _, _ in spans], [], 0
        for s, e, _ in spans:
            own = bisect_right(blocks, s)
            self.ends.append(max(self.ends[-1], e) if self.ends and own == block else e)
            block = own

    def near(self, span) -> bool:
        own = bisect_right(self.blocks, span[0])
        begin = self.blocks[own - 1]
        end = self.blocks[own] if own < len(self.blocks) else math.inf
        k = bisect_right(self.starts, min(span[1] + self.reach, end - 1)) - 1
        return k >= 0 and self.starts[k] >= begin and self.ends[k] + self.reach >= span[0]


def scan(text: str | None, reach: float = math.inf) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) by start, then kind as listed; code points, end exclusive."""
    if not text:
        return []
    base = base_spans(text)
    weak = weak_parts(text)
    kinds = {w[2] for w in weak}
    if weak and (base or "key" in kinds and len(kinds) > 1):
        blocks = _scopes(text)
        covered = sorted(base)
        ends = _running(covered)
        begins = [s for s, _, _ in covered]
        # A weak part inside a strong finding is that finding.
        weak = [w for w in weak if not (i := bisect_left(begins, w[1])) or ends[i - 1] <= w[0]]
        others = Parts(sorted([w for w in weak if w[2] != "key"] + [b for b in base if b[2] == "access"]), blocks, reach)
        keys = [w for w in weak if w[2] == "key" and others.near(w)]
        hidden = Parts(sorted(keys + [b for b in base if b[2] != "access"]), blocks, reach)
        base = base + keys + [w for w in weak if w[2] != "key" and hidden.near(w)]
    return sorted(base, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _running(spans: list) -> list[int]:
    out, top = [], 0
    for _, e, _ in spans:
        top = max(top, e)
        out.append(top)
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [scan(t) for t in b.column(1).to_pylist()]
        kinds = [Counter(k for _, _, k in f) for f in found]
        yield pa.record_batch(
            [
                b.column(0),
                *[pa.array([k[x] for k in kinds], pa.int64()) for x in STRONG],
                pa.array([hashlib.sha256(joined(s for s in f if s[2] in STRONG).encode()).hexdigest() for f in found]),
                pa.array([joined(f) for f in found], pa.string()),
                pa.array([sum(k[x] for x in KINDS[3:]) for k in kinds], pa.int64()),
            ],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked per row."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return docs.mapInArrow(_scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def redact(text: str | None) -> str | None:
    """Each span replaced by [kind]; overlapping spans become one."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{k}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op7_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All columns, with the spans in text replaced; n_chars follows where it is there."""
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [redact(t) for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if chars is not None:
                was = b.column(chars).to_pylist()
                columns[chars] = pa.array([n if a == b_ else len(b_) for n, a, b_ in zip(was, old, new)], b.schema.field(chars).type)
            yield pa.record_batch(columns, schema=b.schema)

    return docs.mapInArrow(clean, docs.schema)
