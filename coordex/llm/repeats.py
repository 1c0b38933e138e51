"""Suffix-array deduplication: common-prefix interval tree over an enhanced
suffix array.

Texts are whole UTF-8 byte strings, gathered into compressed batches. Suffixes
that can begin a repeat of ``LENGTH`` bytes are routed to the place where they
are sorted: of the 32-byte grams in each 100-byte window the least by hash is
its anchor, so equal windows have equal anchors. Windows in a row with one
anchor form a run; only runs whose anchor occurs elsewhere travel on, with the
bytes they cover. There, equal runs are folded, and the others get a suffix array
(prefix doubling up to the run's end, which sorts before any byte) with its
common-prefix lengths. A stack scan gives the intervals of the common-prefix
tree, children first. Of an interval's suffixes the one that starts first
(smaller doc_id, then earlier start) leads; each child's leader that loses the
lead is an occurrence of that interval's repeat. Intervals whose suffixes all
have the same byte to their left are left out: the same repeat, one byte longer,
is found one place to the left.

A run is shorter than many repeats, so the occurrences come back to their batch
and are joined there: neighbours that point to one leader at one distance are one
occurrence, as long as they overlap. What they cover is removed (``remove_repeats``).

Whole groups of maximal repeats (``repeat_occurrences``, ``maximal_repeats``) need every
occurrence of an interval, not its leader alone, and a passage in a third of all documents
would bring them all to one suffix array. So they are put together from classes of equal
windows (128-bit hashes of the windows of shared anchors), counted with map-side combination. A
class whose windows have different bytes before or after them ends a unit: a stretch that
is the same wherever one of its windows occurs. A maximal repeat is a row of whole units,
as the left and right tests of the interval tree hold at units' edges alone. Rows of
units grow from 1 to 2-3, 4-7 ... units a round, as long as they occur more than once
and differ to their left; those that also differ to their right are the groups. The
rounds are the logarithm of the most units in one repeat, and a round makes at most twice as many
rows as it has proved. The groups of many near copies are as many as the pairs of places
where the copies part, which no method that lists them avoids; the query asks for the
bytes removed only.

Defined results: a null or empty text has no bytes; matches never cross
documents; where doc_id repeats, rows are ordered as they were read; null doc_ids
come first; a text of any length is handled in one batch of its own; an empty
table gives an empty table; extra columns are ignored. In groups every row's occurrences
count, also those of rows with one doc_id; a text's begin and end differ from all else.

Scale: the batches are written once and dealt out once, as Zstandard frames of
about ``BATCH`` bytes; anchors are 8 bytes each and unique within a batch, runs
unique within a batch, so a passage that a third of all documents share is sent
once a batch. If an anchor occurs in more than ``HOT`` batches, its runs are
folded in ``SALTS`` parts before they meet. The number of sorting places grows
with the input; nothing but its size is sent to the driver.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted_join, table

LENGTH, GRAM = 100, 32
BATCH = 2 << 20
POS = np.uint64((1 << 31) - 1)
_RNG = np.random.default_rng(5)
SUBST = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
HOT, SALTS = 4096, 64
RUN = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("pos", "<i8"), ("at", "<i8"), ("n", "<i4")])
#: An occurrence: where it starts in its batch, how long it is, where its leader
#: starts. A leader in the same batch is told by its place there (doc is LOCAL).
MARK = np.dtype([("at", "<i8"), ("n", "<i8"), ("doc", "<i8"), ("pos", "<i8")])
NULL_ID, LOCAL = -(1 << 63), -(1 << 63) + 1
ROUTED = "place long, batch_id long, blob binary"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place on, by doubling."""
    h, step = SUBST[data], 1
    while step < GRAM:
        h = h[:-step] * np.uint64(pow(BASE, step, 1 << 64)) + h[step:]
        step *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each run, in order."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    able = lengths >= length
    if not able.any():
        return none
    h = gram_hashes(data)
    m = (h & ~POS) | np.arange(len(h), dtype=np.uint64)
    width, step = length - GRAM + 1, 1
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if width > step:
        m = np.minimum(m[: -(width - step)], m[width - step :])
    anchor = (m & POS).astype(np.int64)
    valid = np.zeros(len(anchor) + 1, np.int32)
    np.add.at(valid, starts[able], 1)
    np.add.at(valid, starts[able] + lengths[able] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    a = anchor[at]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)]))
    n = np.diff(np.concatenate([first, [len(at)]]))
    return h[a[first]], at[first], n


# ---- batches of texts


def _batches_to(limit: int):
    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, z, count = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3), 0
        held, size = [], 0

        def out():
            held.sort(key=lambda r: (r[0] is not None, r[0] or 0))
            joined = b"".join(r[1] for r in held)
            return pa.record_batch(
                [pa.array([part + count]), pa.array([len(joined)]), pa.array([z.compress(joined)], pa.binary()), pa.array([[r[0] for r in held]], pa.list_(pa.int64())), pa.array([[len(r[1]) for r in held]], pa.list_(pa.int64()))],
                ["batch_id", "n_bytes", "z", "doc_ids", "lengths"],
            )

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if held and size + len(data) > limit:
                    yield out()
                    held, size, count = [], 0, count + 1
                held.append((doc_id.as_py(), data))
                size += len(data)
        if held:
            yield out()

    return batched


def batches_of(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(_batches_to(BATCH), "batch_id long, n_bytes long, z binary, doc_ids array<long>, lengths array<long>"), "repeat-batches")


def _opened(row: dict) -> tuple[bytes, np.ndarray, np.ndarray, list]:
    data = zstandard.ZstdDecompressor().decompress(row["z"], max_output_size=max(1, row["n_bytes"]))
    lengths = np.array(row["lengths"], np.int64)
    return data, np.cumsum(lengths) - lengths, lengths, row["doc_ids"]


# ---- which anchors occur more than once


def _anchors_by(places: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                data, starts, lengths, _ = _opened(row)
                hashes = runs(np.frombuffer(data, np.uint8), starts, lengths)[0]
                if not len(hashes):
                    continue
                unique, times = np.unique(hashes, return_counts=True)
                place = (unique % np.uint64(places)).astype(np.int64)
                order = np.lexsort((times > 1, place))
                unique, place, times = unique[order], place[order], times[order]
                cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                ends = np.concatenate([cuts[1:], [len(place)]])
                yield pa.record_batch(
                    [
                        pa.array(place[cuts], pa.int32()),
                        pa.array(np.full(len(cuts), row["batch_id"])),
                        pa.array(np.add.reduceat((times > 1).astype(np.int64), cuts), pa.int32()),
                        pa.array([unique[s:e].tobytes() for s, e in zip(cuts, ends)], pa.binary()),
                    ],
                    ["place", "batch_id", "several", "hashes"],
                )

    return fn


def _shared_by(hot_from: int):
    def shared(group: pa.Table) -> pa.Table:
        """Of each batch the anchors that occur elsewhere, hot ones last."""
        parts = [np.frombuffer(x.as_py(), "<u8") for x in group.column("hashes")]
        several = group.column("several").to_numpy()
        everything = np.concatenate(parts)
        weight = np.concatenate([np.where(np.arange(len(p)) >= len(p) - k, 2, 1) for p, k in zip(parts, several)])
        _, inverse, batches = np.unique(everything, return_inverse=True, return_counts=True)
        common, hot = (np.bincount(inverse, weight) > 1)[inverse], (batches > hot_from)[inverse]
        ends = np.cumsum([len(p) for p in parts])
        out = {"batch_id": [], "hashes": [], "hot": []}
        for b, p, e in zip(group.column("batch_id").to_pylist(), parts, ends.tolist()):
            mine = slice(e - len(p), e)
            cold, warm = p[common[mine] & ~hot[mine]], p[common[mine] & hot[mine]]
            if len(cold) or len(warm):
                out["batch_id"].append(b)
                out["hashes"].append(np.concatenate([cold, warm]).tobytes())
                out["hot"].append(len(warm))
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.binary(), pa.int32()))], list(out))

    return shared


# ---- the runs of those anchors, with the bytes they cover


def _blob(rec: np.ndarray, texts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(rec)) + rec.tobytes() + b"".join(texts))


def _opened_runs(blob: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k = struct.unpack_from("<q", raw)[0]
    rec, at = np.frombuffer(raw, RUN, k, 8), 8 + k * RUN.itemsize
    ends = at + np.cumsum(rec["n"].astype(np.int64) + LENGTH - 1)
    return rec, [raw[s:e] for s, e in zip([at, *ends[:-1].tolist()], ends.tolist())]


def _mark_rows(batch: np.ndarray, marks: np.ndarray) -> list[tuple[int, int, bytes]]:
    """A row a batch: marks have the place -1."""
    order = np.lexsort((marks["at"], batch))
    batch, marks = batch[order], marks[order]
    cuts = np.flatnonzero(np.concatenate([[True], batch[1:] != batch[:-1]])).tolist() if len(batch) else []
    z = zstandard.ZstdCompressor(level=1)
    return [(-1, int(batch[s]), z.compress(marks[s:e].tobytes())) for s, e in zip(cuts, [*cuts[1:], len(batch)])]


def _table(rows: list[tuple], kinds: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], schema=kinds) if rows else kinds.empty_table()


ROUTES = pa.schema([("place", pa.int64()), ("batch_id", pa.int64()), ("blob", pa.binary())])


def _runs_by(places: int, salts: int):
    """The runs of common anchors, a row a place; equal runs of the batch are
    marked here and sent once. Hot anchors have places of their own, SALTS each."""

    def fn(batch: pa.Table, replies: pa.Table) -> pa.Table:
        if not batch.num_rows or not replies.num_rows:
            return ROUTES.empty_table()
        row = batch.to_pylist()[0]
        data, starts, lengths, ids = _opened(row)
        hashes, at, n = runs(np.frombuffer(data, np.uint8), starts, lengths)
        parts = [np.frombuffer(x.as_py(), "<u8") for x in replies.column("hashes")]
        warm = np.concatenate([p[len(p) - k :] for p, k in zip(parts, replies.column("hot").to_pylist())])
        pick = np.flatnonzero(np.isin(hashes, np.concatenate(parts)))
        hashes, at, n = hashes[pick], at[pick], n[pick]
        doc = np.searchsorted(starts, at, "right") - 1
        seen: dict[bytes, int] = {}
        first, again, lead = [], [], []
        for i, (s, k) in enumerate(zip(at.tolist(), n.tolist())):
            j = seen.setdefault(data[s : s + k + LENGTH - 1], i)
            if j == i:
                first.append(i)
            else:
                again.append(i)
                lead.append(j)
        marks = np.zeros(len(again), MARK)
        marks["at"], marks["n"], marks["doc"], marks["pos"] = at[again], n[again] + LENGTH - 1, LOCAL, at[lead]
        out = _mark_rows(np.full(len(again), row["batch_id"]), marks)
        first = np.array(first, np.int64)
        place = (hashes[first] % np.uint64(places)).astype(np.int64)
        hot = np.isin(hashes[first], warm)
        place[hot] = places + place[hot] * salts + row["batch_id"] % salts
        order = np.argsort(place, kind="stable")
        first, place = first[order], place[order]
        rec = np.zeros(len(first), RUN)
        ids = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        rec["hash"], rec["doc"], rec["row"], rec["pos"], rec["at"], rec["n"] = hashes[first], ids[doc[first]], doc[first], at[first] - starts[doc[first]], at[first], n[first]
        cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else []
        for s, e in zip(cuts, [*cuts[1:], len(place)]):
            texts = [data[a : a + k + LENGTH - 1] for a, k in zip(rec["at"][s:e].tolist(), rec["n"][s:e].tolist())]
            out.append((int(place[s]), row["batch_id"], _blob(rec[s:e], texts)))
        return _table(out, ROUTES)

    return fn


# ---- enhanced suffix array


def suffix_array(data: np.ndarray, places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their first ``length`` bytes (ties by place) and
    ranks that are equal where those bytes are; by prefix doubling."""
    word = np.zeros(max(0, len(data) - 7), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | data[k : k + len(word)].astype(np.uint64)
    rank, step = np.unique(word, return_inverse=True)[1].astype(np.int64), 8
    while 2 * step <= length:
        key = rank[:-step] * np.int64(len(data) + 1) + rank[step:]
        rank, step = np.unique(key, return_inverse=True)[1].astype(np.int64), 2 * step
    over = length - step
    ends = np.minimum(places + over, len(rank) - 1)
    key = rank[places] * np.int64(len(data) + 1) + (rank[ends] if over else 0)
    ranks = np.unique(key, return_inverse=True)[1]
    order = np.lexsort((places, ranks))
    return places[order], ranks[order]


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, counted up to where
    either run of bytes ends (``most`` bytes at most)."""
    lcp = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    room = np.minimum(limit[:-1] - a, limit[1:] - b)
    live = np.flatnonzero(room > 0)
    while len(live):
        same = data[a[live] + lcp[live + 1]] == data[b[live] + lcp[live + 1]]
        live = live[same]
        lcp[live + 1] += 1
        live = live[lcp[live + 1] < np.minimum(room[live], most)]
    return lcp


def intervals(lcp: np.ndarray, least: int = LENGTH) -> Iterator[tuple[int, int, int, bool]]:
    """Stack scan: (from, to, common prefix, outermost) of each interval of the
    common-prefix interval tree with ``least`` bytes or more, children first."""
    stack: list[tuple[int, int]] = []
    n, last = len(lcp), -2
    for i in [*np.flatnonzero(lcp >= least).tolist(), n]:
        if i == n or i != last + 1:  # the prefix was too short in between
            while stack:
                left, depth = stack.pop()
                yield left, last, depth, not stack
        if i == n:
            break
        left, depth = i - 1, int(lcp[i])
        while stack and stack[-1][1] > depth:
            left, deep = stack.pop()
            yield left, i - 1, deep, False
        if not stack or stack[-1][1] < depth:
            stack.append((left, depth))
        last = i


def leaders(lcp: np.ndarray, rank: np.ndarray, left: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """From the tree: suffixes (by rank) that lose the lead in an interval, the
    interval's common prefix and its leader. Intervals whose suffixes all have one
    byte to their left are passed over; ``left`` is -1 where a run begins."""
    best, byte, after = rank.tolist(), left.tolist(), list(range(1, len(rank) + 1))
    losers, depths, tops = [], [], []
    for lo, hi, depth, _ in intervals(lcp):
        members, bytes_, i = [], set(), lo
        while i <= hi:
            members.append(best[i])
            bytes_.add(byte[i])
            i = after[i]
        top, diverse = min(members), len(bytes_) > 1 or -1 in bytes_
        best[lo], after[lo] = top, hi + 1
        if diverse:
            byte[lo] = -1
            for m in members:
                if m != top:
                    losers.append(m)
                    depths.append(depth)
                    tops.append(top)
    return losers, depths, tops


def _folded(group: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Different runs in order of document and start, with their batches and bytes;
    the others as marks (batch, mark) of the first of their kind."""
    recs, texts, batch = [], [], []
    for b, blob in zip(group.column("batch_id").to_pylist(), group.column("blob")):
        rec, own = _opened_runs(blob.as_py())
        recs.append(rec)
        texts += own
        batch += [b] * len(rec)
    rec, batch = np.concatenate(recs), np.array(batch, np.int64)
    order = np.lexsort((rec["pos"], rec["row"], batch, rec["doc"]))
    rec, batch, texts = rec[order], batch[order], [texts[i] for i in order]
    seen: dict[bytes, int] = {}
    first, again, lead = [], [], []
    for i, t in enumerate(texts):
        j = seen.setdefault(t, i)
        if j == i:
            first.append(i)
        else:
            again.append(i)
            lead.append(j)
    marks = np.zeros(len(again), MARK)
    marks["at"], marks["n"], marks["doc"], marks["pos"] = rec["at"][again], rec["n"][again] + LENGTH - 1, rec["doc"][lead], rec["pos"][lead]
    return rec[first], batch[first], [texts[i] for i in first], batch[again], marks


def _scan_place(group: pa.Table) -> pa.Table:
    """Marks of all runs that meet here but the leaders."""
    if group.column("place")[0].as_py() < 0:
        return group.select(ROUTES.names)
    rec, batch, texts, far, marks = _folded(group)
    # A run that stands alone under its anchor shares no window with another.
    _, inverse, times = np.unique(rec["hash"], return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[inverse] > 1)
    out = _mark_rows(far, marks)
    if len(some):
        rec, batch = rec[some], batch[some]
        # Bytes of UTF-8 stay below 255: one more makes room for an end that sorts first.
        n = rec["n"].astype(np.int64)
        covered = n + LENGTH - 1
        most = int(covered.max())
        data = np.frombuffer(b"\xff".join(texts[i] for i in some) + b"\xff" * (most + 8), np.uint8) + np.uint8(1)
        begin = np.cumsum(covered + 1) - (covered + 1)
        who = np.repeat(np.arange(len(rec)), n)
        off = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        places = begin[who] + off  # in order of document and start
        sa, _ = suffix_array(data, places, most)
        rank = np.searchsorted(places, sa)
        lcp = common_prefixes(data, sa, (begin + covered)[who[rank]], most)
        left = np.where(off[rank] > 0, data[np.maximum(sa - 1, 0)].astype(np.int64), -1)
        losers, depths, tops = leaders(lcp, rank, left)
        if losers:
            losers, tops = np.array(losers), np.array(tops)
            marks = np.zeros(len(losers), MARK)
            marks["at"], marks["n"] = rec["at"][who[losers]] + off[losers], depths
            marks["doc"], marks["pos"] = rec["doc"][who[tops]], rec["pos"][who[tops]] + off[tops]
            out += _mark_rows(batch[who[losers]], marks)
    return _table(out, ROUTES)


def _fold_place(places: int):
    """Places of hot anchors give marks for equal runs and send one of each on;
    others are scanned."""

    def fn(group: pa.Table) -> pa.Table:
        if group.column("place")[0].as_py() < places:
            return _scan_place(group)
        rec, batch, texts, far, marks = _folded(group)
        out = _mark_rows(far, marks)
        to = (rec["hash"] % np.uint64(places)).astype(np.int64)
        order = np.lexsort((batch, to))
        cuts = np.flatnonzero(np.concatenate([[True], (to[order][1:] != to[order][:-1]) | (batch[order][1:] != batch[order][:-1])]))
        for s, e in zip(cuts, [*cuts[1:], len(order)]):
            mine = order[s:e]
            out.append((int(to[mine[0]]), int(batch[mine[0]]), _blob(rec[mine], [texts[i] for i in mine])))
        return _table(out, ROUTES)

    return fn


# ---- removal


def joined(marks: np.ndarray, starts: np.ndarray, ids: list) -> np.ndarray:
    """Occurrences whole: marks of one document that point to one leader at one
    distance and overlap become one. A leader in this batch that is itself an
    occurrence of another gives way to that one."""
    own = marks["doc"] == LOCAL
    far = np.sort(marks[~own], order=["at", "n"])
    local = marks[own].copy()
    if len(local):
        ends = far["at"] + far["n"]
        # Of the marks that start no later, the one that ends last.
        top = np.maximum.accumulate(ends * len(far) + np.arange(len(far))) % max(1, len(far)) if len(far) else np.zeros(0, np.int64)
        k = np.searchsorted(far["at"], local["pos"], "right") - 1
        by = top[np.maximum(k, 0)] if len(far) else np.zeros(len(local), np.int64)
        inside = (k >= 0) & (ends[by] >= local["pos"] + local["n"]) if len(far) else np.zeros(len(local), bool)
        doc = np.searchsorted(starts, local["pos"], "right") - 1
        names = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        place = local["pos"].copy()
        local["doc"], local["pos"] = names[doc], place - starts[doc]
        if inside.any():
            source = far[by[inside]]
            local["doc"][inside], local["pos"][inside] = source["doc"], source["pos"] + place[inside] - source["at"]
    every = np.concatenate([far, local])
    if not len(every):
        return every
    row, lag = np.searchsorted(starts, every["at"], "right") - 1, every["pos"] - every["at"]
    order = np.lexsort((every["at"], lag, every["doc"], row))
    every, row, lag = every[order], row[order], lag[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (lag[1:] != lag[:-1]) | (every["doc"][1:] != every["doc"][:-1])])
    line = np.cumsum(new)
    wide = int((every["at"] + every["n"]).max()) + 1
    reach = np.maximum.accumulate(every["at"] + every["n"] + line * wide) - line * wide
    begin = np.flatnonzero(new | np.concatenate([[True], every["at"][1:] > reach[:-1]]))
    out = every[begin].copy()
    out["n"] = reach[np.concatenate([begin[1:], [len(every)]]) - 1] - out["at"]
    return out


CUT = "doc_id long, n_bytes long, n_removed long, spans array<long>, kept binary"


def _removed(batch: pa.Table, marks: pa.Table) -> pa.Table:
    numbers = pa.list_(pa.int64())
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", numbers), ("kept", pa.binary())])
    if not batch.num_rows:
        return kinds.empty_table()
    data, starts, lengths, ids = _opened(batch.to_pylist()[0])
    z = zstandard.ZstdDecompressor()
    held = [np.frombuffer(z.decompress(x.as_py()), MARK) for x in marks.column("blob")]
    found = joined(np.concatenate(held) if held else np.zeros(0, MARK), starts, ids)
    cover = np.zeros(len(data) + 1, np.int32)
    np.add.at(cover, found["at"], 1)
    np.add.at(cover, found["at"] + found["n"], -1)
    gone = np.cumsum(cover[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    array = np.frombuffer(data, np.uint8)
    rows = []
    for doc_id, s, n in zip(ids, starts.tolist(), lengths.tolist()):
        k = int(total[s + n] - total[s])
        if not k:
            rows.append((doc_id, n, 0, [], data[s : s + n]))
            continue
        own = gone[s : s + n]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
        rows.append((doc_id, n, k, edges.tolist(), array[s : s + n][~own].tobytes()))
    return _table(rows, kinds)


def _shared_anchors(batches: DataFrame, total: int) -> DataFrame:
    """batch_id, hashes, hot: of each batch the anchors that occur elsewhere, written."""
    anchors = batches.mapInArrow(_anchors_by(max(1, -(-total // (32 << 20)))), "place int, batch_id long, several int, hashes binary")
    return materialize(anchors.groupBy("place").applyInArrow(_shared_by(HOT), "batch_id long, hashes binary, hot int"), "repeat-anchors")


def _bytes_of(batches: DataFrame) -> int:
    return batches.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end, start, end ... of what goes), kept (bytes)."""
    batches = batches_of(docs)
    total = _bytes_of(batches)
    shared = _shared_anchors(batches, total)
    places = max(1, -(-total // (4 << 20)))
    # The batches are dealt out once: both joins below read the same exchange.
    dealt = batches.groupBy("batch_id")
    marks = dealt.cogroup(shared.groupBy("batch_id")).applyInArrow(_runs_by(places, SALTS), ROUTED)
    # Marks have the place -1; they are spread by batch on their way.
    by = ["place", F.when(F.col("place") < 0, F.col("batch_id")).alias("of")]
    if shared.where("hot > 0").limit(1).count():
        marks = marks.groupBy(*by).applyInArrow(_fold_place(places), ROUTED)
    marks = marks.groupBy(*by).applyInArrow(_scan_place, ROUTED)
    return dealt.cogroup(marks.groupBy("batch_id")).applyInArrow(_removed, CUT)


# ---- groups of maximal repeats


def window_hashes(data: np.ndarray, base: int, length: int = LENGTH) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each place on, put together from
    hashes of powers of two of bytes."""
    h, step, out, have = SUBST[data] * np.uint64(base), 1, None, 0
    while True:
        if length & step:
            m = max(0, len(data) - have - step + 1)
            out = h[:m] if out is None else out[:m] * np.uint64(pow(base, step, 1 << 64)) + h[have : have + m]
            have += step
        if have == length:
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            return (out ^ (out >> np.uint64(32))).view(np.int64)
        h = h[:-step] * np.uint64(pow(base, step, 1 << 64)) + h[step:]
        step *= 2


BASES = (BASE, 0xD6E8FEB86659FD93)
CLASSES = pa.schema([("batch_id", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("n", pa.int64()), *[(x, pa.int32()) for x in ("l0", "l1", "r0", "r1")]])
REGIONS = pa.schema([("batch_id", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("units", pa.list_(pa.binary()))])


def _windows(batch: pa.Table, replies: pa.Table) -> pa.Table:
    """The different windows of a batch under anchors that occur elsewhere: how many, and
    the least and largest byte before and after them (-1 and 256 at a text's begin and end)."""
    if not batch.num_rows or not replies.num_rows:
        return CLASSES.empty_table()
    row = batch.to_pylist()[0]
    data, starts, lengths, _ = _opened(row)
    array = np.frombuffer(data, np.uint8)
    hashes, at, n = runs(array, starts, lengths)
    pick = np.isin(hashes, np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in replies.column("hashes")]))
    at, n = at[pick], n[pick]
    where = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc = np.searchsorted(starts, where, "right") - 1
    begins, ends = where == starts[doc], where + LENGTH == starts[doc] + lengths[doc]
    left, right = array[np.maximum(where - 1, 0)].astype(np.int32), array[np.minimum(where + LENGTH, len(array) - 1)].astype(np.int32)
    h, g = (window_hashes(array, b)[where] for b in BASES)
    order = np.lexsort((g, h))
    h, g, left, right, begins, ends = (x[order] for x in (h, g, left, right, begins, ends))
    cuts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
    columns = [np.full(len(cuts), row["batch_id"]), h[cuts], g[cuts], np.diff(np.concatenate([cuts, [len(h)]]))]
    for x, edge in ((left, begins), (right, ends)):
        columns += [np.minimum.reduceat(np.where(edge, -1, x), cuts), np.maximum.reduceat(np.where(edge, 256, x), cuts)]
    return pa.table([pa.array(c, t) for c, t in zip(columns, CLASSES.types)], schema=CLASSES)


def _units(batch: pa.Table, classes: pa.Table) -> pa.Table:
    """Stretches of repeated windows of a batch, a row each, with their units."""
    if not batch.num_rows or not classes.num_rows:
        return REGIONS.empty_table()
    row = batch.to_pylist()[0]
    data, starts, lengths, ids = _opened(row)
    array = np.frombuffer(data, np.uint8)
    h, g = (window_hashes(array, b) for b in BASES)
    ch, cg = classes.column("h").to_numpy(), classes.column("g").to_numpy()
    where = np.flatnonzero(np.isin(h, ch))
    doc = np.searchsorted(starts, where, "right") - 1
    inside = where + LENGTH <= starts[doc] + lengths[doc]
    where, doc = where[inside], doc[inside]
    # Classes and windows in one order: a class comes before its windows.
    order = np.lexsort((np.repeat([0, 1], [len(ch), len(where)]), np.concatenate([cg, g[where]]), np.concatenate([ch, h[where]])))
    of = np.maximum.accumulate(np.where(order < len(ch), np.arange(len(order)), -1))
    mine = np.flatnonzero(order >= len(ch))
    k, w = order[of[mine]], order[mine] - len(ch)
    same = (of[mine] >= 0) & (ch[k] == h[where[w]]) & (cg[k] == g[where[w]])
    back = np.argsort(w[same])
    k, w = k[same][back], w[same][back]
    where, doc = where[w], doc[w]
    left, right = classes.column("left").to_numpy()[k].astype(bool), classes.column("right").to_numpy()[k].astype(bool)
    region = np.concatenate([[True], where[1:] != where[:-1] + 1])[: len(where)]
    first = np.flatnonzero(region | left | np.concatenate([[True], right[:-1]])[: len(where)])
    s, e = where[first], where[np.concatenate([first[1:], [len(where)]])[: len(first)] - 1] + LENGTH
    cuts = np.flatnonzero(region[first]).tolist()
    rows = []
    for i, j in zip(cuts, [*cuts[1:], len(first)]):
        d = int(doc[first[i]])
        units = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(s[i:j].tolist(), e[i:j].tolist())]
        rows.append((row["batch_id"], int(s[i]), ids[d], (s[i:j] - starts[d]).tolist(), (e[i:j] - starts[d]).tolist(), units))
    return _table(rows, REGIONS)


GROWN = pa.schema([("node", pa.binary()), ("batch_id", pa.int64()), ("at", pa.int64()), ("i", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("more", pa.bool_()), ("before", pa.int64()), ("after", pa.int64())])
GROWN_DDL = "node binary, batch_id long, at long, i int, doc_id long, start long, length long, more boolean, before long, after long"


def _grown(least: int, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``least`` to ``most`` units from each living begin of each stretch; a row's
    node is a digest of its units, ``before`` and ``after`` are the units beside it."""
    brief = lambda unit: int.from_bytes(unit[:8], "little", signed=True)
    out: list[tuple] = []
    for b in batches:
        for r in b.to_pylist():
            starts, ends, units = r["starts"], r["ends"], r["units"]
            for x in r["living"] if least > 1 else [{"i": i, "node": b""} for i in range(len(units))]:
                i, node = x["i"], x["node"]
                before = brief(units[i - 1]) if i else None
                for j in range(i + least - 1, min(i + most, len(units))):
                    node = hashlib.blake2b(node + units[j], digest_size=16).digest()
                    after = brief(units[j + 1]) if j + 1 < len(units) else None
                    out.append((node, r["batch_id"], r["at"], i, r["doc_id"], starts[i], ends[j] - starts[i], j == i + most - 1 and after is not None, before, after))
                if len(out) > 20_000:
                    yield from _table(out, GROWN).to_batches()
                    out = []
    if out:
        yield from _table(out, GROWN).to_batches()


def _stretches(docs: DataFrame) -> DataFrame:
    batches = batches_of(docs)
    shared = _shared_anchors(batches, _bytes_of(batches))
    dealt = batches.groupBy("batch_id")
    windows = materialize(dealt.cogroup(shared.groupBy("batch_id")).applyInArrow(_windows, "batch_id long, h long, g long, n long, l0 int, l1 int, r0 int, r1 int"), "repeat-windows")
    found = windows.groupBy("h", "g").agg(F.sum("n").alias("n"), F.min("l0").alias("l0"), F.max("l1").alias("l1"), F.min("r0").alias("r0"), F.max("r1").alias("r1"))
    repeated = found.where("n > 1").select("h", "g", F.expr("int(l0 <> l1)").alias("left"), F.expr("int(r0 <> r1)").alias("right"))
    told = salted_join(windows.select("batch_id", "h", "g"), repeated, ["h", "g"], F.col("batch_id")).where("left is not null")
    units = dealt.cogroup(told.select("batch_id", "h", "g", "left", "right").groupBy("batch_id"))
    return materialize(units.applyInArrow(_units, "batch_id long, at long, doc_id long, starts array<long>, ends array<long>, units array<binary>"), "repeat-stretches")


def repeat_occurrences(docs: DataFrame) -> DataFrame:
    """node (binary, the same for equal strings), length, doc_id, start: every occurrence of
    every maximal repeat of LENGTH bytes or more, a row each."""
    stretches = _stretches(docs)
    least = most = 1
    rows, out = stretches, []
    while True:
        grown = materialize(rows.mapInArrow(partial(_grown, least, most), GROWN_DDL), "repeat-grown")
        sides = [f(x).alias(f"{x}_{f.__name__}") for x in ("before", "after") for f in (F.min, F.max, F.count)]
        nodes = grown.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *sides)
        differ = lambda x: F.expr(f"{x}_count < n or {x}_min <> {x}_max")
        nodes = nodes.where((F.col("n") > 1) & differ("before")).select("node", F.coalesce(differ("after"), F.lit(True)).alias("whole"))
        kept = materialize(salted_join(grown, nodes, ["node"], F.xxhash64("batch_id", "at", "i")).where("whole is not null"), "repeat-kept")
        out.append(kept.where("whole").select("node", "length", "doc_id", "start"))
        living = kept.where("more")
        if not living.limit(1).count():
            break
        living = living.groupBy("batch_id", "at").agg(F.collect_list(F.struct("i", "node")).alias("living"))
        rows, least, most = stretches.join(living, ["batch_id", "at"]), most + 1, 2 * most + 1
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """length, occurrences (doc_id, start; in order, the first leads): a row a group, one
    string and all places where it occurs. ``repeat_occurrences`` gives the same as narrow
    rows, where a group may be too large for one row."""
    groups = repeat_occurrences(docs).groupBy("node", "length").agg(F.sort_array(F.collect_list(F.struct("doc_id", "start"))).alias("occurrences"))
    return groups.select("length", "occurrences")


def op5_repeats(spark, sf_dir):
    rows = remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
