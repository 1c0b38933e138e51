"""Packing by cutting-stock column generation.

Documents are tokenized and cut into pieces: whole sequences of ``CAPACITY``
tokens, and a rest. Short pieces of one length go in bundles of at most ``STEP``.
The histogram of lengths of bundles and other pieces (in classes of ``STEP`` tokens,
rounded up) is a cutting-stock problem: a linear program over patterns, whose columns are priced by a knapsack dynamic program. The patterns of the
final basis are rounded down; what is left is filled largest first. Pieces,
ranked within their class, are then dealt to the patterns' sequences.

Defined results: null and empty texts are the closing id alone; a document of
any length is cut into pieces that tile it; repeated rows are packed each; a
sequence whose tokens are a power of two is left at that length, others are
padded to the capacity; an empty table gives an empty table; extra columns are
ignored.

Scale: the program sees the histogram only (a class a length, whatever the
number of documents) and its plan has a bounded number of patterns; pieces move
as narrow rows, and ranks within a hot length class come from prefix sums.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import buckets_for, materialize, prefix_rank, rebatched, seeded, table, unit

CAPACITY, STEP, CLOSING, SEED = 2048, 8, 1, "pack-1"
TOKENIZER = "word_bpe_49k.json"
#: Pieces up to this length are bundled with others of their length, so that
#: rounding is done once a bundle.
SHORT = 128
CACHE = 300_000
#: Stands between words that are encoded together; texts that hold it, or other
#: control or rare white space that splits differently, are encoded whole.
MARK = "\x01"
#: Marks (ASCII, no apostrophe, letter, digit or blank) and plain words, for Arrow's patterns.
MARKS = r"[!-&(-/:-@\[-`{-~]"
PLAIN = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{148}\x{14a}-\x{17e}]+" + MARKS + "*$"


def solve(demand: dict[int, int], capacity: int, gap: float = 1e-3) -> list[tuple[dict[int, int], int]]:
    """Patterns (width -> times) and how often each is used; covers the demand exactly."""
    widths = np.array(sorted((w for w, n in demand.items() if n > 0), reverse=True), int)
    if not len(widths):
        return []
    need = np.array([demand[int(w)] for w in widths], float)
    m = len(widths)
    columns = np.diag(capacity // widths).astype(float)
    inverse, x = np.diag(1.0 / np.diag(columns)), need / np.diag(columns)
    for _ in range(20 * m + 200):
        dual = inverse.sum(0)
        pattern, value = price(dual, widths, capacity)
        if value <= 1 + gap:  # the program's optimum is at least its value now / this worth
            break
        step = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-10, x / step, np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        x = np.maximum(x - ratio[leave] * step, 0)
        x[leave] = ratio[leave]
        columns[:, leave] = pattern
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
    plan, left = [], need.copy()
    for k in np.argsort(-x, kind="stable"):
        used = columns[:, k]
        times = int(min(np.floor(x[k] + 1e-6), *(left[used > 0] // used[used > 0])))
        if times > 0:
            plan.append(({int(widths[i]): int(used[i]) for i in np.flatnonzero(used)}, times))
            left -= times * used
    return plan + fill(dict(zip(widths.tolist(), left.astype(int).tolist())), capacity)


def price(dual: np.ndarray, widths: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Knapsack: the pattern of most worth under the duals. Widths are taken in
    from the least on; one that is worth no more than what already fits into its
    room is in no better pattern and is passed over."""
    best, steps = np.zeros(capacity + 1), []
    for i in np.argsort(widths, kind="stable").tolist():
        w, d = int(widths[i]), float(dual[i])
        if d <= best[w] + 1e-12:
            continue
        # Rooms that differ by multiples of w, one below the other: a copy more a row.
        layers = -(-(capacity + 1) // w)
        grid = np.full(layers * w, -np.inf)
        grid[: capacity + 1] = best
        worth = (np.arange(layers) * d)[:, None]
        after = (np.maximum.accumulate(grid.reshape(layers, w) - worth, axis=0) + worth).ravel()[: capacity + 1]
        steps.append((i, w, best, after))
        best = after
    pattern, c = np.zeros(len(widths)), capacity
    for i, w, before, after in reversed(steps):
        while c >= w and after[c] > before[c] + 1e-12:
            pattern[i] += 1
            c -= w
    return pattern, float(pattern @ dual)


def bundles(counts: dict[int, int]) -> tuple[dict[int, int], dict[int, tuple[int, int, int, int, int, int]]]:
    """Pieces per class -> demand per width, and per class: pieces a bundle, pieces
    in bundles, the bundles' width and first rank in it, the same of single pieces.
    Classes up to SHORT are exact lengths; their bundles are of the size of which
    a sequence holds the most pieces, the least such size."""
    demand: dict[int, int] = {}
    items = {}
    for k, n in sorted(counts.items()):
        room = lambda j: j * (CAPACITY // STEP // -(-j * k // STEP))  # noqa: B023, E731
        each = max(range(1, STEP + 1), key=room) if k <= SHORT else 1
        wide, single = (-(-each * k // STEP), -(-k // STEP)) if k <= SHORT else (k - SHORT, k - SHORT)
        first = demand.get(wide, 0)
        demand[wide] = first + n // each
        rest = demand.get(single, 0)
        demand[single] = rest + n % each
        items[k] = (each, n // each * each, wide, first, single, rest)
    return {w: n for w, n in demand.items() if n}, items


def fill(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The rest of the demand, largest first; like bins are counted once."""
    plan: list[tuple[dict[int, int], int]] = []
    left = {w: n for w, n in left.items() if n > 0}
    while left:
        room, used = capacity, {}
        for w in sorted(left, reverse=True):
            if n := min(left[w], room // w):
                used[w], room = n, room - n * w
        times = min(left[w] // n for w, n in used.items())
        for w, n in used.items():
            left[w] -= n * times
            if not left[w]:
                del left[w]
        plan.append((used, times))
    return plan


class Encoder:
    """Texts to ids as little-endian 32-bit bytes. Texts are split at white space,
    which the tokenizer never joins across; each different word of a batch is looked
    up or encoded once, and the texts' ids are gathered from one buffer, all in
    arrays. When more than CACHE words are kept, only those of the batch at hand
    stay. Texts with unusual control characters or with what may be the string of a
    special token (which has an id of its own) are encoded whole.

    Plain words (Latin letters, then marks) need no normalisation but lower case and
    are a pre-token each for letters and marks, so they go to the tokenizer's model
    by a short cut, where the tokenizer is of that kind."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.odd = regex.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f\u180e\u200b-\u200f\u2028\u2029\u2060\ufeff\u03a3]|\p{M}")
        self.usual = re.compile(r"[^\t-\r -~\u00a0-\u02ff]")
        mark = self.tok.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        spec = json.load(open(path, encoding="utf-8"))
        special = [x["content"] for x in spec.get("added_tokens") or []]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        steps = lambda x, k: [i["type"] for i in (x or {}).get(k, [])]
        model = spec["model"]
        suffix = model.get("end_of_word_suffix")
        self.short = None
        if steps(spec["normalizer"], "normalizers") == ["NFC", "Replace", "Lowercase"] and steps(spec["pre_tokenizer"], "pretokenizers") == ["Split", "ByteLevel"] and suffix:
            self.short = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for w, i in model["vocab"].items() if w.endswith(suffix)]] = True
            shown = [*range(32, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves, and the blank
            self.letters = np.arange(256, dtype="<u2")
            hidden = np.array([b for b in range(256) if b not in shown or b == 32])
            self.letters[hidden] = np.where(hidden == 32, 32, 256 + np.arange(len(hidden)))
        self.forget()

    def forget(self) -> None:
        """Kept words, how many ids each has, and their ids one after the other."""
        self.known = pa.array([], pa.large_string())
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """How many ids each word has, and the ids in runs of words."""
        import pyarrow.compute as pc

        pieces = (1 + pc.match_substring_regex(words, f"{MARKS}$").to_numpy(zero_copy_only=False)).astype(np.int64)
        apart = pc.replace_substring_regex(pc.utf8_lower(words), f"({MARKS}+)$", r" \1")
        cuts = pa.array([*range(0, len(words), 512), len(words)], pa.int32())
        sizes, flat = [np.zeros(0, np.int64)], []
        for i, joined in zip(range(0, len(words), 512), pc.binary_join(pa.ListArray.from_arrays(cuts, apart.cast(pa.string())), " ").to_pylist()):
            if not joined.isascii():
                joined = self.letters[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.short.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            at, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(pieces[i : i + 512])
            if len(at) == last[-1] and at[-1] == len(ids):
                sizes.append(np.diff(at[last - 1], prepend=0))
                flat.append(ids)
            else:
                own = [self.whole(w) for w in words[i : i + 512].to_pylist()]
                sizes.append(np.array([len(x) // 4 for x in own], np.int64))
                flat.append(np.frombuffer(b"".join(own), "<u4"))
        return np.concatenate(sizes), flat

    def _other(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        sizes, flat, sep = [np.zeros(0, np.int64)], [], f" {MARK} "
        for i in range(0, len(words), 256):
            part = words[i : i + 256]
            ids = np.array(self.tok.encode_batch_fast([sep.join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) == len(part) - 1:
                sizes.append(np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1)
                flat.append(ids[ids != self.mark])
            else:
                own = [self.whole(w) for w in part]
                sizes.append(np.array([len(x) // 4 for x in own], np.int64))
                flat.append(np.frombuffer(b"".join(own), "<u4"))
        return np.concatenate(sizes), flat

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the words are kept; new ones are encoded."""
        import pyarrow.compute as pc

        place = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(place < 0)
        if not len(new):
            return place
        if len(self.known) + len(new) > CACHE:
            old = np.flatnonzero(place >= 0)
            kept = place[old]
            starts, sizes = (np.cumsum(self.sizes) - self.sizes)[kept], self.sizes[kept]
            self.known, self.sizes, self.flat = self.known.take(pa.array(kept)), sizes, self.flat[spread(starts, sizes)]
            place[old] = np.arange(len(old))
        novel = words.take(pa.array(new))
        plain = pc.match_substring_regex(novel, PLAIN).to_numpy(zero_copy_only=False) if self.short is not None else np.zeros(len(new), bool)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        place[new[order]] = len(self.known) + np.arange(len(new))
        novel, n = novel.take(pa.array(order)), int(plain.sum())
        (a, x), (b, y) = self._plain(novel[:n]), self._other(novel[n:].to_pylist())
        self.known = pa.concat_arrays([self.known, novel])
        self.sizes, self.flat = np.concatenate([self.sizes, a, b]), np.concatenate([self.flat, *x, *y])
        return place

    def _odd(self, text: str) -> bool:
        if self.mark is None or self.special is not None and "<" in text and self.special.search(text):
            return True
        return (not text.isascii() or not text.isprintable()) and self.usual.search(text) is not None and self.odd.search(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        import pyarrow.compute as pc

        odd = [self._odd(t) for t in texts]
        split = pc.utf8_split_whitespace(pa.array(["" if o else t for o, t in zip(odd, texts)], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        place = self._places(coded.dictionary)
        starts, sizes = (np.cumsum(self.sizes) - self.sizes)[place], self.sizes[place]
        index = coded.indices.to_numpy()
        ids = self.flat[spread(starts[index], sizes[index])].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes[index])])
        cuts = (ends[split.offsets.to_numpy()] * 4).tolist()
        return [self.whole(t) if o else ids[s:e] for o, t, s, e in zip(odd, texts, cuts[:-1], cuts[1:])]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each start, as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) per piece."""
    name = tokenizer or TOKENIZER

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if os.path.sep in name:
            path = name
        else:
            import public_tokenizers

            path = public_tokenizers.path(name)
        enc, closing = encoder(path), np.array([CLOSING], "<u4").tobytes()
        for b in rebatched(batches, "text", 2 << 20):
            rows = []
            for doc_id, data in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()])):
                data += closing
                n = len(data) // 4
                for s in range(0, n, CAPACITY):
                    part = data[4 * s : 4 * (s + CAPACITY)]
                    rows.append((doc_id, s, len(part) // 4, zlib.crc32(part), n, part if with_ids else None))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 5, pa.binary()])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_tokens, padded_to (and ids) per piece."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, with_ids), "pack-pieces")
    kind = F.when(F.col("length") <= SHORT, F.col("length")).otherwise(F.ceil(F.col("length") / STEP) + SHORT).cast("int")
    keep = ["ids"] if with_ids else []
    rows = cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *keep, kind.alias("kind"), seeded(SEED, F.col("doc_id"), F.col("start"), F.col("ids_crc32")).alias("shuffled"))
    counts = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}  # SHORT + CAPACITY / STEP rows at most
    demand, items = bundles(counts)
    plan = solve(demand, CAPACITY // STEP)
    n = sum(counts.values())
    order = ["shuffled", "doc_id", "start", "ids_crc32", "length"]
    ranked = prefix_rank(rows, ["kind"], F.floor(unit(F.col("shuffled")) * buckets_for(n)), order, "place")
    # For each width, ranges of ranks: pattern's first sequence, pieces a sequence.
    ranges, first, taken = [], 0, {}
    for used, times in plan:
        for w, k in used.items():
            ranges.append((w, taken.get(w, 0), taken.get(w, 0) + k * times, first, k))
            taken[w] = taken.get(w, 0) + k * times
        first += times
    by_width: dict[int, list] = {}
    for w, *r in ranges:
        by_width.setdefault(w, []).append(r)
    table_ = {w: [np.array(c, np.int64) for c in zip(*r)] for w, r in by_width.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, place = b.column("kind").to_numpy(), b.column("place").to_numpy() - 1
            out = np.zeros(len(kinds), np.int64)
            for x in np.unique(kinds):
                each, bundled, wide, first, single, rest = items[int(x)]
                mine = np.flatnonzero(kinds == x)
                p = place[mine]
                for at, w, rank in (
                    (p < bundled, wide, first + p // each),
                    (p >= bundled, single, rest + p - bundled),
                ):
                    if at.any():
                        low, _, base, times = table_[w]
                        k = np.searchsorted(low, rank[at], "right") - 1
                        out[mine[at]] = base[k] + (rank[at] - low[k]) // times[k]
            yield b.append_column("sequence_id", pa.array(out))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, " + "ids binary, " * with_ids + "kind int, place long, sequence_id long"
    columns = [x.split()[0] for x in schema.split(", ")[:-1]]
    placed = ranked.select(*columns[:-1], F.col("place").cast("long").alias("place")).mapInArrow(deal, schema) if demand else spark.createDataFrame([], schema)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "place")
    total = F.sum("length").over(Window.partitionBy("sequence_id"))
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("sequence_tokens", total)
    power = F.col("sequence_tokens").bitwiseAND(F.col("sequence_tokens") - 1) == 0
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", F.when(power, F.col("sequence_tokens")).otherwise(CAPACITY).alias("padded_to"), *keep)


def op6_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
