"""Removal of every long byte string that occurs more than once, by suffix arrays.

How the work is split. All strings of ``length`` bytes that start with a given position are *windows*. The anchor of a
window is the smallest hash among the ``gram``-byte strings inside it: a function of the window's content alone, so equal
windows have equal anchors wherever they stand. Consecutive windows of a document with one anchor form a *run*. Runs are
dealt out by anchor; a window can only repeat inside its anchor's share. That replaces a sort of all suffixes in one place:

1. one pass over the texts finds the runs (anchor, place, digest of the run's bytes);
2. runs with equal bytes are one class; windows of a class of two or more repeat. An anchor with one class needs no more;
3. classes of an anchor with several are fetched, dealt to shards of bounded bytes, and each shard builds its suffix
   array (Larsson-Sadakane refinement) and common prefixes (Kasai); neighbours that share ``length`` bytes repeat;
4. an anchor's share too large for one shard is cut into several, and each pair of them is merged by binary search of one
   shard's windows in the other's suffix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import forget, parts, stored, text_arrays, whole_group

LENGTH = 400
#: Bytes of the strings whose smallest hash is a window's anchor, at most; a quarter of the window's where that is less.
GRAM = 96
#: Bytes of text in one shard; a shard's arrays take about 100 times as much.
SHARD_BYTES = 1_000_000
#: Window starts scanned at a time.
SCAN_BYTES = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


# --- runs -------------------------------------------------------------------------------------------------------------


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base, and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of ``data``, and the anchors that occur at two places of ``data`` or more."""
    up, down = powers
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    width = length - gram + 1
    low = _sliding_min(h, width)
    # a place is an anchor of some window around it if its hash is the largest of those windows' anchors
    around = np.full(len(low) + 2 * (width - 1), np.iinfo(np.uint64).max)
    around[width - 1 : width - 1 + len(low)] = ~low
    chosen = np.sort(h[h == ~_sliding_min(around, width)])
    return low, np.unique(chosen[1:][chosen[1:] == chosen[:-1]])


def _pieces(offsets: np.ndarray, length: int, most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (document, first window start, end of bytes) that hold about ``most`` window starts each."""
    held, size = [], 0
    for d in range(len(offsets) - 1):
        start, end = int(offsets[d]), int(offsets[d + 1])
        while end - start >= length:
            stop = min(end, start + most + length - 1)
            if held and size + stop - start > most + length:
                yield held
                held, size = [], 0
            held.append((d, start, stop))
            size += stop - start
            start = stop - length + 1
    if held:
        yield held


def _runs(length: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(2 * (SCAN_BYTES + length) + 1)
        for batch in batches:
            data, offsets = text_arrays(batch.column(2))
            ids, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for held in _pieces(offsets, length, SCAN_BYTES):
                joined = np.concatenate([data[s:e] for _, s, e in held])
                raw = joined.tobytes()
                low, twice = anchors(joined, length, gram, powers)
                sizes = np.array([e - s for _, s, e in held])
                firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                lasts = firsts + sizes - length  # the last window start of each piece
                new = np.empty(len(low), bool)
                new[0], new[1:] = True, low[1:] != low[:-1]
                new[firsts] = True
                begin = np.flatnonzero(new)
                piece = np.searchsorted(firsts, begin, "right") - 1
                keep = begin <= lasts[piece]
                begin, piece = begin[keep], piece[keep]
                end = np.minimum(np.concatenate([begin[1:], [len(low)]]) - 1, lasts[piece])
                at = np.array([s for _, s, _ in held])[piece] - firsts[piece]  # from the joined bytes to the batch's
                doc = np.array([d for d, _, _ in held])[piece]
                digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), (end + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(low[begin].view(np.int64)),
                        pa.array(digests, pa.binary()),
                        pa.array(ids[doc], pa.int64()),
                        pa.array(hashes[doc], pa.int64()),
                        pa.array(begin + at - offsets[doc], pa.int64()),
                        pa.array(end - begin + 1, pa.int64()),
                        pa.array(np.isin(low[begin], twice)),
                    ],
                    names=["anchor", "digest", "_id", "_h", "first", "n", "twice"],
                )

    return scan


# --- suffix arrays ----------------------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes of several strings, and each one's rank, by Larsson-Sadakane refinement.

    ``data`` holds the strings, string s at starts[s]:ends[s], each followed by one byte that stands for its end. A
    suffix ends with its string; equal suffixes go in the order of their strings. Only groups that are still tied are
    sorted again, by the rank of the suffix as far ahead as their members are known to agree, which doubles each time.
    Ends have rank below 0 and are not in the order.
    """
    n, many = len(data), len(starts)
    left = np.repeat(ends, ends - starts + 1) - np.arange(n)
    bits = max(1, int(n).bit_length())
    packed = 3 * bits <= 64  # then a plain sort of (group, rank ahead, place) in one word does
    symbols = 5 if packed and bits <= 21 else 7
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(symbols):
        key <<= np.uint64(8)
        key |= wide[k : n + k].astype(np.uint64) * (left > k)
    key = key << np.uint64(3) | np.minimum(left, symbols).astype(np.uint64)
    if symbols == 5:
        key = key << np.uint64(bits) | np.arange(n, dtype=np.uint64)
        key.sort()
        at, key = (key & np.uint64((1 << bits) - 1)).astype(np.int64), key >> np.uint64(bits)
    else:
        at = np.argsort(key, kind="stable")
        key = key[at]
    head = np.ones(n, bool)
    head[1:] = (key[1:] != key[:-1]) | (left[at][1:] < symbols)  # a suffix that has ended is alone
    order, rank = at.astype(np.int32), np.empty(n, np.int32)
    slots, ahead = np.arange(n), 0
    while True:
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(slots)))
        group = np.repeat(slots[begin], size)
        rank[at] = group
        order[slots] = at
        tied = np.repeat(size > 1, size)
        slots, at, group = slots[tied], at[tied], group[tied]
        if not len(slots):
            break
        ahead = 2 * ahead or symbols
        second = rank[at + ahead]
        if packed:
            key = (group.astype(np.uint64) << np.uint64(bits) | second.astype(np.uint64)) << np.uint64(bits) | at.astype(np.uint64)
            key.sort()
            at, key = (key & np.uint64((1 << bits) - 1)).astype(np.int64), key >> np.uint64(bits)
        else:
            key = group.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
            sort = np.argsort(key)
            at, key = at[sort], key[sort]
        head = np.ones(len(slots), bool)
        head[1:] = key[1:] != key[:-1]
    return order[many:], rank - np.int32(many)


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each position, the first one lowest."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        out[: len(data)] |= wide[k : len(data) + k].astype(np.uint64) << np.uint64(8 * k)
    return out


def common_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """Length, up to ``most``, that each suffix shares with the one before it in ``order``.

    Kasai's rule, many lanes of consecutive positions at a time: going one position on, at most one byte is lost.
    """
    n = len(data)
    words, left = _words(data), np.repeat(ends, ends - starts + 1) - np.arange(n)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    counts = -(-(ends - starts) // lane)
    first = np.repeat(starts, counts) + lane * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    size = np.minimum(np.repeat(ends, counts) - first, lane)
    sort = np.argsort(-size, kind="stable")
    first, size = first[sort], size[sort]
    known = np.zeros(len(first), np.int64)
    for step in range(int(size[0]) if len(size) else 0):
        lanes = int(np.searchsorted(-size, -step, "left"))  # those longer than step
        i = first[:lanes] + step
        j = before[i]
        cap = np.where(j >= 0, np.minimum(np.minimum(left[i], left[j]), most), 0)
        h = np.minimum(np.maximum(known[:lanes] - 1, 0), cap)
        grow = np.flatnonzero(h < cap)
        while len(grow):
            x = words[i[grow] + h[grow]] ^ words[j[grow] + h[grow]]
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
            h[grow] += same
            grow = grow[(same == 8) & (h[grow] < cap[grow])]
        known[:lanes] = out[i] = np.minimum(h, cap)
    return out


def distinct_windows(order: np.ndarray, left: np.ndarray, shared: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted suffixes, the first of each group of equal windows, and those windows that have no equal."""
    starts = order[left[order] >= length]
    first = np.flatnonzero(shared[starts] < length)
    size = np.diff(np.append(first, len(starts)))
    return starts[first], starts[first[size == 1]]


def found_in(data: np.ndarray, wanted: np.ndarray, other: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Which windows of ``data`` at ``wanted`` stand in ``other``, by binary search in its sorted window starts ``order``."""
    a, b = _words(data).byteswap(), _words(other).byteswap()  # the first byte counts most
    last = length - 8
    steps = [*range(0, last, 8), last]
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        middle = (low[open_] + high[open_]) // 2
        less, tied = np.zeros(len(open_), bool), np.arange(len(open_))
        for k in steps:
            x, y = b[order[middle[tied]] + k], a[wanted[open_[tied]] + k]
            less[tied[x < y]] = True
            tied = tied[x == y]
            if not len(tied):
                break
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
    equal = np.flatnonzero(low < len(order))
    for k in steps:
        equal = equal[b[order[low[equal]] + k] == a[wanted[equal] + k]]
    flag = np.zeros(len(wanted), bool)
    flag[equal] = True
    return flag


def _spans(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of set flags inside each string: (string, first position in it, how many)."""
    edge = np.zeros(len(flags) + 1, np.int8)
    edge[1:] -= flags
    edge[:-1] += flags
    cut = np.zeros(len(flags) + 1, bool)
    cut[starts] = True
    begin = np.flatnonzero((edge[:-1] == 1) | (cut[:-1] & flags))
    string = np.searchsorted(starts, begin, "right") - 1
    off = np.flatnonzero(~flags)
    stop = np.append(off, len(flags))[np.searchsorted(off, begin)]
    return string, begin - starts[string], np.minimum(stop, ends[string]) - begin


_FOUND = "anchor long, digest binary, span_first long, span_n long"


def _shard(length: int):
    def work(table: pa.Table) -> pa.Table:
        shard = whole_group(table, "shard").to_numpy()
        texts, digests, anchor = whole_group(table, "bytes"), whole_group(table, "digest"), whole_group(table, "anchor")
        sides = []
        for s in np.unique(shard):
            rows = np.flatnonzero(shard == s)
            own = texts.take(pa.array(rows))
            sizes = np.array([len(x) for x in own.to_pylist()], np.int64)
            data = np.frombuffer(b"\0".join(own.to_pylist()) + b"\0", np.uint8)
            ends = np.cumsum(sizes + 1) - 1
            starts = ends - sizes
            order, rank = suffix_array(data, starts, ends)
            left = np.repeat(ends, sizes + 1) - np.arange(len(data))
            shared = common_prefixes(data, starts, ends, order, rank, length)
            sides.append((rows, data, starts, ends, order, rank, left, shared, np.zeros(len(data), bool)))
        if len(sides) == 1:
            _, _, _, _, order, rank, _, shared, flags = sides[0]
            flags |= shared >= length
            flags[order[rank[np.flatnonzero(shared >= length)] - 1]] = True
        else:  # windows that repeat in their own shard are known already
            heads = [distinct_windows(order, left, shared, length) for _, _, _, _, order, _, left, shared, _ in sides]
            for mine, theirs in ((0, 1), (1, 0)):
                alone = heads[mine][1]
                sides[mine][-1][alone[found_in(sides[mine][1], alone, sides[theirs][1], heads[theirs][0], length)]] = True
        out = []
        for rows, _, starts, ends, *_, flags in sides:
            string, first, n = _spans(flags, starts, ends)
            at = pa.array(rows[string])
            out.append(pa.table([anchor.take(at), digests.take(at), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["anchor", "digest", "span_first", "span_n"]))
        return pa.concat_tables(out)

    return work


def _fetch(length: int):
    """Of documents with a list of wanted runs: a row with the bytes of each run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column("_text"))
            wanted = batch.column("wanted")
            which = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy(zero_copy_only=False))
            flat = wanted.flatten()
            first, n = (flat.field(k).to_numpy() for k in ("first", "n"))
            begin = offsets[which] + first
            raw = memoryview(data)
            for lot in np.array_split(np.arange(len(which)), max(1, len(which) // 20_000)):
                texts = [raw[a:b].tobytes() for a, b in zip(begin[lot].tolist(), (begin[lot] + n[lot] + length - 1).tolist())]
                rows = pa.array(lot)
                yield pa.RecordBatch.from_arrays([flat.field(k).take(rows) for k in ("anchor", "digest", "lot", "shard", "shards")] + [pa.array(texts, pa.binary())], names=["anchor", "digest", "lot", "shard", "shards", "bytes"])

    return cut


# --- the operator -----------------------------------------------------------------------------------------------------


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Window starts that repeat: rows (_id, _h, spans), spans an array of (first, n) in bytes from the text's start.

    _id and _h (doc_id and a hash of id and text) name a document; equal rows share one entry.
    """
    gram = min(gram, max(1, length // 4))
    named = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("_id"), F.xxhash64(doc_id, text).alias("_h"), F.col(text).alias("_text")).filter(F.octet_length("_text") >= length)
    runs = stored(named.mapInArrow(_runs(length, gram), "anchor long, digest binary, _id long, _h long, first long, n long, twice boolean"), "runs")
    classes = stored(
        runs.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("_id", "_h", "first", "n")).alias("at"), F.max("twice").alias("twice")), "classes"
    )
    alone = F.max((F.col("copies") == 1) & F.col("twice"))  # a run of its own, whose windows may repeat in it
    several = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), alone.alias("alone")).filter("kinds > 1 or alone").select("anchor")
    open_ = stored(classes.join(several, "anchor"), "open")
    size = (F.col("at.n") + F.lit(length - 1)).alias("size")
    lots = parts(open_.agg(F.sum(size)).first()[0] or 0, shard_bytes)
    dealt = open_.withColumn("lot", F.pmod(F.xxhash64("anchor"), F.lit(lots)))
    full = dealt.groupBy("lot").agg(F.sum(size).alias("size")).select("lot", F.ceil(F.col("size") / F.lit(1.5 * shard_bytes)).cast("int").alias("shards"))
    dealt = dealt.join(full, "lot").withColumn("shard", F.pmod(F.xxhash64("digest"), F.col("shards")).cast("int"))
    wanted = dealt.groupBy(F.col("at._id").alias("_id"), F.col("at._h").alias("_h")).agg(F.collect_list(F.struct("anchor", "digest", "lot", "shard", "shards", F.col("at.first").alias("first"), F.col("at.n").alias("n"))).alias("wanted"))
    cut = named.join(wanted, ["_id", "_h"]).select("_text", "wanted").mapInArrow(_fetch(length), "anchor long, digest binary, lot long, shard int, shards int, bytes binary")
    paired = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other"))
    found = paired.groupBy("lot", F.least("shard", "other").alias("left"), F.greatest("shard", "other").alias("right")).applyInArrow(_shard(length), _FOUND)
    partly = found.groupBy("anchor", "digest").agg(F.collect_set(F.struct(F.col("span_first").alias("first"), F.col("span_n").alias("n"))).alias("spans"))
    known = stored(
        classes.filter("copies > 1").select("anchor", "digest", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("at.n").alias("n"))).alias("spans"))
        .union(partly.join(classes.filter("copies > 1"), ["anchor", "digest"], "left_anti").select("anchor", "digest", "spans")),
        "repeats",
    )
    forget(classes, open_)
    spans = F.array_distinct(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct((F.col("first") + s["first"]).alias("first"), s["n"].alias("n"))))))
    out = stored(runs.join(known, ["anchor", "digest"]).groupBy("_id", "_h").agg(spans.alias("spans")), "spans")
    forget(runs, known)
    return out


def _removed(length: int, as_text: bool):
    """Of documents with their spans: sizes, digest and kept bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column("_text"))
            raw = memoryview(data)
            spans = batch.column("spans")
            rows: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed")}
            for d, got in enumerate(spans.to_pylist()):
                own = raw[offsets[d] : offsets[d + 1]]
                merged: list[list[int]] = []
                for first, n in sorted((s["first"], s["n"]) for s in got or ()):
                    end = first + n + length - 1
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(end, merged[-1][1])
                    else:
                        merged.append([first, end])
                kept, at = [], 0
                for first, end in merged:
                    kept.append(own[at:first])
                    at = end
                kept.append(own[at:])
                left = b"".join(kept)
                rows["n_bytes"].append(len(own))
                rows["n_removed"].append(len(own) - len(left))
                rows["n_spans"].append(len(merged))
                rows["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                rows["kept"].append(left.decode("utf-8", "ignore") if as_text else left)
                rows["removed"].append([{"start": a, "end": b} for a, b in merged])
            out = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("_text", "spans")]
            names = [name for name in batch.schema.names if name not in ("_text", "spans")]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(out + [pa.array(rows[k], t) for k, t in zip(rows, types)], names=names + list(rows))

    return work


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, as_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with what is left of its text after all repeated strings of ``length`` bytes are taken out.

    Returns the columns of ``docs`` in the struct ``row`` plus n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; with
    ``as_text`` a string, without characters that a span cut) and removed (array of start and end in bytes). A byte goes if any string of ``length`` bytes that covers it starts at
    another place too, in any row, as judged on the input. A null text counts as empty; texts under ``length`` bytes stay
    whole; of equal rows each is an occurrence; ids may be null or repeat. An empty table gives an empty table.
    """
    spans = repeated_spans(docs, text, doc_id, length, gram, shard_bytes).withColumnsRenamed({"_id": "_id2", "_h": "_h2"})
    named = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("_id"), F.xxhash64(doc_id, text).alias("_h"), F.col(text).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"))
    joined = named.join(spans, (F.col("_id") == F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left").select("row", "_text", "spans")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_removed(length, as_text), f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {'string' if as_text else 'binary'}, removed array<struct<start:long,end:long>>")


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings taken out of its texts; a character cut by a span goes whole.

    The columns and their order stay; n_chars, where there is one, is counted again.
    """
    done = suffix_dedup(docs, text, doc_id, length, as_text=True).withColumnRenamed("kept", "_text")
    out = [F.col("_text").alias(c) if c == text else F.length("_text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return done.select(*out)
