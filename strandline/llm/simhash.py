"""Near-duplicate documents by SimHash fingerprints, with pigeonring filtering of the candidates.

A 64-bit fingerprint is cut into four segments laid out in a ring. If two fingerprints differ in at most three bits, some
segment starts a chain whose first 1, 2, 3 and 4 segments differ in at most 0, 1, 2 and 3 bits: each part of the chain
stays within its share of the budget. So candidates agree in one segment and differ in at most one bit of the next, are
dropped as soon as a longer chain is over its share, and meet the full Hamming check as the chain of length four.

The pipeline's stage looks wider: ten fingerprints a text, made of differently mixed hashes of its shingles of five words,
and seven bits in eight segments for each. Texts with a Jaccard similarity of 0.8 are expected to differ in nine or ten bits,
so one fingerprint meets about a quarter of such pairs, ten meet over nine tenths. What those links connect is then checked
pair by pair: only texts whose sets of shingles have a similarity of at least 0.8 stay linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import components, forget, join_hot, local_components, parts, row_keys, stored, text_arrays, whole_group

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = 4
#: The pipeline's stage: words of a shingle, bits, segments, least Jaccard similarity of the shingles of two near copies.
STAGE_SHINGLE, STAGE_DISTANCE, STAGE_SEGMENTS, STAGE_LEAST = 5, 7, 8, 0.8
#: Fingerprints of a text in the stage, and how many of all texts' may share one segment before it is dealt on.
STAGE_PRINTS, STAGE_HOT_SEGMENT = 10, 500_000
#: Keys dealt to one group of the candidate search.
GROUP_ROWS = 20_000
#: Fingerprints that may share one segment before their keys are dealt on by the next segment.
HOT_SEGMENT = 50_000
#: Bytes of texts in a block of a group of near copies; a task compares two blocks at most.
BLOCK_BYTES = 16_000_000
_PAIRS = 1_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles: bit b is set if it is set in over half of their hashes."""
    words = text.lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, counts = len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, n, 100_000):
        some = words[at : at + 100_000 + shingle - 1]
        grams = map(b" ".join, zip(*(some[k:] for k in range(shingle))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(some) - shingle + 1)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column("_text"))
            raw, cut = memoryview(data), offsets.tolist()
            found = [fingerprint(raw[a:b].tobytes(), shingle) for a, b in zip(cut, cut[1:])]
            rest = [name for name in batch.schema.names if name != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in rest), pa.array(np.array(found, np.uint64).view(np.int64))], names=[*rest, "fp"])

    return work


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, h, fp): the id, a hash of the text, and the fingerprint."""
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("_text"))
    return named.mapInArrow(_fingerprints(shingle), "doc_id long, h long, fp long")


def several_prints(text: bytes, shingle: int = STAGE_SHINGLE, prints: int = STAGE_PRINTS) -> np.ndarray:
    """Fingerprints of a text's set of shingles, each by hashes mixed in another way; the first by the hashes themselves."""
    h = _shingles(text, shingle)
    salts = np.arange(prints, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros((prints, 64), np.int64)
    for at in range(0, len(h), 255):  # sums of up to 255 bits fit a byte
        mixed = _mixed(h[at : at + 255, None] ^ salts)
        mixed[:, 0] = h[at : at + 255]
        bits = np.unpackbits(mixed.view(np.uint8).reshape(len(mixed), -1), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8).reshape(prints, 64)
    return np.packbits(2 * counts > len(h), axis=1, bitorder="little").view(np.uint64)[:, 0]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of 64 depends on every other."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def _several(shingle: int, prints: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch.column("_text"))
            raw, cut = memoryview(data), offsets.tolist()
            found = [several_prints(raw[a:b].tobytes(), shingle, prints).view(np.int64) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "h", "fps"])

    return work


def _turned(fp: np.ndarray, start: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprints with the ring turned so that segment ``start`` comes first, the others after it."""
    shift = (np.uint64(bits) * start.astype(np.uint64)) & np.uint64(63)
    back = (np.uint64(64) - shift) & np.uint64(63)
    return np.where(shift == 0, fp, fp << shift | fp >> back)


def _flips(distance: int, segments: int, ways: int, spent: int = 0, at: int = 2) -> Iterator[int]:
    """What a key of ``ways`` segments may differ by: nothing in the first, then each chain within its share."""
    if at > ways:
        yield 0
        return
    bits = 64 // segments
    for n in range(at * distance // segments - spent + 1):
        for places in combinations(range(bits), n):
            for rest in _flips(distance, segments, ways, spent + n, at + 1):
                yield sum(1 << k for k in places) << bits * (ways - at) | rest


class _Links:
    """Links between numbered fingerprints, kept as a forest."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            star = np.flatnonzero(self.label != np.arange(len(self.label)))
            self.label = local_components(len(self.label), np.concatenate([a, star]), np.concatenate([b, self.label[star]]))


def _join(links: _Links, left: np.ndarray, key: np.ndarray, a: np.ndarray, right: np.ndarray, sorted_key: np.ndarray, b: np.ndarray, distance: int, segments: int) -> None:
    """Link fingerprints a and b whose keys agree and whose chains stay within budget. left, right: turned fingerprints."""
    low, high = np.searchsorted(sorted_key, key, "left"), np.searchsorted(sorted_key, key, "right")
    size = high - low
    some = np.flatnonzero(size)
    total = np.cumsum(size[some])
    at = 0
    while at < len(some):
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + _PAIRS, "right")))
        lot = some[at:stop]
        for first in range(0, int(size[lot].max()), _PAIRS):  # one key may have more
            n = np.clip(size[lot] - first, 0, _PAIRS)
            i = np.repeat(lot, n)
            j = np.repeat(low[lot] + first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keep = a[i] != b[j]
            i, j = i[keep], j[keep]
            x = left[i] ^ right[j]
            for length in range(2, segments + 1):
                near = np.bitwise_count(x >> np.uint64(64 - 64 // segments * length)) <= length * distance // segments
                i, j, x = i[near], j[near], x[near]
            links.add(a[i], b[j])
        at = stop


def _linked(distance: int, segments: int):
    bits = 64 // segments
    ways = max(2, 24 // bits)  # segments in a key: the more, the fewer candidates by chance
    flips = list(_flips(distance, segments, ways))
    beyond = sorted({f & (1 << bits * (ways - 2)) - 1 for f in flips})  # the same after the second segment
    past, low = np.uint64(64 - bits * ways), np.uint64(bits * (ways - 2))
    second = np.uint64((1 << bits) - 1) << low

    def work(table: pa.Table) -> pa.Table:
        """Of keys (fp, start, near, own): links as stars (a, b) around the smallest of each local component.

        near null: the fingerprint's own next segment, to be met by those one bit off too; else the segment that this row
        stands for in a hot group, own or one bit off.
        """
        fp = whole_group(table, "fp").to_numpy().view(np.uint64)
        start = whole_group(table, "start").to_numpy()
        near = whole_group(table, "near")
        hot = near.is_valid().to_numpy(zero_copy_only=False)
        near = near.fill_null(0).to_numpy().astype(np.uint64)
        own = whole_group(table, "own").to_numpy(zero_copy_only=False)
        nodes, number = np.unique(fp, return_inverse=True)
        links = _Links(len(nodes))
        turned = _turned(fp, start, bits)
        for s in range(segments):
            rows = np.flatnonzero((start == s) & ~hot)
            if len(rows):
                rows = rows[np.argsort(turned[rows], kind="stable")]
                key = turned[rows] >> past
                for flip in flips:
                    _join(links, turned[rows], key ^ np.uint64(flip), number[rows], turned[rows], key, number[rows], distance, segments)
            rows = np.flatnonzero((start == s) & hot)
            if len(rows):
                key = turned[rows] >> past & ~second | near[rows] << low
                mine = np.flatnonzero(own[rows])
                mine = mine[np.argsort(key[mine], kind="stable")]
                for flip in beyond:
                    _join(links, turned[rows], key ^ np.uint64(flip), number[rows], turned[rows][mine], key[mine], number[rows][mine], distance, segments)
        moved = np.flatnonzero(links.label != np.arange(len(nodes)))
        return pa.table({"a": nodes[links.label[moved]].view(np.int64), "b": nodes[moved].view(np.int64)})

    return work


def links(fps: DataFrame, hot_segment: int = HOT_SEGMENT, group_rows: int = GROUP_ROWS, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Of distinct fingerprints (column fp): rows (a, b) that connect just those within ``distance`` bits.

    ``segments`` divides 64, is over ``distance`` and such that a chain of two may differ in at most one bit.
    """
    if 64 % segments or distance >= segments or 2 * distance // segments > 1:
        raise ValueError(f"no ring of {segments} segments for {distance} bits")
    total, bits = fps.count(), 64 // segments
    segment = lambda k: F.shiftrightunsigned("fp", 64 - bits) if k == 0 else F.shiftrightunsigned("fp", 64 - bits * (k + 1)).bitwiseAND(F.lit((1 << bits) - 1))
    keys = fps.select("fp", F.posexplode(F.array(*[segment(k) for k in range(segments)])).alias("start", "segment"))
    following = F.element_at(F.array(*[segment((k + 1) % segments) for k in range(segments)]), F.col("start") + 1)
    groups = parts(segments * total, group_rows)
    dealt = F.pmod(F.xxhash64("start", "segment"), F.lit(groups)).alias("lot")
    none, yes = F.lit(None).cast("long").alias("near"), F.lit(True).alias("own")
    full = stored(keys.groupBy("start", "segment").count().filter(F.col("count") > hot_segment).select("start", "segment", F.lit(True).alias("is_hot")), "hot")
    if full.isEmpty():
        rows = keys.select("fp", "start", none, yes, dealt)
    else:
        marked = keys.join(full, ["start", "segment"], "left").withColumn("following", following)
        flips = F.array(*[F.lit(k).cast("long") for k in (0, *(1 << b for b in range(bits)))])
        spread = marked.filter("is_hot").select("fp", "start", "segment", "following", F.explode(flips).alias("flip"))
        spread = spread.select("fp", "start", "segment", F.col("following").bitwiseXOR(F.col("flip")).alias("near"), (F.col("flip") == 0).alias("own"))
        rows = marked.filter("is_hot is null").select("fp", "start", none, yes, dealt).union(
            spread.select("fp", "start", "near", "own", F.pmod(F.xxhash64("start", "segment", "near"), F.lit(groups)).alias("lot"))
        )
    return rows.groupBy("lot").applyInArrow(_linked(distance, segments), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot_segment: int = HOT_SEGMENT, group_rows: int = GROUP_ROWS, shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """One row for each of ``docs``: doc_id, h (hash of its text), fp and component_id, the smallest doc_id reachable.

    A null or empty text has fingerprint zero and links like any other; equal rows stay; a null id is never the smallest
    unless all ids of a component are null. An empty table gives an empty table.
    """
    narrow = stored(fingerprints(docs, text, doc_id, shingle), "fingerprints")
    fps = stored(narrow.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    reached = components(stored(links(fps.select("fp"), hot_segment, group_rows, distance, segments), "pairs"))
    grouped = fps.join(reached, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "root2")
    named = stored(grouped.join(smallest, F.col("root") == F.col("root2")).select("fp", "n", "component_id", "root"), "named")
    return join_hot(narrow, named, "fp", ["doc_id", "h"], "n").select("doc_id", "h", "fp", "component_id", "root")


def _shingles(text: bytes, shingle: int) -> np.ndarray:
    """The set of a text's word shingles, as sorted hashes; of fewer words, the text's words as one."""
    words = text.lower().split()
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def _checked(distance: int, least: float, shingle: int):
    def work(table: pa.Table) -> pa.Table:
        """Of the texts (h, fps, _text) of one group, or of two blocks of it: stars (a, b) around the smallest hash of those
        that similar pairs connect."""
        table = table.take(pa.array(np.argsort(whole_group(table, "h").to_numpy(), kind="stable")))
        h, fps = whole_group(table, "h").to_numpy(), whole_group(table, "fps").flatten().to_numpy().view(np.uint64).reshape(len(table), -1)
        data, offsets = text_arrays(table.column("_text"))
        raw, at = memoryview(data), offsets.tolist()
        sets = [_shingles(raw[a:b].tobytes(), shingle) for a, b in zip(at, at[1:])]
        label, apart = np.arange(len(h)), len(h)
        for i in range(len(h)):
            if apart == 1:
                break
            open_ = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            for j in open_[(np.bitwise_count(fps[open_] ^ fps[i]) <= distance).any(axis=1)].tolist():
                if label[i] != label[j] and _alike(sets[i], sets[j], least):
                    low, high = sorted((label[i], label[j]))
                    label[label == high] = low
                    apart -= 1
        moved = np.flatnonzero(label != np.arange(len(h)))
        return pa.table({"a": h[label[moved]], "b": h[moved]})

    return work


def _in_blocks(texts: DataFrame, block_bytes: int, block_rows: int) -> DataFrame:
    """``texts`` (root, h, fps, _text) with the columns i and j: what is equal in root, i and j is to be compared.

    A group of more bytes or rows than a block holds is cut into blocks by hash, and each of its rows goes to every pair of
    blocks that has its own. So a task sees two blocks at most, and any two texts of a group meet.
    """
    size = F.sum(F.octet_length("_text").cast("long"))
    blocks = F.greatest(F.ceil(size / block_bytes), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias("blocks")
    large = texts.groupBy("root").agg(blocks).filter("blocks > 1").select(F.col("root").alias("root2"), "blocks")
    own = F.pmod(F.col("h"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: k != own)
    pairs = F.transform(others, lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    met = texts.join(large, F.col("root") == F.col("root2"), "left")
    return met.select("root", "h", "fps", "_text", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(pairs)).alias("p")).select("root", "p.i", "p.j", "h", "fps", "_text")


def similar(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = STAGE_SHINGLE, distance: int = STAGE_DISTANCE, segments: int = STAGE_SEGMENTS, least: float = STAGE_LEAST,
    block_bytes: int = BLOCK_BYTES, block_rows: int = GROUP_ROWS, prints: int = STAGE_PRINTS, hot_segment: int = STAGE_HOT_SEGMENT,
) -> DataFrame:
    """One row (doc_id, h, root) for each of ``docs``: equal root for texts linked by pairs that are within ``distance``
    bits in one of ``prints`` fingerprints and whose sets of shingles have a Jaccard similarity of at least ``least``.

    All fingerprints go through the same search; two that belong to different mixings are as far apart as any two texts'.
    Only texts that their bits connect to another text are read again, one of each; they meet by groups, and of large groups
    by pairs of blocks. What the tasks find linked is connected by components. A null text is empty; equal rows stay.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("_text"))
    narrow = stored(named.mapInArrow(_several(shingle, prints), "doc_id long, h long, fps array<long>"), "prints")
    texts = narrow.groupBy("h").agg(F.min("doc_id").alias("_id"), F.min("fps").alias("fps"))
    texts = stored(texts, "distinct")
    each = texts.select("h", F.explode("fps").alias("fp"))
    pairs = stored(links(stored(each.select("fp").distinct(), "fps"), hot_segment, GROUP_ROWS, distance, segments), "pairs")
    reached = components(pairs)
    placed = each.join(reached, F.col("fp") == F.col("node"), "left").select("h", F.coalesce("component", "fp").alias("at")).distinct()
    several = placed.groupBy("at").count().filter("count > 1").select(F.col("at").alias("at2"))
    met = stored(placed.join(several, F.col("at") == F.col("at2")).select(F.col("h").alias("a"), F.col("at").alias("b")), "met")
    roots = components(met).withColumnRenamed("component", "root")
    one = stored(texts.join(roots, F.col("h") == F.col("node")).select("_id", F.col("h").alias("_h"), "fps", "root"), "candidates")
    one, meant = row_keys(one, docs, doc_id, text)
    _, h, fps, root = (one[c] for c in one.columns)
    found = docs.join(one, meant).select(root.alias("root"), h.alias("h"), fps.alias("fps"), docs[f"`{text}`"].alias("_text")).dropDuplicates(["root", "h"])
    found = stored(found, "texts")
    alike = stored(_in_blocks(found, block_bytes, block_rows).groupBy("root", "i", "j").applyInArrow(_checked(distance, least, shingle), "a long, b long"), "alike")
    forget(found)
    groups = components(alike)
    return narrow.join(groups, F.col("h") == F.col("node"), "left").select("doc_id", "h", F.coalesce("component", "h").alias("root"))


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of ``similar``: that of the smallest id (of equal ids, of the smallest text hash)."""
    found = stored(similar(docs, text, doc_id), "similar")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h")))
    kept = stored(found.groupBy("root").agg(first.alias("f")).select(F.col("f.id").alias("_id"), F.col("f.h").alias("_h")), "kept")
    again = found.groupBy("doc_id", "h").count().filter("count > 1").join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi")
    several = again.limit(1).count()
    kept, meant = row_keys(kept, docs, doc_id, text)
    rows = docs.join(kept, meant)
    if several:  # equal rows: one of them
        rows = rows.dropDuplicates(kept.columns)
    return rows.select(*[docs[f"`{c}`"] for c in docs.columns])
