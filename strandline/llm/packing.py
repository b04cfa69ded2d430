"""Packing tokenized documents into sequences of bounded length by bounded-space online best fit."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm.common import parts, text_arrays, whole_group

LENGTH = 2048
END = 0
#: Sequences that are open at a time in one group.
OPEN = 128
#: Pieces that arrive together, the longest first.
ARRIVAL = 512
#: Documents whose pieces are packed together.
GROUP_DOCS = 16_384
#: Words whose ids a task keeps, in two generations.
KEPT_WORDS = 600_000
#: Bytes of texts whose new words the tokenizer gets together.
LOT_BYTES = 1_000_000
#: Words in one text for the tokenizer.
JOINED = 64
#: ASCII marks at a word's end, after a letter or digit of ASCII or a letter of Latin-1, which normalising leaves as one.
_MARKS = re.compile(rb"[!-/:-@\[-`{-~](?:(?<=[0-9a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[!-/:-@\[-`{-~]*+(?!\S)")


def _is_letters(word: bytes) -> bool:
    """Whether all characters are letters of Latin-1."""
    return word.isalpha() or (text := word.decode()).isalpha() and max(text) <= "ÿ"


class WordIds(dict):
    """Token ids of words, as little-endian 32-bit numbers. Words are UTF-8 bytes without ASCII white space."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        #: The generation before this one: what is met again moves on, the rest goes with it.
        self.before: dict[bytes, bytes] = {}
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.is_last = np.zeros(max(vocab.values(), default=0) + 1, bool)  # whether an id ends a token run
        self.is_last[[i for token, i in vocab.items() if suffix and token.endswith(suffix)]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, words: list[bytes]) -> None:
        """Keep the ids of ``words``, each of letters alone and so one token run, by a few calls for all of them."""
        texts = [b" ".join(words[k : k + JOINED]).decode() for k in range(0, len(words), JOINED)]
        ids = np.fromiter(chain.from_iterable(x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), "<u4")
        ends = 4 * (np.flatnonzero(self.is_last[ids]) + 1)
        if len(ends) == len(words):
            raw, ends = ids.tobytes(), ends.tolist()
            self.update(zip(words, (raw[a:b] for a, b in zip([0, *ends], ends))))
        else:  # a tokenizer that doesn't tell where a run ends
            self.update((word, self.whole(word.decode())) for word in words)

    def learn(self, words: set[bytes]) -> None:
        """Keep the ids of ``words``, which aren't kept yet."""
        letters = []
        for word in words:
            if (ids := self.before.get(word)) is not None:
                self[word] = ids
            elif _is_letters(word):
                letters.append(word)
            else:
                self[word] = self.whole(word.decode())
        if letters:
            self._encode(letters)

    def texts(self, raws: list[bytes]) -> list[bytes]:
        """Ids of whole texts. White space ends words for the tokenizer too, and it folds case itself."""
        found, unknown, new = [], [], set()
        for raw in raws:
            if b"<|" in raw:  # may hold a special token, which is matched before case is folded
                found.append([self.whole(raw.decode())])
                continue
            words = _MARKS.sub(rb" \g<0>", raw.lower()).split()  # such marks are a token run of their own
            ids = list(map(self.get, words))
            at = [k for k, x in enumerate(ids) if x is None]
            found.append(ids)
            unknown.append((ids, at, [words[k] for k in at]))
            new.update(unknown[-1][2])
        self.learn(new)
        for ids, at, words in unknown:
            for k, word in zip(at, words):
                ids[k] = self[word]
        return list(map(b"".join, found))

    def text(self, raw: bytes) -> bytes:
        return self.texts([raw])[0]

    def trim(self, most: int) -> None:
        if 2 * len(self) > most:
            self.before = dict(self)
            self.clear()

    def drop(self) -> None:
        """Keep no ids: a worker outlives its task, and tasks of other steps have its executor's memory then."""
        self.before = {}
        self.clear()


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _with_ids(words: WordIds, raw: memoryview, at: list[int]) -> Iterator[tuple[bytes, bytes]]:
    """Each text of ``raw`` with its ids; texts are taken in lots of ``LOT_BYTES`` or one longer text."""
    lot, size = [], 0
    for a, b in zip(at, at[1:]):
        if lot and size + b - a > LOT_BYTES:
            yield from zip(lot, words.texts(lot))
            words.trim(KEPT_WORDS)
            lot, size = [], 0
        lot.append(raw[a:b].tobytes())
        size += b - a
    yield from zip(lot, words.texts(lot))
    words.trim(KEPT_WORDS)


def _pieces(path: str, length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        try:
            yield from with_words(words, batches)
        finally:
            words.drop()

    def with_words(words: WordIds, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, task = {}, TaskContext.get().partitionId()
        for batch in batches:
            data, offsets = text_arrays(batch.column("_text"))
            raw, at = memoryview(data), offsets.tolist()
            rows, piece, size, crc, salt = [], [], [], [], []
            for d, ((own, ids), doc) in enumerate(zip(_with_ids(words, raw, at), batch.column("doc_id").to_pylist())):
                ids += END.to_bytes(4, "little")
                key = doc, xxhash.xxh64_intdigest(own)
                copies[key] = copy = copies.get(key, -1) + 1
                mixed = xxhash.xxh64_intdigest(f"{key} {copy} {task}") >> 1
                for k in range(0, len(ids), 4 * length):
                    part = ids[k : k + 4 * length]
                    rows.append(d)
                    piece.append(k // (4 * length))
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    salt.append(mixed)
            piece = np.array(piece, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece.astype(np.int32)), pa.array(piece * length), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(salt, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"],
            )

    return cut


def best_fit(sizes: list[int], length: int, most_open: int) -> tuple[list[int], list[int]]:
    """The bin and the place in it of each item, in the order given.

    An item goes to the open bin with the least free space that holds it, found in a bitset of the free spaces there
    are. If none does, a bin is opened; if that would be one too many, the fullest open one closes first.
    """
    free_bins: list[list[int]] = [[] for _ in range(length + 1)]
    bits = count = opened = 0
    bins, places = [], []
    for size in sizes:
        fits = bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            own = free_bins[free].pop()
            if not free_bins[free]:
                bits ^= 1 << free
            opened -= 1
        else:
            if opened == most_open:
                fullest = (bits & -bits).bit_length() - 1
                free_bins[fullest].pop()
                if not free_bins[fullest]:
                    bits ^= 1 << fullest
                opened -= 1
            free, own, count = length, count, count + 1
        bins.append(own)
        places.append(length - free)
        if left := free - size:
            free_bins[left].append(own)
            bits |= 1 << left
            opened += 1
    return bins, places


def _packed(length: int, most_open: int, arrival: int):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("mix", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes, lot = whole_group(table, "length").to_numpy(), whole_group(table, "lot").to_numpy()
        order = np.lexsort((-sizes, np.arange(len(sizes)) // arrival))
        table = table.take(pa.array(order)).drop_columns(["lot", "mix"])
        bins, places = best_fit(sizes[order].tolist(), length, most_open)
        table = table.append_column("sequence_id", pa.array((lot << 32) + np.array(bins, np.int64)))
        return table.append_column("offset", pa.array(places, pa.int64()))

    return work


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, length: int = LENGTH, most_open: int = OPEN, arrival: int = ARRIVAL, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row for each piece of each of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and the id 0 (a null or empty text: that alone), cut only if longer than ``length``, into
    pieces of that length and a last one. Pieces are dealt to groups by a hash of document, text and piece (equal rows are
    told apart by their number in the task that reads them) and arrive in that hash's order, ``arrival`` at a time, of
    these the longest first. A group has ``most_open`` open sequences at most. Equal rows are packed each; ids may be null.
    An empty table gives an empty table.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    groups = parts(docs.count(), group_docs)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    cut = named.mapInArrow(_pieces(path, length), "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")
    mixed = cut.withColumn("mix", F.xxhash64("salt", "piece")).drop("salt").withColumn("lot", F.pmod("mix", F.lit(groups).cast("long")))
    return mixed.groupBy("lot").applyInArrow(_packed(length, most_open, arrival), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
