"""Language identification by character language models with interpolated Kneser-Ney smoothing.

Training counts the character 4-grams of every labelled text, by language, as Spark aggregates. Lower orders, discounts
and back-off weights follow from those counts; each language's model is a set of sorted arrays of packed n-grams that are
looked up by binary search. Tables too large for one broadcast are cut into shares by the two middle characters of a 4-gram:
all that an n-gram's probability needs is in its share, so each share is read by a pass of its own over the texts, and the
passes' bits (whole numbers, so that their sum doesn't depend on the cuts) are added up. A text goes to the language of lowest cross-entropy per character. How sure that is comes from
a monotone fit, over labelled texts that weren't counted, of how often the choice was right at its lead over the runner-up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import parts, row_keys, stored

ORDER = 4
BITS = 12
_SYMBOLS = 1 << BITS
#: A text is read in stretches of at most so many characters, each begun afresh.
STRETCH = 500_000
#: n-gram types of all languages in one share (bounds what a pass sends to executors, about 100 bytes a type).
SHARE_TYPES = 1_500_000
#: Parts of a bit in which n-grams' information is added.
FINE = 1 << 20
#: A text is rejected if the chance that its predicted language is right is not over that of a guess among the languages by
#: this part of what is left to certainty, or ...
LEAST_OVER_CHANCE = 0.1
#: ... its cross-entropy is over this quantile of its language's texts by so many bits (an unlearned language or random
#: letters are four bits and more over it).
QUANTILE, MOST_BITS = 0.9, 2.0
#: Where a language has so many rows to learn from, one in ``APART`` is set aside: it isn't counted, and score and ceiling are
#: fitted on such rows. A language of fewer rows is fitted on those it learns from.
MANY_ROWS, APART = 64, 8
UNDECIDED = "und"


@lru_cache(1)
def _folding() -> np.ndarray:
    """The symbol of each code point: letters by their lower-case form, all else 0."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            table[c] = 1 + ord(x.lower()[0]) % (_SYMBOLS - 1)
    return table


def _stretches(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Lists of (text number, stretch) of about ``STRETCH`` characters."""
    rows, held, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text or ""), STRETCH):
            part = text[at : at + STRETCH]
            if size + len(part) > 2 * STRETCH:
                yield rows, held
                rows, held, size = [], [], 0
            rows.append(k)
            held.append(part)
            size += len(part)
    if held:
        yield rows, held


def codes(held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of all stretches, and where each stretch's begin (with the end). Runs of other characters are one."""
    joined = "\n".join(["", *held, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    symbols = _folding()[points]
    sizes = np.array([len(x) + 1 for x in held])
    begins = np.concatenate([[0], np.cumsum(sizes)])  # of the line ends before each stretch, and the last one
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    keep[begins] = True
    place = np.cumsum(keep) - 1
    symbols, first = symbols[keep], place[begins]
    n = len(symbols)
    since = np.arange(n) - np.repeat(first[:-1], np.diff(np.append(first[:-1], n)))
    code = symbols.copy()
    for k in range(1, ORDER):
        before = np.zeros(n, np.int64)
        before[k:] = symbols[:-k]
        code |= np.where(since >= k, before, 0) << (BITS * k)
    # a stretch's n-grams end at its characters and at the line end after it
    return code[1:], first


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (code, n) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code), pa.array(n)], names=["lang", "code", "n"])

    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, []).append(text)
        for lang, texts in by_lang.items():
            for _, held in _stretches(texts):
                code, n = np.unique(codes(held)[0], return_counts=True)
                if lang in totals:
                    old, m = totals[lang]
                    code, at = np.unique(np.concatenate([old, code]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([m, n])).astype(np.int64)
                totals[lang] = code, n
        if sum(len(x) for x, _ in totals.values()) > 1_000_000:
            yield from out()
            totals.clear()
    yield from out()


def _lower(code: np.ndarray, order: int) -> np.ndarray:
    """The n-grams of ``order`` characters at the ends of longer ones."""
    return code & ((1 << BITS * order) - 1)


def _discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


class Model:
    """One language's n-gram model, or a share of it: sorted arrays of packed n-grams and contexts, for each order."""

    def __init__(self, code: np.ndarray, count: np.ndarray, lower: dict[int, tuple[np.ndarray, np.ndarray]] | None = None, discounts: dict[int, float] | None = None):
        """code, count: 4-grams. For a share: lower has the n-grams and counts of orders 1 and 2, discounts those of all orders."""
        self.levels = []
        for order in range(ORDER, 0, -1):
            if order < ORDER:
                given = (lower or {}).get(order)
                code, count = given or np.unique(_lower(code, order), return_counts=True)  # how many stand before it
            sort = np.argsort(code)
            code, count = code[sort].astype(np.int64), count[sort].astype(np.float64)
            discount = discounts[order] if discounts else _discount((count == 1).sum(), (count == 2).sum())
            context, at = np.unique(code >> BITS, return_inverse=True)
            total, kinds = np.bincount(at, count), np.bincount(at)
            self.levels.append((code, (count - discount).clip(0) / total[at], context, discount * kinds / total))
        self.levels.reverse()

    def log2(self, code: np.ndarray) -> np.ndarray:
        """log2 of each n-gram's probability of its last character."""
        p = np.full(len(code), 1 / _SYMBOLS)
        for order, (grams, own, contexts, back) in enumerate(self.levels, 1):
            key = _lower(code, order)
            p = _looked_up(contexts, back, key >> BITS, 1.0) * p + _looked_up(grams, own, key, 0.0)
        return np.log2(p)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


def _middle(code):
    """A 4-gram's two middle characters, the third first: by ranges of it shares are cut."""
    second, third = code >> 2 * BITS & _SYMBOLS - 1, code >> BITS & _SYMBOLS - 1
    return third << BITS | second


def _summed(share):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang, low, high = share.value
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            bits, letters = np.zeros((len(by_lang), len(texts)), np.int64), np.zeros(len(texts), np.int64)
            n = np.zeros(len(texts), np.int64)
            for rows, held in _stretches(texts):
                code, first = codes(held)
                kinds = np.sort(code)
                kinds = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])]
                at = np.searchsorted(kinds, code)
                begin, rows = first[:-1], np.array(rows)
                np.add.at(n, rows, np.diff(first))
                np.add.at(letters, rows, np.add.reduceat((code & (_SYMBOLS - 1) != 0).astype(np.int64), begin))
                if high - low == 1 << 2 * BITS:
                    own = slice(None)
                else:
                    middle = _middle(kinds)
                    own = np.flatnonzero((middle >= low) & (middle < high))
                for k, model in enumerate(by_lang):
                    each = np.zeros(len(kinds), np.int64)
                    each[own] = np.rint(-FINE * model.log2(kinds[own]))
                    np.add.at(bits[k], rows, np.add.reduceat(each[at], begin))
            rest = [name for name in batch.schema.names if name != "_text"]
            sums = pa.FixedSizeListArray.from_arrays(pa.array(bits.T.ravel()), len(by_lang)).cast(pa.list_(pa.int64())) if len(by_lang) else pa.array([[]] * len(texts), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in rest), pa.array(letters), pa.array(n), sums], names=[*rest, "letters", "n", "bits"])

    return work


def _judged(langs: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            letters, n = batch.column("letters").to_numpy(), batch.column("n").to_numpy()
            bits = batch.column("bits").flatten().to_numpy(zero_copy_only=False).reshape(rows, len(langs)).T / FINE
            known = (letters > 0) if len(langs) else np.zeros(rows, bool)
            sort = np.argsort(bits, axis=0, kind="stable") if len(langs) else np.zeros((1, rows), np.int64)
            each = np.arange(rows)
            best = bits[sort[0], each] if len(langs) else n
            lead = bits[sort[1], each] - best if len(langs) > 1 else np.full(rows, 1e3)
            named = np.array([*langs, UNDECIDED], object)[np.where(known, sort[0], len(langs))]
            rest = [name for name in batch.schema.names if name not in ("letters", "n", "bits")]
            out = [pa.array(named.tolist(), pa.string()), pa.array(best / np.maximum(n, 1)), pa.array(np.minimum(160, 8 * np.log2(1 + lead)).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in rest), *out], names=[*rest, "lang_pred", "entropy", "step"])

    return work


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 1 when divided by 3; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


class Counts:
    """The counts of all languages' n-grams as stored tables, of which shares are read."""

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", share_types: int = SHARE_TYPES):
        """Of the labelled rows of ``docs``; rows with a null text or label teach nothing."""
        labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
        table = stored(labelled.mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "ngrams")
        self.tables = {ORDER: table}
        found = []
        for order in range(ORDER, 0, -1):
            if order < ORDER:
                code = F.col("code").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("code")
                table = table.select("lang", code).groupBy("lang", "code").agg(F.count(F.lit(1)).alias("n"))
                self.tables[order] = table = stored(table, "ngrams")
            found += [(order, r) for r in table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")).collect()]  # one for each language
        self.discounts: dict[str, dict[int, float]] = {}
        for order, r in found:
            self.discounts.setdefault(r["lang"], {})[order] = _discount(r["ones"], r["twos"])
        self.langs = sorted(self.discounts)
        middle = lambda code: F.shiftleft(F.shiftright(code, BITS).bitwiseAND(F.lit(_SYMBOLS - 1)), BITS).bitwiseOR(F.shiftright(code, 2 * BITS).bitwiseAND(F.lit(_SYMBOLS - 1)))
        self.tables[ORDER] = self.tables[ORDER].withColumn("middle", middle(F.col("code")))
        shares = parts(self.tables[ORDER].count(), share_types)
        cuts = self.tables[ORDER].approxQuantile("middle", [k / shares for k in range(1, shares)], 0.1 / shares) if shares > 1 else []
        ends = [0, *sorted({int(x) for x in cuts} - {0}), 1 << 2 * BITS]
        self.ranges = list(zip(ends, ends[1:]))

    def share(self, low: int, high: int) -> list[Model]:
        """Models of all languages, for n-grams whose middle is in low to high - 1."""
        first = F.shiftright("code", BITS)  # of two characters: the third of a 4-gram
        narrowed = {ORDER: self.tables[ORDER].filter((F.col("middle") >= low) & (F.col("middle") < high)), 2: self.tables[2].filter((first >= low >> BITS) & (first <= high - 1 >> BITS)), 1: self.tables[1]}
        none = np.zeros(0, np.int64)
        by_lang = {x: {order: (none, none) for order in narrowed} for x in self.langs}
        for order, table in narrowed.items():
            for x, own in table.select("lang", "code", "n").toPandas().groupby("lang"):
                by_lang[x][order] = own["code"].to_numpy(), own["n"].to_numpy()
        return [Model(*own.pop(ORDER), own, self.discounts[x]) for x, own in by_lang.items()]


def _scored(docs: DataFrame, counts: Counts) -> DataFrame:
    """``docs`` (columns of plain types, and _text) with lang_pred, entropy and step instead of _text, in any order."""
    context, key = docs.sparkSession.sparkContext, [c for c in docs.columns if c != "_text"]
    own = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in key)
    judged, out = _judged(counts.langs), f"{own}, lang_pred string, entropy double, step int"
    passes = None
    for low, high in counts.ranges:
        shared = context.broadcast((counts.share(low, high), low, high))
        summed = _summed(shared)
        if len(counts.ranges) == 1:  # in one Python worker
            return docs.mapInArrow(lambda batches: judged(summed(batches)), out)
        sums = stored(docs.mapInArrow(summed, f"{own}, letters long, n long, bits array<long>"), "pass")
        shared.destroy()
        passes = sums if passes is None else passes.union(sums)
    rows = (F.count(F.lit(1)) / len(counts.ranges)).cast("long")  # equal rows have equal sums
    added = [F.sum(F.col("bits")[k]).alias(f"b{k}") for k in range(len(counts.langs))]
    met = passes.groupBy(*key).agg(rows.alias("rows"), F.first("letters").alias("letters"), F.first("n").alias("n"), *added)
    bits = F.array(*[F.expr(f"b{k} div rows") for k in range(len(counts.langs))]).alias("bits")
    met = met.select(*key, "letters", "n", bits, F.explode(F.expr("sequence(1L, rows)")).alias("_row")).drop("_row")
    return met.mapInArrow(judged, out)


def _monotone(right: np.ndarray, n: np.ndarray, prior: float) -> np.ndarray:
    """Non-decreasing fit of right/n: neighbours that go down are pooled, and ``prior`` counts as two more rows of each pool.

    A step has its pool's share of right rows as far as the pool's rows up to that step bear it out: where a pool begins, on few
    rows, it is nearer to ``prior``.
    """
    pools: list[list[float]] = []
    for a, b in zip(right, n):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b, k = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + k]
    out, at = [], 0
    for a, b, k in pools:
        seen = np.cumsum(n[at : at + int(k)])
        out.append((seen * a / b + 2 * prior) / (seen + 2))
        at += int(k)
    return np.maximum.accumulate(np.concatenate(out))  # a pool may begin lower than the one before it ends


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", share_types: int = SHARE_TYPES) -> DataFrame:
    """One row for each of ``docs``: doc_id, h (hash of the text), held_out, lang_pred, score, rejected.

    Only rows that aren't held out and have text and label teach; neither label nor id is an input of a prediction.
    Texts that are null or have no letter are ``und`` with score 0 and rejected, as is all if nothing teaches. score is
    the calibrated chance of being right. What stands between letters isn't judged: a text that is mostly signs goes by the
    letters it has. Equal rows are judged alike. An empty table gives an empty table.
    """
    label = F.col(lang).cast("string")
    teach = ~held_out(doc_id) & F.col(doc_id).isNotNull() & label.isNotNull() & F.col(text).isNotNull()
    many = [r["lang"] for r in docs.filter(teach).groupBy(label.alias("lang")).count().filter(F.col("count") >= MANY_ROWS).collect()]  # languages
    apart = label.isin(many) & (F.crc32(F.concat(F.lit("fit"), F.col(doc_id).cast("string"))) % APART == 0)
    counts = Counts(docs.filter(teach & ~apart), text, lang, share_types)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(lang).alias("_lang"), held_out(doc_id).alias("held_out"), (teach & (apart | ~label.isin(many))).alias("fit"), F.col(text).alias("_text"))
    scored = stored(_scored(named, counts), "languages")
    known = scored.filter("fit and lang_pred <> 'und'")
    right = (F.col("_lang") == F.col("lang_pred")).cast("int")
    steps = known.groupBy("step").agg(F.sum(right).alias("right"), F.count(F.lit(1)).alias("n")).orderBy("step").collect()  # 161 at most
    chance = 1 / max(1, len(counts.langs))
    fit = np.interp(np.arange(161), [-1, *(r["step"] for r in steps)], _monotone(np.array([chance, *(r["right"] for r in steps)]), np.array([1, *(r["n"] for r in steps)]), chance))
    least = chance + LEAST_OVER_CHANCE * (1 - chance) if len(counts.langs) > 1 else 0.0
    usual = known.filter("_lang = lang_pred").groupBy("lang_pred").agg((F.percentile(F.round("entropy", 3), F.lit(QUANTILE)) + MOST_BITS).alias("most"))
    ceiling = {r["lang_pred"]: r["most"] for r in usual.collect()}  # one for each language
    most = F.coalesce(*[F.when(F.col("lang_pred") == x, F.lit(float(y))) for x, y in ceiling.items()], F.lit(float(BITS)))
    score = F.when(F.col("lang_pred") == UNDECIDED, 0.0).otherwise(F.element_at(F.array(*[F.lit(float(x)) for x in fit]), F.col("step") + 1))
    return scored.select("doc_id", "h", "held_out", "lang_pred", score.alias("score"), "entropy").withColumn("rejected", (F.col("lang_pred") == UNDECIDED) | (F.col("score") < least) | (F.col("entropy") > most)).drop("entropy")


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that language identification rejects."""
    out = stored(identify(docs, text, lang, doc_id).filter("rejected").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct(), "rejected")
    out, meant = row_keys(out, docs, doc_id, text)
    return docs.join(out, meant, "left_anti")
