"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts words (A-Z lower-cased, split at white space) from the two before them, and the end
of the text; one model per language, and one of all trusted text for other languages. It learns from
every trusted document, but a word model knows the texts on which it learnt: so the texts are halved by
their hashes, each half has a model, and every text is scored by that of the other half. A word's n-grams are known by 64-bit hashes; their counts, the continuation
counts and the shares of each context are grouped and joined as tables that are never gathered. Below
the single words stands a model of spelling, a Kneser-Ney 4-gram of characters of 32 kinds, which gives
unknown words a probability; its number of grams is fixed by the kinds, so it is broadcast.

The logarithm of a word's probability is a sum of numbers of its n-grams: of a gram seen, what it adds to
the lower order; of a context seen, the weight that it leaves; nothing of one unseen. So a text's
log probability is the sum, over its distinct n-grams, of count times number: one join and one sum. Most
n-grams of two or three words are in no model and add nothing: a sieve of fixed size, broadcast, tells most of
them before they are shuffled. It never drops one that a model has; over very many it merely drops fewer.
The model of all trusted text is built only if a row is in another language.

Models are made and asked one after the other, by language and half, so the disk need not hold all of them. N-grams travel
packed by ranges of their keys. An n-gram's key has the range of the key of its last two words while its model is made: its count and
its lower order are there, and the sums of its contexts come from the ranges of their own keys.

A document is kept while its log perplexity is at most the ``quantile`` of the trusted documents of its
language, over all labels; without ``quantile``, q90 + 3 * (q90 - q50). Log perplexity is per byte. A text's mean is
drawn towards its language's median by ``SHRINK`` characters, so very short texts do not stand out by
chance; a null or empty text gets the median and is kept.

Without trusted text all documents are kept. Repeated rows are scored each, rows without doc_id too. An
empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm import textbits as tb
from orderloom.llm.store import likely, packed, scratch, stored, text_batches, unpacked

LANGUAGES = ("de", "en", "es", "fr")
ORDER, KINDS = 4, 32
GRAMS = KINDS**ORDER
SHRINK = 50
LINE_END = 27
#: Bits of the sieve (a power of two), and the parts in which it is put together.
SIEVE, SIEVE_PARTS = 1 << 27, 64
_BEGIN, _END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)

KIND = np.full(256, 31, np.uint8)  # bytes outside ASCII
KIND[:128] = 30  # punctuation and controls
KIND[ord("a") : ord("z") + 1] = KIND[ord("A") : ord("Z") + 1] = np.arange(26)
KIND[[9, 32]] = 26
KIND[[10, 13]] = LINE_END
KIND[ord("0") : ord("9") + 1] = 28
KIND[[ord("."), ord(",")]] = 29


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each byte, texts beginning after line ends, and the text bounds."""
    data, offsets = tb.texts(column)
    kind = KIND[data].astype(np.int64)
    gram = kind.copy()
    for back in range(1, ORDER):
        before = np.full(len(kind), LINE_END, np.int64)
        before[back:] = kind[:-back]
        for k in range(back):
            at = offsets[:-1] + k
            before[at[at < offsets[1:]]] = LINE_END
        gram += before << (5 * back)
    return gram, offsets


def _counts(trusted: DataFrame, models: list[str]) -> DataFrame:
    """``model, gram, n`` over the trusted documents; every document also counts for the last model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(models), GRAMS), np.int32)
        for piece in tb.pieces(batches, "text"):
            grams, bounds = _grams(piece.column(1))
            of = np.repeat(np.array(piece.column(0).to_pylist(), np.int64), np.diff(bounds))
            for m in np.unique(of):
                counts[m] += np.bincount(grams[of == m], minlength=GRAMS).astype(np.int32)
        counts[-1] = counts.sum(axis=0)
        for m in range(len(models)):
            some = np.flatnonzero(counts[m])
            yield pa.record_batch([pa.array(np.full(len(some), m, np.int32)), pa.array(some.astype(np.int32)), pa.array(counts[m][some].astype(np.int64))], ["model", "gram", "n"])

    told = trusted.mapInArrow(run, "model int, gram int, n long")
    return stored(told.groupBy("model", "gram").agg(F.sum("n").alias("n")))


def _order(counts: DataFrame, times: str | None = None) -> DataFrame:
    """``counts`` (``model, context, n`` and more) with the discounted share of each gram in its context, and
    the weight that the context leaves below; ``times`` tells how many grams a row stands for."""
    of = F.col(times) if times else F.lit(1)
    of_counts = [F.sum(F.when(F.col("n") == k, of).otherwise(0)).cast("double").alias(f"c{k}") for k in (1, 2, 3, 4)]
    discounts = counts.groupBy("model").agg(*of_counts)
    y = F.try_divide("c1", F.col("c1") + 2 * F.col("c2"))

    def discount(k: int):
        exact = k - (k + 1) * y * F.try_divide(f"c{k + 1}", f"c{k}")
        return F.when((exact > 0) & (exact < k), exact).otherwise(F.lit(0.5 * k))

    discounts = discounts.select("model", *(discount(k).alias(f"d{k}") for k in (1, 2, 3)))
    held = counts.join(F.broadcast(discounts), "model")  # a row per model
    less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    held = held.select(*counts.columns, less.alias("less"))
    contexts = held.groupBy("model", "context").agg(F.sum(of * F.col("n")).alias("total"), F.sum(of * F.col("less")).alias("left"))
    joined = held.join(contexts, ["model", "context"])
    share = ((F.col("n") - F.col("less")) / F.col("total")).alias("share")
    return joined.select(*counts.columns, share, (F.col("left") / F.col("total")).alias("below"))


def _models(trusted: DataFrame, models: list[str]) -> np.ndarray:
    """Log probabilities of every gram in every model."""
    counts = _counts(trusted, models)
    tables = []
    for order in range(ORDER, 0, -1):
        shares = _order(counts.withColumn("context", F.shiftright("gram", 5)))
        tables.append(shares.select("model", "gram", "share", "below", F.lit(order).alias("order")))
        # Continuation counts: in how many contexts one character longer a gram was seen.
        counts = counts.groupBy("model", F.col("gram").bitwiseAND(KINDS ** (order - 1) - 1).alias("gram")).agg(F.count("*").alias("n"))

    def pack(table: pa.Table) -> pa.Table:
        cells = {c: table.column(c).to_numpy() for c in ("gram", "share", "below")}
        packed = [cells["gram"].astype(np.int32).tobytes(), cells["share"].astype(np.float32).tobytes(), cells["below"].astype(np.float32).tobytes()]
        return pa.table({"model": table.column("model")[:1], "order": table.column("order")[:1], **{n: [b] for n, b in zip(("gram", "share", "below"), packed, strict=True)}})

    every = tables[0]
    for t in tables[1:]:
        every = every.union(t)
    rows = every.groupBy("model", "order").applyInArrow(pack, "model int, order int, gram binary, share binary, below binary").collect()
    found = {(r["model"], r["order"]): r for r in rows}  # at most GRAMS numbers for each model
    out = np.empty((len(models), GRAMS), np.float32)
    for m in range(len(models)):
        p = np.full(1, 1 / KINDS)
        for order in range(1, ORDER + 1):
            lower = np.tile(p, KINDS ** order // len(p)) if order > 1 else np.full(KINDS, 1 / KINDS)
            below, share = np.ones(KINDS ** (order - 1)), np.zeros(KINDS**order)
            row = found.get((m, order))
            if row:
                gram = np.frombuffer(row["gram"], np.int32)
                below[gram >> 5] = np.frombuffer(row["below"], np.float32)
                share[gram] = np.frombuffer(row["share"], np.float32)
            p = share + np.repeat(below, KINDS) * lower
        out[m] = np.log(p)
    return out


def _spelled(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log probability of each word's characters and the blank after it, by a table of 4-grams."""
    kind, blank = KIND[low].astype(np.int32), np.int32(KIND[32])
    gram = kind.copy()
    for back in range(1, ORDER):
        gram[back:] += kind[:-back] << (5 * back)
    for place in range(ORDER - 1):  # before a word's first characters are blanks, whatever stands there
        at = (starts + place)[starts + place < ends]
        gram[at] = sum((kind[at - back] if back <= place else blank) << (5 * back) for back in range(ORDER))
    total = np.concatenate([np.zeros(1), np.cumsum(table[gram], dtype=np.float64)])
    last = np.full(len(ends), blank)
    for back in range(1, ORDER):
        last += np.where(ends - starts >= back, kind[np.maximum(ends - back, 0)], blank) << (5 * back)
    return total[ends] - total[starts] + table[last]


def _empty_word(table: np.ndarray) -> float:
    return float(table[sum(int(KIND[32]) << (5 * back) for back in range(ORDER))])


def _key(order: int, *words: np.ndarray) -> np.ndarray:
    key = np.full(len(words[0]), order, np.uint64)
    for w in words:
        key = tb.mix(key + w)
    return key


class Grams:
    """The words of a slice of texts, with an end after each text, and their n-grams as hashes."""

    def __init__(self, column: pa.Array):
        data, offsets = tb.texts(column)
        self.low = tb.LOWER[data]
        self.starts, self.ends, first = tb.word_bounds(self.low, offsets)
        n = np.diff(first)
        self.bounds = np.concatenate([[0], np.cumsum(n + 1)])
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        self.is_word = np.ones(len(self.doc), bool)
        self.is_word[self.bounds[1:] - 1] = False
        word = np.full(len(self.doc), _END)
        word[self.is_word] = tb.span_hashes(self.low, self.starts, self.ends)
        place = np.arange(len(word)) - self.bounds[:-1][self.doc]
        before = np.where(place >= 1, np.roll(word, 1), _BEGIN)
        earlier = np.where(place >= 2, np.roll(word, 2), _BEGIN)
        self.word, self.before, self.earlier = word, before, earlier

    def spelled(self, tables: np.ndarray, model: np.ndarray) -> np.ndarray:
        """Log probability of the spelling of each word under the model of its text."""
        out = np.array([_empty_word(t) for t in tables])[model[self.doc]] if len(self.doc) else np.zeros(0)
        of = model[self.doc[self.is_word]]
        at = np.flatnonzero(self.is_word)
        for m in np.unique(of):
            some = of == m
            out[at[some]] = _spelled(self.low, self.starts[some], self.ends[some], tables[m])
        return out


def _long(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def _bytes(values: np.ndarray, kind=np.uint64) -> bytes:
    """Numbers with their lowest bytes together, then the next, compressed."""
    raw = np.ascontiguousarray(values, kind)
    return packed(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T)


def _values(blob: bytes, kind=np.uint64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(unpacked(blob, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _rounded(numbers: np.ndarray) -> np.ndarray:
    """Numbers with 36 binary digits, which take six bytes."""
    return ((np.ascontiguousarray(numbers, np.float64).view(np.uint64) + np.uint64(1 << 15)) & ~np.uint64((1 << 16) - 1)).view(np.float64)


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return _bytes(np.diff(keys, prepend=np.uint64(0)))


def _summed_steps(blob: bytes) -> np.ndarray:
    return np.cumsum(_values(blob), dtype=np.uint64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _slices(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = _changes(*columns)
    if not len(starts):
        return iter(())
    return zip(starts.tolist(), np.append(starts[1:], len(columns[0])).tolist(), strict=True)


def _buckets(spark) -> int:
    """How many ranges of keys: a power of two that follows the session's shuffle partitions."""
    return 1 << (max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length()


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(65 - buckets.bit_length())).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


#: Words or n-grams that a task puts together before it sends them on.
TOGETHER = 1 << 18
_TRIGRAMS = "words binary, at binary, spell binary, n binary"


class Trigrams:
    """Distinct word trigrams ``u v w`` with their counts, sorted by the key of their last two words."""

    def __init__(self, u, v, w, spell, n):
        low = _key(2, v, w)
        order = np.lexsort((u, low))
        low, u = low[order], u[order]
        start = _changes(low, u)
        self.low, self.u, at = low[start], u[start], order[start]
        self.v, self.w, self.spell = v[at], w[at], spell[at]
        self.n = np.add.reduceat(n[order], start) if len(start) else n[:0]

    def packed(self, a: int, b: int) -> tuple[bytes, bytes, bytes, bytes]:
        words, at = np.unique(np.concatenate([c[a:b] for c in (self.u, self.v, self.w)]), return_inverse=True)
        first = np.unique(at[2 * (b - a) :], return_index=True)[1]
        return _steps(words), _bytes(at, np.uint32), _bytes(self.spell[a:b][first], np.float64), _bytes(self.n[a:b])

    @classmethod
    def of(cls, table: pa.Table) -> Trigrams:
        parts = []
        for words, at, spell, n in zip(*(table.column(c).to_pylist() for c in ("words", "at", "spell", "n")), strict=True):
            at = _values(at, np.uint32).astype(np.int64)
            u, v, w = _summed_steps(words)[at].reshape(3, -1)
            last = at[2 * len(u) :]
            parts.append((u, v, w, _values(spell, np.float64)[np.searchsorted(np.unique(last), last)], _values(n)))
        return cls(*map(np.concatenate, zip(*parts, strict=True)))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair of last words begins, and after how many words it was seen."""
        start = _changes(self.low)
        return start, np.diff(np.append(start, len(self.low)))

    def asked(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys of the contexts of two words, of those of one word and of the last words, with what this part adds."""
        start, n = self.pairs()

        def sums(keys, n, also: bool):
            keys, at = np.unique(keys, return_inverse=True)
            each = [n, n == 1, n == 2, n > 2] if also else [np.ones(len(n))] + [np.zeros(len(n))] * 3
            return keys, np.stack([np.bincount(at, x, len(keys)) for x in each], 1).astype(np.uint64)

        return [sums(_key(2, self.u, self.v), self.n, True), sums(_key(1, self.v[start]), n, True), sums(_key(1, self.w[start]), n, False)]


def _times(n: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4, how many there are, and their sum."""
    return [*(int((n == k).sum()) for k in (1, 2, 3, 4)), len(n), int(n.sum())]


def _discounts(times: list[int]) -> np.ndarray:
    """The discounts of counts of 1, 2, and 3 or more."""
    y = times[0] / (times[0] + 2 * times[1]) if times[0] + times[1] else None
    exact = [k - (k + 1) * y * times[k] / times[k - 1] if y is not None and times[k - 1] else 0.0 for k in (1, 2, 3)]
    return np.array([x if 0 < x < k else 0.5 * k for k, x in enumerate(exact, 1)])


def _less(n: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return discounts[np.minimum(n, 3).astype(np.int64) - 1]


def _word_counts(trusted: DataFrame, models: int, tables, every: bool = True) -> DataFrame:
    """``model, bucket, times`` and packed trigrams of each model, by the key of the last two words.

    Model ``2 * m + half`` learns from the texts of language ``m`` in the other half; without ``every``, the
    last language, which learns from all texts, is left out.
    """
    buckets = _buckets(trusted.sparkSession)
    schema = pa.schema([("model", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("words", "at", "spell", "n"))])

    def sent(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        of, *columns = map(np.concatenate, zip(*held, strict=True))
        for model in np.unique(of):
            some = Trigrams(*(c[of == model] for c in columns))
            yield _rows([(model, int(_bucket(some.low[a : a + 1], buckets)[0]), *some.packed(a, b)) for a, b in _slices(_bucket(some.low, buckets))], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in tb.pieces(batches, "text"):
            grams = Grams(piece.column(1))
            own, half = (np.array(piece.column(c).to_pylist(), np.int64) for c in (0, 2))
            for model in (own, np.full(len(own), models - 1))[: 1 + every]:
                use = np.flatnonzero(own[grams.doc] != models - 1) if model is own else np.arange(len(grams.doc))
                if len(use):
                    spell = grams.spelled(tables.value, model)
                    of = (2 * model + 1 - half)[grams.doc]
                    held.append((of[use], grams.earlier[use], grams.before[use], grams.word[use], spell[use], np.ones(len(use), np.uint64)))
                    size += len(use)
            if size >= TOGETHER:
                yield from sent(held)
                held, size = [], 0
        if held:
            yield from sent(held)

    def merged(table: pa.Table) -> pa.Table:
        some = Trigrams.of(table)
        times = [_times(some.n), _times(some.pairs()[1])]
        return pa.Table.from_batches([_rows([(table.column("model")[0].as_py(), table.column("bucket")[0].as_py(), times, *some.packed(0, len(some.n)))], whole)])

    whole = pa.schema([*list(schema)[:2], ("times", pa.list_(pa.list_(pa.int64()))), *list(schema)[2:]])
    told = trusted.mapInArrow(run, f"model int, bucket int, {_TRIGRAMS}")
    return stored(told.groupBy("model", "bucket").applyInArrow(merged, f"model int, bucket int, times array<array<long>>, {_TRIGRAMS}"))


def _all_times(parts: DataFrame, orders: int) -> dict[int, list[list[int]]]:
    """By model: how often each count of n-grams occurs, of each order."""
    sums = [F.sum(F.col("times")[o][i]) for o in range(orders) for i in range(6)]
    return {r[0]: [list(r[1 + 6 * o : 7 + 6 * o]) for o in range(orders)] for r in parts.groupBy("model").agg(*sums).collect()}  # a row per model


def _sums(three: DataFrame) -> DataFrame:
    """Sums over all parts of what ``Trigrams.asked`` has, back to the parts: ``model, bucket, kind, target, sums, first, times``.

    ``first`` marks the keys that this part asked for first, so one part tells the number of each.
    """
    buckets = _buckets(three.sparkSession)
    start = [("model", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("target", pa.int32())]
    ask = pa.schema([*start, ("keys", pa.binary()), ("sums", pa.binary())])
    reply = pa.schema([*start, ("sums", pa.binary()), ("first", pa.binary()), ("times", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                table = pa.Table.from_batches([batch.slice(i, 1)])
                model, bucket = (table.column(c)[0].as_py() for c in ("model", "bucket"))
                rows = []
                for kind, (keys, sums) in enumerate(Trigrams.of(table).asked()):
                    target = _bucket(keys, buckets)
                    rows += [(model, bucket, kind, int(target[a]), _steps(keys[a:b]), _bytes(sums[a:b].T.ravel())) for a, b in _slices(target)]
                yield _rows(rows, ask)

    def summed(table: pa.Table) -> pa.Table:
        keys = [_summed_steps(x) for x in table.column("keys").to_pylist()]
        bounds = np.cumsum([0, *map(len, keys)])
        found, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        each = np.concatenate([_values(x).reshape(4, -1) for x in table.column("sums").to_pylist()], 1)
        total = np.stack([np.bincount(at, x, len(found)) for x in each]).astype(np.uint64)
        owned = np.zeros(len(at), np.uint8)
        owned[first] = 1
        model, kind, target = (table.column(c)[0].as_py() for c in ("model", "kind", "target"))
        times = [_times(total[0])] if kind == 2 else None
        rows = [
            (model, bucket, kind, target, _bytes(total[:, at[a:b]].ravel()), _bytes(owned[a:b], np.uint8), None if a else times)
            for bucket, a, b in zip(table.column("bucket").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        ]
        return pa.Table.from_batches([_rows(rows, reply)])

    told = three.select("model", "bucket", "words", "at", "spell", "n").mapInArrow(run, "model int, bucket int, kind int, target int, keys binary, sums binary")
    return stored(told.groupBy("model", "kind", "target").applyInArrow(summed, "model int, bucket int, kind int, target int, sums binary, first binary, times array<array<long>>"))


def _word_shards(trusted: DataFrame, models: int, tables, every: bool = True) -> tuple[DataFrame, dict[int, float]]:
    """``model, bucket, word, gram, number``: packed n-grams and numbers by key; each model's log weight of unknown words.

    The number of a word is what it adds to that of an unknown one of its spelling. A gram may come twice, as gram and as context.
    """
    buckets = _buckets(trusted.sparkSession)
    three = _word_counts(trusted, models, tables, every)
    sums = _sums(three)
    ones = {m: x[0] for m, x in _all_times(sums.filter("times IS NOT NULL"), 1).items()}
    discounts = {m: [_discounts(x) for x in (ones[m], *reversed(more))] for m, more in _all_times(three, 2).items()}
    below = {}
    for m, x in ones.items():
        d = discounts[m][0]
        below[m] = (x[0] * d[0] + x[1] * d[1] + (x[4] - x[0] - x[1]) * d[2]) / x[5]
    schema = pa.schema([("model", pa.int32()), ("bucket", pa.int32()), ("word", pa.bool_()), ("gram", pa.binary()), ("number", pa.binary())])

    def numbers(table: pa.Table, told: pa.Table) -> pa.Table:
        some = Trigrams.of(table)
        start, n = some.pairs()
        model = table.column("model")[0].as_py()
        d1, d2, d3 = discounts[model]
        told = told.sort_by("target")
        of, mine = [], []
        for kind in (0, 1, 2):
            part = told.filter(pc.equal(told.column("kind"), kind))
            of.append(np.concatenate([_values(x).reshape(4, -1) for x in part.column("sums").to_pylist()], 1).astype(np.float64))
            mine.append(np.concatenate([_values(x, np.uint8) for x in part.column("first").to_pylist()]) > 0)
        pair, v, w = _key(2, some.u, some.v), _key(1, some.v[start]), _key(1, some.w[start])
        (pairs, at_pair), (befores, at_v), (lasts, at_w) = (np.unique(x, return_inverse=True) for x in (pair, v, w))
        left_pair, left_v = (of[k][1:].T @ d / of[k][0] for k, d in ((0, d3), (1, d2)))
        spell = np.empty(len(lasts))
        spell[at_w] = some.spell[start]
        seen = of[2][0]
        p1 = (seen - _less(seen, d1)) / ones[model][5] + below[model] * np.exp(spell)
        q1 = p1[at_w]
        p2 = (n - _less(n, d2)) / of[1][0][at_v] + left_v[at_v] * q1
        q2 = np.repeat(p2, n)
        p3 = (some.n - _less(some.n, d3)) / of[0][0][at_pair] + left_pair[at_pair] * q2
        grams = [
            (_key(3, some.u, some.v, some.w), np.log(p3) - np.log(left_pair[at_pair]) - np.log(q2)),
            (some.low[start], np.log(p2) - np.log(left_v[at_v]) - np.log(q1)),
            (pairs[mine[0]], np.log(left_pair[mine[0]])),
            (befores[mine[1]], np.log(left_v[mine[1]])),
        ]
        single = (lasts[mine[2]], (np.log(p1) - np.log(below[model]) - spell)[mine[2]])
        rows = []
        for word, (gram, number) in ((False, tuple(map(np.concatenate, zip(*grams, strict=True)))), (True, single)):
            order = np.argsort(gram)
            gram, number = gram[order], number[order]
            to = _bucket(gram, buckets)
            rows += [(model, int(to[a]), word, _steps(gram[a:b]), _bytes(_rounded(number[a:b]), np.float64)) for a, b in _slices(to)]
        return pa.Table.from_batches([_rows(rows, schema)])

    both = three.groupBy("model", "bucket").cogroup(sums.select("model", "bucket", "kind", "target", "sums", "first").groupBy("model", "bucket"))
    return stored(both.applyInArrow(numbers, "model int, bucket int, word boolean, gram binary, number binary")), {m: float(np.log(x)) for m, x in below.items()}


class Shards(NamedTuple):
    """Packed n-grams with their numbers, and each model's log weight of unknown words."""

    table: DataFrame
    unknown: dict[int, float]


def _word_numbers(trusted: DataFrame, models: int, tables, every: bool = True) -> tuple[DataFrame, Shards]:
    """``model, gram, number, word`` of every gram and context, and the same in packed form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, word, gram, number in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                keys = _summed_steps(gram)
                yield pa.record_batch([pa.array(np.full(len(keys), model, np.int32)), _long(keys), pa.array(_values(number, np.float64)), pa.array(np.full(len(keys), word))], ["model", "gram", "number", "word"])

    with scratch(trusted.sparkSession) as kept:
        shards, unknown = _word_shards(trusted, models, tables, every)
        kept.append(shards)
    numbers = shards.select("model", "word", "gram", "number").mapInArrow(run, "model int, gram long, number double, word boolean")
    return numbers, Shards(shards, unknown)


def _sieve_places(model: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each gram of a model."""
    key = tb.mix(gram + tb.mix(model.astype(np.uint64) + np.uint64(1)))
    return (key % np.uint64(SIEVE)).astype(np.int64), ((key >> np.uint64(32)) % np.uint64(SIEVE)).astype(np.int64)


def _sieve(shards: DataFrame) -> np.ndarray:
    """Bytes whose bits are set for every gram of more than one word that a model has."""
    size = SIEVE // 8 // SIEVE_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SIEVE // 8, np.uint8)
        for batch in batches:
            for model, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gram = _summed_steps(blob)
                for at in _sieve_places(np.full(len(gram), model), gram):
                    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        some = [part for part in range(SIEVE_PARTS) if bits[part * size : (part + 1) * size].any()]
        for part in some:
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([packed(bits[part * size : (part + 1) * size])], pa.binary())], ["part", "bits"])

    def both(table: pa.Table) -> pa.Table:
        bits = np.zeros(size, np.uint8)
        for some in table.column("bits"):
            bits |= unpacked(some.as_py(), np.uint8)
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([packed(bits)], pa.binary())})

    told = shards.filter("NOT word").select("model", "gram").mapInArrow(run, "part int, bits binary")
    # The parts of some tasks are put together first, so no task gets those of all.
    some = told.withColumn("salt", F.spark_partition_id() % 64).groupBy("part", "salt")
    some = some.applyInArrow(lambda t: both(t.select(["part", "bits"])), "part int, bits binary")
    out = np.zeros(SIEVE // 8, np.uint8)
    for row in some.groupBy("part").applyInArrow(both, "part int, bits binary").collect():  # SIEVE bits at most
        out[row["part"] * size : (row["part"] + 1) * size] = unpacked(row["bits"], np.uint8)
    return out


def _sifted(bits: np.ndarray, model: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Places of the grams that their model may have."""
    first, second = _sieve_places(model, gram)
    at = np.flatnonzero(bits[first >> 3] >> (first & 7).astype(np.uint8) & 1)
    second = second[at]
    return at[np.flatnonzero(bits[second >> 3] >> (second & 7).astype(np.uint8) & 1)]


def _text_grams(rows: DataFrame, tables, sieve) -> DataFrame:
    """``key, n_bytes, model, gram, n, spell`` of the distinct grams of each text; ``spell`` of words only.

    The context before the first word comes once a text, with ``begin`` set. Grams of more words that
    are certainly in no model are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, "text"):
            grams = Grams(piece.column(3))
            keys, sizes, model, half = (np.array(piece.column(c).to_pylist(), np.int64) for c in (0, 1, 2, 4))
            spell = grams.spelled(tables.value, model)
            begin = np.full(len(keys), _BEGIN)
            one, two, three = _key(1, grams.word), _key(2, grams.before, grams.word), _key(3, grams.earlier, grams.before, grams.word)
            some = [(one, grams.doc, spell, 0), (two, grams.doc, None, 0), (three, grams.doc, None, 0)]
            some += [(_key(1, begin), np.arange(len(keys)), None, 1), (_key(2, begin, begin), np.arange(len(keys)), None, 0)]
            for gram, doc, spelled, first in some:
                if spelled is None and not first:
                    may = _sifted(sieve.value, (2 * model + half)[doc], gram)
                    gram, doc = gram[may], doc[may]
                order = np.lexsort((gram, doc))
                of, value = doc[order], gram[order]
                new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (value[1:] != value[:-1]))) if len(of) else np.zeros(0, np.int64)
                n = np.diff(np.append(new, len(of)))
                of, value = of[new], value[new]
                said = pa.nulls(len(new), pa.float64()) if spelled is None else pa.array(spelled[order][new])
                yield pa.record_batch(
                    [pa.array(keys[of]), pa.array(sizes[of]), pa.array((2 * model + half)[of].astype(np.int32)), _long(value), pa.array(n.astype(np.int32)), said, pa.array(np.full(len(new), first, np.int32))],
                    ["key", "n_bytes", "model", "gram", "n", "spell", "begin"],
                )

    return rows.mapInArrow(run, "key long, n_bytes long, model int, gram long, n int, spell double, begin int")


def _met(grams: DataFrame, shards: Shards) -> DataFrame:
    """``key, n_bytes, gained, begin`` of the texts of ``_text_grams``: sums of count times number, and how often a text begins.

    The grams that a task met in some texts go to the model's shards packed, each once with its texts and counts; what comes
    back are sums by text.
    """
    buckets = _buckets(grams.sparkSession)
    names = ("gram", "runs", "doc", "n", "value")
    schema = pa.schema([("src", pa.int64()), ("model", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in names)])
    spelled = "src long, model int, bucket int, " + ", ".join(f"{c} binary" for c in names)
    unknown = shards.unknown

    def sent(src: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        key, size, model, gram, n, begin = (table.column(c).to_numpy() for c in ("key", "n_bytes", "model", "gram", "n", "begin"))
        spell = table.column("spell")
        word = np.flatnonzero(spell.is_valid().to_numpy())
        said = spell.drop_null().to_numpy()
        # The grams of a text come one after the other, so there are few runs.
        start = _changes(key, size, model)
        texts, at = np.unique(np.stack([key[start], size[start], model[start]], 1), axis=0, return_inverse=True)
        doc = np.repeat(at.ravel(), np.diff(np.append(start, len(key))))
        start_log = np.array([unknown.get(m, 0.0) for m in texts[:, 2].tolist()])[doc[word]]
        gained = np.bincount(doc[word], n[word] * (start_log + said), len(texts))
        begins = np.bincount(doc, begin, len(texts)).astype(np.uint64)
        rows = [(src, -1, src % buckets, _bytes(texts[:, 0].view(np.uint64)), _bytes(texts[:, 1]), None, _bytes(begins), _bytes(gained, np.float64))]
        gram = gram.view(np.uint64)
        order = np.lexsort((gram, model)) if len(np.unique(texts[:, 2])) > 1 else np.argsort(gram, kind="stable")
        model, gram, n, doc = model[order], gram[order], n[order], doc[order]
        for a, b in _slices(model, _bucket(gram, buckets)):
            own = _changes(gram[a:b])
            runs = np.diff(np.append(own, b - a))
            rows.append((src, int(model[a]), int(_bucket(gram[a : a + 1], buckets)[0]), _steps(gram[a:b][own]), _bytes(runs), _bytes(doc[a:b], np.uint32), _bytes(n[a:b], np.uint32), None))
        yield _rows(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, src = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= TOGETHER:
                yield from sent(src, held)
                held, size, src = [], 0, src + 1
        if size:
            yield from sent(src, held)

    def answered(asks: pa.Table, known: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return schema.empty_table()
        if asks.column("model")[0].as_py() < 0:
            return asks
        if known.num_rows:
            gram = np.concatenate([_summed_steps(x) for x in known.column("gram").to_pylist()])
            number = np.concatenate([_values(x, np.float64) for x in known.column("number").to_pylist()])
            order = np.argsort(gram, kind="stable")
            gram, number = gram[order], number[order]
            start = _changes(gram)
            gram, number = gram[start], np.add.reduceat(number, start)
        rows = []
        for ask in asks.to_pylist() if known.num_rows else []:
            keys = _summed_steps(ask["gram"])
            at = np.minimum(np.searchsorted(gram, keys), len(gram) - 1)
            each = np.repeat(np.where(gram[at] == keys, number[at], 0.0), _values(ask["runs"]).astype(np.int64))
            gained = np.bincount(_values(ask["doc"], np.uint32), each * _values(ask["n"], np.uint32))
            doc = np.flatnonzero(gained)
            rows.append((ask["src"], ask["model"], ask["bucket"], None, None, _bytes(doc, np.uint32), None, _bytes(gained[doc], np.float64)))
        return pa.Table.from_batches([_rows(rows, schema)])

    out = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("gained", pa.float64()), ("begin", pa.int64())])

    def by_text(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["gram"] is not None)
        gained = _values(head["value"], np.float64).copy()
        for r in rows:
            if r is not head:
                gained[_values(r["doc"], np.uint32)] += _values(r["value"], np.float64)
        return pa.table([_long(_values(head["gram"])), _long(_values(head["runs"])), pa.array(gained), _long(_values(head["n"]))], schema=out)

    asks = grams.mapInArrow(run, spelled).groupBy("model", "bucket")
    known = shards.table.select("model", "bucket", "gram", "number").groupBy("model", "bucket")
    replies = asks.cogroup(known).applyInArrow(answered, spelled)
    return replies.groupBy("src").applyInArrow(by_text, "key long, n_bytes long, gained double, begin long")


def _half(text: str = "text"):
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("half")  # equal texts are in one half


def _scored(rows: DataFrame, trusted: DataFrame, models: list[str], spelling: np.ndarray | None = None, used: list | None = None) -> DataFrame:
    """``doc_id, model, n_bytes, nats`` for rows of ``doc_id, model, text``.

    ``spelling``: the spelling models, if they are known. ``used`` gets the broadcasts, for the caller to destroy.
    """
    context = rows.sparkSession.sparkContext
    tables = context.broadcast(_models(trusted, models) if spelling is None else spelling)
    every = not rows.filter(F.col("model") == len(models) - 1).isEmpty()
    numbers, shards = _word_numbers(trusted.select("model", "text", _half()), len(models), tables, every)
    sieve = context.broadcast(_sieve(shards.table))
    if used is not None:
        used += [tables, sieve]
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    rows = rows.withColumn("key", F.xxhash64("model", "text"))
    some = rows.filter("n_bytes > 0")
    met = _met(_text_grams(some.select("key", "n_bytes", "model", "text", _half()), tables, sieve), shards)
    # Equal texts have one key; each brings its beginning once, so the sum is that of one of them.
    sums = met.groupBy("key", "n_bytes").agg((-F.sum("gained") / F.sum("begin")).alias("nats"))
    out = some.select("doc_id", "model", "n_bytes", "key").join(sums, ["key", "n_bytes"], "left").select("doc_id", "model", "n_bytes", "nats")
    return stored(out.union(rows.filter("n_bytes = 0").select("doc_id", "model", "n_bytes", F.lit(0.0))))


def _scored_in_turn(rows: DataFrame, trusted_ids: DataFrame, models: list[str]) -> DataFrame:
    """``_scored``, one model and half at a time: the files of one are gone before the next begins."""
    spark = rows.sparkSession
    last = len(models) - 1
    out = spark.createDataFrame([], "doc_id long, model int, n_bytes long, nats double")
    with scratch(spark) as kept:
        trusted = likely(rows, trusted_ids, "doc_id").join(trusted_ids, "doc_id", "left_semi")
        trusted = stored(trusted.select("model", "text", (2 * F.col("model") + _half()).alias("part")), by="part")
        spelling = _models(trusted.select("model", "text"), models)
        for model, half in sorted(rows.select("model", _half()).distinct().collect()):  # two rows a model at most
            mine = rows.filter((F.col("model") == model) & (_half() == half)).withColumn("model", F.lit(0))
            learnt = F.col("part") == 2 * model + 1 - half if model < last else F.col("part") % 2 == 1 - half
            learnt = trusted.filter(learnt).select(F.lit(0).alias("model"), "text")
            # Of the names given only the first is asked; the last one learns from all texts.
            names, used = ([models[model], models[last]] if model < last else models[last:]), []
            with scratch(spark) as own:
                part = _scored(mine, learnt, names, spelling[model : model + 1], used)
                own.append(part)
            kept.append(part)
            for sent in used:
                sent.destroy()
            out = out.union(part.withColumn("model", F.lit(model)))
    return out


def classify(docs: DataFrame, labels: DataFrame, languages: Sequence[str] = LANGUAGES, quantile: float | None = None) -> DataFrame:
    """``doc_id, language, n_bytes, log_perplexity, threshold, kept`` for rows of ``doc_id, text, lang``.

    ``labels`` has ``doc_id, quality, toxic``; documents of quality 1 that are not toxic are trusted.
    """
    models = [*languages, "other"]
    number = F.coalesce(*(F.when(F.lower("lang") == x, F.lit(i)) for i, x in enumerate(languages)), F.lit(len(languages)))
    rows = text_batches(docs).select("doc_id", number.alias("model"), "text")
    trusted_ids = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    scored = _scored_in_turn(rows, trusted_ids, models)
    each = F.try_divide("nats", "n_bytes")
    labelled = scored.filter("n_bytes > 0").join(trusted_ids, "doc_id", "left_semi")
    middle = labelled.groupBy("model").agg(F.percentile_approx(each, 0.5, 10_000).alias("median"))
    middle = stored(middle)  # a row per model
    drawn = (F.col("nats") + SHRINK * F.col("median")) / (F.col("n_bytes") + SHRINK)
    limits = labelled.join(F.broadcast(middle), "model").withColumn("x", drawn)
    if quantile is None:
        limits = limits.groupBy("model").agg(F.percentile_approx("x", [0.5, 0.9], 10_000).alias("q"))
        limits = limits.select("model", (F.col("q")[1] + 3 * (F.col("q")[1] - F.col("q")[0])).alias("threshold"))
    else:
        limits = limits.groupBy("model").agg(F.percentile_approx("x", quantile, 10_000).alias("threshold"))
    out = scored.join(F.broadcast(middle), "model", "left").join(F.broadcast(limits), "model", "left")
    language = F.element_at(F.array(*map(F.lit, models)), F.col("model") + 1)
    out = out.select("doc_id", language.alias("language"), "n_bytes", drawn.alias("log_perplexity"), "threshold")
    return out.withColumn("kept", F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True)))
