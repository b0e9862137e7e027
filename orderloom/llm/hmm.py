"""Language model scoring: a hidden Markov model over word forms, trained by Baum-Welch.

Hidden states emit a word's form (its last three bytes and its length), of which there is a fixed
number; within a form a word has its smoothed share of the training tokens. So the model's tables of
states stay small whatever the corpus, while the word counts cover the whole training vocabulary and
grow with it:

    P(text) = P(forms of the text | states) * product of (c + 0.5) / (n + 0.5 * (v + 1))

with c the word's training count, n and v the tokens and distinct words of its form. The shares of a
form's words and of one unknown word add up to one. Word counts are never gathered: each slice of
documents sends its distinct words, split by key range, and gets their counts back.

Training sums the expected counts of all training tokens over the partitions, cut into segments of 64
tokens; scoring runs the scaled forward recursion over whole texts.

Null and empty texts consist of the end token alone. Rows without doc_id hash as the empty string.
Repeated rows are scored each, and count each. Without training tokens every score is a smoothed
constant; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm import textbits as tb
from orderloom.llm.store import key_buckets, packed, stored, summed, unpacked

FORMS = 8192
STATES = 8
ROUNDS = 5
SEGMENT = 64
SLICE_BYTES = 4 << 20
SUM_SLICES = 16
END_WORD, END_FORM = np.uint64(0), 0

_SLICES = "slice string, ids array<long>, held array<boolean>, lengths array<long>, tokens binary, words binary, forms binary, trained binary"


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that the model doesn't learn from."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 1


def _word_forms(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last three bytes and the length up to 15, hashed to 1 .. FORMS - 1."""
    tail = np.minimum(ends - starts, 15).astype(np.uint64)
    for back in (1, 2, 3):
        at = ends - back
        tail = tail << np.uint64(8) | np.where(at >= starts, low[np.maximum(at, 0)], 0).astype(np.uint64)
    return (tb.mix(tail + np.uint64(1)) % np.uint64(FORMS - 1)).astype(np.uint16) + np.uint16(1)


def _slices(docs: DataFrame) -> DataFrame:
    """Documents as token numbers, with the distinct words of each slice in order of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, "text", SLICE_BYTES):
            data, offsets = tb.texts(piece.column(1))
            low = tb.LOWER[data]
            starts, ends, first = tb.word_bounds(low, offsets)
            hashes = np.maximum(tb.span_hashes(low, starts, ends), np.uint64(1))
            forms = _word_forms(low, starts, ends)
            # One end token after the words of each document.
            hashes = np.insert(hashes, first[1:], END_WORD)
            forms = np.insert(forms, first[1:], END_FORM)
            lengths = np.diff(first) + 1
            words, at, tokens = np.unique(hashes, return_index=True, return_inverse=True)
            held = piece.column(2).to_numpy(zero_copy_only=False).astype(bool)
            learned = tokens[~np.repeat(held, lengths)]
            trained = np.bincount(learned, minlength=len(words)).astype(np.uint32)
            row = {
                "slice": uuid.uuid4().hex, "ids": piece.column(0).to_pylist(), "held": held.tolist(), "lengths": lengths.tolist(),
                "tokens": packed(tokens.astype(np.uint32)), "words": words.tobytes(), "forms": forms[at].tobytes(), "trained": trained.tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], _slice_schema)

    return stored(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held")).mapInArrow(run, _SLICES))


_slice_schema = pa.schema([
    ("slice", pa.string()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
    ("tokens", pa.binary()), ("words", pa.binary()), ("forms", pa.binary()), ("trained", pa.binary()),
])


def _counted(slices: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Training counts of each slice's words, and tokens and distinct words of each form."""
    n = key_buckets(slices.sparkSession)
    shift = np.uint64(64 - n.bit_length() + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = np.frombuffer(row["words"], np.uint64)
                forms, trained = np.frombuffer(row["forms"], np.uint16), np.frombuffer(row["trained"], np.uint32)
                edges = np.searchsorted(words >> shift, np.arange(n + 1, dtype=np.uint64))
                parts = []
                for b in np.flatnonzero(np.diff(edges)):
                    s = slice(edges[b], edges[b + 1])
                    parts.append({"bucket": int(b), "slice": row["slice"], "words": words[s].tobytes(), "forms": forms[s].tobytes(), "trained": trained[s].tobytes()})
                yield pa.RecordBatch.from_pylist(parts, sent_schema)

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        each = [np.frombuffer(r["words"], np.uint64) for r in rows]
        forms = np.concatenate([np.frombuffer(r["forms"], np.uint16) for r in rows])
        trained = np.concatenate([np.frombuffer(r["trained"], np.uint32) for r in rows])
        words, at, number = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
        counts = np.bincount(number, trained, len(words)).astype(np.int64)
        known = counts > 0
        form_tokens = np.bincount(forms[at], counts, FORMS).astype(np.int64)
        form_words = np.bincount(forms[at][known], minlength=FORMS).astype(np.int64)
        back = np.split(counts[number], np.cumsum([len(w) for w in each])[:-1])
        out = [{"slice": r["slice"], "bucket": r["bucket"], "counts": packed(c), "forms": None} for r, c in zip(rows, back, strict=True)]
        out.append({"slice": None, "bucket": rows[0]["bucket"], "counts": None, "forms": packed(np.stack([form_tokens, form_words]))})
        return pa.Table.from_pylist(out, schema=reply)

    sent_schema = pa.schema([("bucket", pa.int32()), ("slice", pa.string()), ("words", pa.binary()), ("forms", pa.binary()), ("trained", pa.binary())])
    reply = pa.schema([("slice", pa.string()), ("bucket", pa.int32()), ("counts", pa.binary()), ("forms", pa.binary())])
    sent = slices.select("slice", "words", "forms", "trained").mapInArrow(cut, "bucket int, slice string, words binary, forms binary, trained binary")
    counted = stored(sent.groupBy("bucket").applyInArrow(add, "slice string, bucket int, counts binary, forms binary"))

    def total(table: pa.Table) -> pa.Table:
        found = sum(unpacked(b, np.int64) for b in table.column("forms").to_pylist())
        return pa.table({"forms": [packed(found)]})

    # A fixed number of key ranges, each with two numbers for every form; summed in two steps.
    some = counted.filter("forms IS NOT NULL").select((F.col("bucket") % 16).alias("part"), "forms")
    parts = some.groupBy("part").applyInArrow(total, "forms binary").collect()
    per_form = sum((unpacked(r["forms"], np.int64) for r in parts), np.zeros(2 * FORMS, np.int64)).reshape(2, FORMS)
    replies = counted.filter("slice IS NOT NULL").groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("counts"))
    return replies, per_form


def _expected(forms: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Expected first states, moves and emissions of sequences that follow one another."""
    states = len(start)
    pieces = -(-lengths // SEGMENT)
    begin = np.cumsum(lengths) - lengths
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat(begin, pieces) + step * SEGMENT
    size = np.minimum(np.repeat(lengths, pieces) - step * SEGMENT, SEGMENT)
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    width = int(size[0])
    live = [int(np.searchsorted(-size, -t, side="left")) for t in range(width)]  # segments longer than t
    alpha = np.empty((width, len(at), states))
    scale = np.ones((width, len(at)))
    seen = [emit[forms[at[: live[t]] + t]] for t in range(width)]
    for t in range(width):
        a = start * seen[0] if t == 0 else (alpha[t - 1, : live[t]] @ move) * seen[t]
        scale[t, : live[t]] = a.sum(axis=1)
        alpha[t, : live[t]] = a / scale[t, : live[t], None]
    first, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((FORMS, states))
    beta = np.ones((len(at), states))
    for t in range(width - 1, -1, -1):
        gamma = alpha[t, : live[t]] * beta[: live[t]]
        here = forms[at[: live[t]] + t]
        for s in range(states):
            emitted[:, s] += np.bincount(here, gamma[:, s], FORMS)
        if t == 0:
            first = gamma.sum(axis=0)
        else:
            onward = beta[: live[t]] * seen[t] / scale[t, : live[t], None]
            moves += alpha[t - 1, : live[t]].T @ onward
            beta[: live[t]] = onward @ move.T
    return first, moves * move, emitted


def _train(slices: DataFrame, per_form: np.ndarray, states: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rounds of Baum-Welch over all training tokens, from a start drawn with a fixed seed."""
    spark = slices.sparkSession
    prior = (per_form[0] + 0.5) / (per_form[0].sum() + 0.5 * FORMS)
    drawn = np.random.default_rng(11).normal(size=(FORMS, states))
    emit = prior[:, None] * np.exp(drawn)
    emit /= emit.sum(axis=0)
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    start = np.full(states, 1 / states)
    edges = np.linspace(0, FORMS, SUM_SLICES + 1).astype(int)

    for _ in range(rounds):
        model = spark.sparkContext.broadcast((start, move, emit))  # FORMS x states numbers

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, move, emit = model.value
            sums = None
            for batch in batches:
                for row in batch.to_pylist():
                    lengths, held = np.array(row["lengths"], np.int64), np.array(row["held"], bool)
                    tokens = unpacked(row["tokens"], np.uint32)
                    forms = np.frombuffer(row["forms"], np.uint16)[tokens][~np.repeat(held, lengths)]
                    if len(forms):
                        found = _expected(forms, lengths[~held], start, move, emit)
                        sums = found if sums is None else tuple(a + b for a, b in zip(sums, found, strict=True))
            if sums is not None:
                first, moves, emitted = sums
                out = [np.concatenate([first, moves.ravel()]), *(emitted[a:b].ravel() for a, b in zip(edges[:-1], edges[1:], strict=True))]
                yield pa.record_batch([pa.array(map(str, range(len(out)))), pa.array([x.tobytes() for x in out], pa.binary())], ["part", "sums"])

        told = slices.select("lengths", "held", "tokens", "forms").mapInArrow(expect, "part string, sums binary")
        parts = {int(r["part"]): np.frombuffer(r["sums"]) for r in summed(told).collect()}
        if not parts:
            break
        first, moves = parts[0][:states], parts[0][states:].reshape(states, states)
        emitted = np.concatenate([parts[i + 1] for i in range(SUM_SLICES)]).reshape(FORMS, states)
        start = (first + 1) / (first.sum() + states)
        move = (moves + 1) / (moves.sum(axis=1, keepdims=True) + states)
        emit = (emitted + prior[:, None]) / (emitted.sum(axis=0) + 1)
    return start, move, emit


def _forward(forms: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 likelihood of each whole sequence by the scaled forward recursion."""
    order = np.argsort(-lengths, kind="stable")
    at, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    total = np.zeros(len(size))
    alpha = None
    n = len(size)
    for t in range(int(size[0]) if n else 0):
        while size[n - 1] <= t:
            n -= 1
        seen = emit[forms[at[:n] + t]]
        a = start * seen if t == 0 else (alpha[:n] @ move) * seen
        scale = a.sum(axis=1)
        alpha = a / scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(size))
    out[order] = total
    return out


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all rows of ``docs`` (``doc_id, text``).

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score`` (smoothed unigrams) and ``score``
    (the model), both log10 probabilities of the whole text with its end.
    """
    slices = _slices(docs)
    replies, per_form = _counted(slices)
    model = slices.sparkSession.sparkContext.broadcast((*_train(slices, per_form, states, rounds), per_form))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit, (form_tokens, form_words) = model.value
        n, v = int(form_tokens.sum()), int(form_words.sum())
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.concatenate([unpacked(r["counts"], np.int64) for r in row["counts"]])
                lengths, tokens = np.array(row["lengths"], np.int64), unpacked(row["tokens"], np.uint32)
                forms = np.frombuffer(row["forms"], np.uint16)
                base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
                share = np.log10((counts + 0.5) / (form_tokens[forms] + 0.5 * (form_words[forms] + 1)))
                at = np.cumsum(lengths) - lengths
                known, base, share = (np.add.reduceat(x[tokens], at) for x in ((counts > 0).astype(np.int64), base, share))
                score = share + _forward(forms[tokens], lengths, start, move, emit)
                yield pa.record_batch(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths), pa.array(known),
                     pa.array(np.full(len(lengths), n)), pa.array(base), pa.array(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return slices.join(replies, "slice").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
