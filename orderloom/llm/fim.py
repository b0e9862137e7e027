"""Fill-in-the-middle transformation of texts, cut at unit ranks found in an indexable skip list.

The units of a text are its lines, each with its line break. A skip list over them has a bottom lane that
links every unit and express lanes above, each with about a quarter of the nodes of the lane below. A
link carries two widths: how many units and how many code points it passes. To find a cut rank one goes
right as long as the units passed do not exceed the rank, then down a lane; at the bottom the rank is met
exactly, and the code points passed are the place of the cut. The lists of a slice of texts stand side
by side in the same lanes, and all cuts of the slice descend together.

Cut ranks, form and order come from a hash of a seed and doc_id, so a row that is computed again gives
the same text. A text is left plain when it is empty or null, when it holds a marker, or when its hash
falls outside ``percent``. A null doc_id is written as nothing. Repeated rows give equal results; an
empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.llm import textbits as tb
from orderloom.llm.store import text_batches

#: The markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED = "7"


class SkipLists:
    """One skip list for each text; ``widths`` holds the code points of all units, ``counts`` the units of each text.

    A node stands for a number of units passed, from 0 (the head) to all; the link to the next node of
    its lane carries the widths between them.
    """

    def __init__(self, widths: np.ndarray, counts: np.ndarray):
        lists = len(counts)
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts + 1)])
        owner = np.repeat(np.arange(lists), counts + 1)
        rank = np.arange(len(owner)) - first[owner]
        chars = np.zeros(len(owner), np.int64)
        chars[rank < counts[owner]] = widths
        units = (rank < counts[owner]).astype(np.int64)
        self.heads, self.units, self.chars, self.down, self.owner = [first[:-1]], [units], [chars], [np.arange(len(owner))], [owner]
        while len(self.owner[-1]) > lists:
            owner, rank, level = self.owner[-1], rank, len(self.owner)
            coin = tb.mix(rank.astype(np.uint64) * np.uint64(64) + np.uint64(level)) & np.uint64(3)
            up = np.flatnonzero((coin == 0) | (rank == 0))
            self.units.append(np.add.reduceat(self.units[-1], up))
            self.chars.append(np.add.reduceat(self.chars[-1], up))
            self.down.append(up)
            self.owner.append(owner[up])
            rank = rank[up]
            self.heads.append(np.searchsorted(self.owner[-1], np.arange(lists)))

    def places(self, ranks: np.ndarray) -> np.ndarray:
        """Code points before the unit of each list's rank (0 to its number of units)."""
        at, passed, chars = self.heads[-1].copy(), np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for units, widths, owner, down in zip(self.units[::-1], self.chars[::-1], self.owner[::-1], self.down[::-1], strict=True):
            going = np.arange(len(ranks))
            while len(going):
                here = at[going]
                there = np.minimum(here + 1, len(owner) - 1)
                right = (there > here) & (owner[there] == owner[here]) & (passed[going] + units[here] <= ranks[going])
                going, here = going[right], here[right]
                passed[going] += units[here]
                chars[going] += widths[here]
                at[going] += 1
            at = down[at]
        return chars


def unit_widths(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every line of all texts, its line break included, and the lines of each text."""
    data, offsets = tb.texts(column)
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
    # A text ends a line unless it is empty or its last byte is a line break, which has done so.
    full = offsets[1:][np.diff(offsets) > 0]
    ends = np.union1d(np.flatnonzero(data == 10) + 1, full)
    counts = np.diff(np.searchsorted(ends, offsets, side="right"))
    return np.diff(points[ends], prepend=0), counts


def _hashes(seed: str, doc_id: int | None) -> list[int]:
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[i : i + 8], 16) for i in (0, 8, 16, 24)]


def rearranged(docs: DataFrame, percent: int = 100, suffix_first: int = 50, seed: str = SEED, markers: Sequence[str] = MARKERS) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs`` (``doc_id, text``).

    ``n`` counts lines; ``form`` is ``plain``, ``psm`` (prefix, suffix, middle) or ``spm`` (suffix first, in
    ``suffix_first`` of 100 texts). The widths are in code points, null for plain texts.
    """
    p, s, m = markers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in tb.pieces(batches, "text"):
            widths, counts = unit_widths(piece.column(1))
            texts = [t or "" for t in piece.column(1).to_pylist()]
            drawn = [_hashes(seed, i) for i in piece.column(0).to_pylist()]
            h = np.array(drawn, np.int64).reshape(len(texts), 4)
            cuts = np.sort(h[:, :2] % (counts + 1)[:, None], axis=1)
            lists = SkipLists(widths, counts)
            starts, ends = lists.places(cuts[:, 0]).tolist(), lists.places(cuts[:, 1]).tolist()
            forms, output, before, middle = [], [], [], []
            for text, draw, a, b in zip(texts, drawn, starts, ends, strict=True):
                if not text or p in text or s in text or m in text or draw[2] % 100 >= percent:
                    forms.append("plain")
                    output.append(text)
                    before.append(None)
                    middle.append(None)
                    continue
                forms.append("spm" if draw[3] % 100 < suffix_first else "psm")
                head, tail = p + text[:a], s + text[b:]
                output.append((tail + head if forms[-1] == "spm" else head + tail) + m + text[a:b])
                before.append(a)
                middle.append(b - a)
            yield pa.record_batch(
                [piece.column(0), pa.array(counts), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return text_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form", markers: Sequence[str] = MARKERS) -> Column:
    """The exact text that a rearranged one was made of. No marker is part of a text that was cut."""
    each = F.split(F.col(output), "|".join(rf"\Q{m}\E" for m in markers), -1)
    psm, spm = F.concat(each[1], each[3], each[2]), F.concat(each[2], each[3], each[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
