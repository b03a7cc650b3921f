"""Fill-in-the-middle: cut each text in prefix, middle and suffix, and move the middle to the end.

Displacement scatter. A batch of texts is one buffer of bytes. A scan for line ends finds the
cuts; each of a text's three parts then has one displacement, from its place in the buffer to
its place in the output. The displacements go into a difference array at the parts' first
bytes; its cumulative sum gives every byte its own shift, and one numpy scatter writes all
outputs of the batch. The inverse finds the marks in the outputs and gathers by the shifts the
other way round.

A text is one row from end to end: nothing is shuffled or broadcast. Rows are taken ``CHUNK``
bytes at a time, and shifts are summed ``BLOCK`` bytes at a time with the sum carried on, so a
task holds a few times its longest text beside some 25 bytes for each byte of a block.

Defined results: a null text is empty; an empty text stays plain with no unit. A null doc_id
draws its numbers from the seed alone. Repeated rows are treated one by one and come out equal.
Very long texts are cut and moved whole. An empty table gives an empty result. Columns beside
the two named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterance_guard.llm.common import arrow_bytes, small_batches, text_bytes

#: What stands before each part of an output.
MARKS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
MARK = 3
PLAIN, PSM, SPM = "plain", "psm", "spm"
FORMS = np.array([PLAIN, PSM, SPM], object)
CHUNK = 8 << 20
BLOCK = 1 << 20
CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


@dataclass(frozen=True)
class Rule:
    """``seed`` feeds the draws; of 100 texts some ``share`` are cut, ``spm`` of those with the
    suffix first."""

    seed: int = 7
    share: int = 100
    spm: int = 50


def shifted(n: int, starts: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """``lo, hi, places``: where the bytes lo..hi of n belong. ``starts`` rise; from each one on,
    up to the next, bytes move by its shift. Parts that begin at the same byte are empty but for
    the last of them."""
    steps = np.diff(shifts, prepend=0)
    moved = 0
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        first, end = np.searchsorted(starts, (lo, hi))
        change = np.zeros(hi - lo, np.int64)
        np.add.at(change, starts[first:end] - lo, steps[first:end])
        change[0] += moved
        shift = np.cumsum(change)
        moved = shift[-1]
        yield lo, hi, np.arange(lo, hi) + shift


def chars_before(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code points that begin before each place; the places rise."""
    out, seen = np.empty(len(places), np.int64), 0
    done = 0
    for lo in range(0, len(raw) + 1, BLOCK):
        hi = min(len(raw), lo + BLOCK)
        upto = np.concatenate(([0], np.cumsum((raw[lo:hi] & 0xC0) != 0x80)))
        end = np.searchsorted(places, lo + BLOCK)
        out[done:end] = seen + upto[places[done:end] - lo]
        seen, done = seen + upto[-1], end
    return out


def find_marks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all marks, the byte that tells their kind, and the rows they are in."""
    at = np.flatnonzero(raw == ord("<"))
    at = at[at + 2 < len(raw)]
    at = at[(raw[at + 2] == ord(">")) & np.isin(raw[at + 1], [ord(k) for k in MARKS])]
    row = np.searchsorted(offsets, at, "right") - 1
    inside = at + MARK <= offsets[row + 1]
    return at[inside], raw[at[inside] + 1], row[inside]


def lay(out: np.ndarray, at: np.ndarray, mark: bytes) -> None:
    out[at[:, None] + np.arange(MARK)] = np.frombuffer(mark, np.uint8)


def cut_and_move(raw: np.ndarray, offsets: np.ndarray, draws: np.ndarray, rule: Rule):
    """Outputs and what is reported of them, for the texts of one buffer. ``draws`` has four
    numbers for each."""
    start, end = offsets[:-1], offsets[1:]
    lines = np.flatnonzero(raw == ord("\n"))
    first = np.searchsorted(lines, start)
    closed = np.searchsorted(lines, end) - first
    last = raw[np.maximum(end - 1, 0)] if len(raw) else np.zeros(len(start), np.uint8)
    n = closed + ((end > start) & (last != ord("\n")))
    marked = np.zeros(len(start), bool)
    marked[find_marks(raw, offsets)[2]] = True
    plain = (end == start) | marked | (draws[:, 2] % 100 >= rule.share)
    spm = ~plain & (draws[:, 3] % 100 < rule.spm)

    def place(units: np.ndarray) -> np.ndarray:
        """The byte after so many units of each text."""
        ends = np.append(lines + 1, 0)[np.clip(first + units - 1, 0, len(lines))]
        return np.where(units == 0, start, np.where(units > closed, end, ends))

    drawn = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    a, b = place(drawn[:, 0]), place(drawn[:, 1])
    p, m, s = a - start, b - a, end - b
    size = end - start + np.where(plain, 0, 3 * MARK)
    ends = np.cumsum(size)
    o = ends - size
    to_prefix = np.where(plain, o, np.where(spm, o + 2 * MARK + s, o + MARK))
    to_middle = np.where(plain, o + p, o + 3 * MARK + p + s)
    to_suffix = np.where(plain, o + p + m, np.where(spm, o + MARK, o + 2 * MARK + p))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    parts = np.stack([start, a, b], axis=1).ravel()
    shifts = np.stack([to_prefix - start, to_middle - a, to_suffix - b], axis=1).ravel()
    for lo, hi, places in shifted(len(raw), parts, shifts):
        out[places] = raw[lo:hi]
    moved = ~plain
    lay(out, to_prefix[moved] - MARK, MARKS["P"])
    lay(out, to_suffix[moved] - MARK, MARKS["S"])
    lay(out, to_middle[moved] - MARK, MARKS["M"])
    chars = chars_before(raw, parts).reshape(-1, 3)
    form = np.where(plain, 0, np.where(spm, 2, 1))
    return out, np.append(0, ends), n, form, chars[:, 1] - chars[:, 0], chars[:, 2] - chars[:, 1]


def move_back(raw: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that the outputs of one buffer came from. ``cut`` tells which rows have marks."""
    start, end = offsets[:-1], offsets[1:]
    at, kind, row = find_marks(raw, offsets)
    own = cut[row]
    at, kind, row = at[own], kind[own], row[own]
    rows = np.flatnonzero(cut)
    if not np.array_equal(row, np.repeat(rows, 3)):
        raise ValueError("an output that is not plain must hold three marks")
    at, kind = at.reshape(-1, 3), kind.reshape(-1, 3)
    length = np.concatenate((at[:, 1:], end[rows][:, None]), axis=1) - at - MARK
    order = np.argsort(-kind.astype(np.int64), axis=1)  # S, P, M by their bytes
    if not (np.sort(kind, axis=1) == np.array([ord(k) for k in "MPS"])).all():
        raise ValueError("an output that is not plain must hold one mark of each kind")
    source = np.stack([start, end, end], axis=1)  # prefix, middle, suffix
    size = np.stack([end - start, end - end, end - end], axis=1)
    for column, rank in ((0, 1), (1, 2), (2, 0)):
        pick = order[:, rank][:, None]
        source[rows, column] = np.take_along_axis(at, pick, 1)[:, 0] + MARK
        size[rows, column] = np.take_along_axis(length, pick, 1)[:, 0]
    ends = np.cumsum(size.sum(axis=1))
    text = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    to = np.cumsum(size.ravel()) - size.ravel()
    for lo, hi, places in shifted(len(text), to, source.ravel() - to):
        text[lo:hi] = raw[places]
    return text, np.append(0, ends)


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``CHUNK`` bytes in ``column``, one row at least."""
    _, offsets = arrow_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1
        end = min(max(end, first + 1), batch.num_rows)
        yield batch.slice(first, end - first)
        first = end


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = arrow_bytes(column)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def fill_in_middle(
    docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for every row; the output as
    UTF-8 bytes."""
    small_batches(docs.sparkSession)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in chunks(batch, "text")):
            raw, offsets = buffer_of(part.column("text"))
            draws, _ = buffer_of(part.column("draws"))
            draws = draws.view(">u4").reshape(-1, 4).astype(np.int64)
            out, ends, n, form, prefix, middle = cut_and_move(raw, offsets, draws, rule)
            plain = form == 0
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(FORMS[form], pa.string()),
                    pa.array(prefix, pa.int64(), mask=plain),
                    pa.array(middle, pa.int64(), mask=plain),
                    binary(out, ends),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    number = F.col(doc_id).cast("long")
    drawn = F.concat(F.lit(f"{rule.seed}:"), F.coalesce(number.cast("string"), F.lit("")))
    return docs.select(
        number.alias("doc_id"),
        text_bytes(text).alias("text"),
        F.unhex(F.substring(F.sha2(drawn.cast("binary"), 256), 1, 32)).alias("draws"),
    ).mapInArrow(moved, CUT)


def restore(cut: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``restored`` added: the text, as UTF-8 bytes, made
    from ``output`` and ``form`` alone."""
    small_batches(cut.sparkSession)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in chunks(batch, "output")):
            raw, offsets = buffer_of(part.column("output"))
            form = np.array(part.column("form").to_pylist(), object)
            text, ends = move_back(raw, offsets, form != PLAIN)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, binary(text, ends)], names=[*part.schema.names, "restored"]
            )

    return cut.select(*[c.split()[0] for c in CUT.split(", ")]).mapInArrow(
        back, CUT + ", restored binary"
    )


def digests_of(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Cut, move back, and give the digests of both."""
    both = restore(fill_in_middle(docs, rule))
    return both.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
