"""Fill-in-the-middle: a text cut at two lines and put together anew, so that its middle comes last.

The lines of a text are the bottom lane of an indexable skip list. Every SPACING-th line end is a node of
the lane above, every SPACING-th node of that one of the next, and each node carries widths: how many
lines, code points and bytes lie between it and the node before. A cut is a rank among the lines: from the
top lane down, nodes are passed as long as the widths add up to no more than the rank, and what they add
up to is where the cut stands, in code points and in bytes. The bottom lane is the text itself, so the list
of a text of n lines takes about n / SPACING nodes, and a long text is read in stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from storkline.llm import text

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SPACING = 64
#: bytes read at once while the lanes are laid
STRETCH = 1 << 20
_BREAK = 10
_STARTS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point

_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class SkipList:
    """The lines of a UTF-8 text by rank. `n` is their number."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        flat = np.frombuffer(data, np.uint8)
        self.n, points, at_points, at_bytes = 0, 0, [], []
        for begin in range(0, len(flat), STRETCH):
            part = flat[begin:begin + STRETCH]
            breaks = np.flatnonzero(part == _BREAK)
            sums = np.cumsum(_STARTS[part], dtype=np.int64)
            nodes = breaks[SPACING - 1 - self.n % SPACING::SPACING]
            at_points.append(points + sums[nodes])
            at_bytes.append(begin + nodes + 1)
            self.n += len(breaks)
            points += int(sums[-1])
        self.n += bool(data) and data[-1] != _BREAK
        self.points = points
        #: per lane, from the second lowest up: lines, code points and bytes between neighbouring nodes
        self.lanes: list[tuple[int, np.ndarray, np.ndarray]] = []
        ends = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in (at_points, at_bytes)]
        lines = SPACING
        while len(ends[0]):
            self.lanes.append((lines, *(np.diff(x, prepend=0) for x in ends)))
            ends = [x[SPACING - 1::SPACING] for x in ends]
            lines *= SPACING

    def find(self, rank: int) -> tuple[int, int]:
        """Code points and bytes before the line of this rank; all of them for rank n."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        if rank == self.n:
            return self.points, len(self.data)
        passed = points = at = 0
        for lines, by_points, by_bytes in reversed(self.lanes):
            node = passed // lines
            while passed + lines <= rank:
                passed, points, at, node = passed + lines, points + int(by_points[node]), at + int(by_bytes[node]), node + 1
        begin = at
        while passed < rank:
            at = self.data.index(b"\n", at) + 1
            passed += 1
        return points + int(np.count_nonzero(_STARTS[np.frombuffer(self.data, np.uint8, at - begin, begin)])), at


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers that depend on the id and the seed alone; null is an empty id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def arrange(data: bytes, doc_id: int | None, seed: int, share: int, spm_share: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Number of lines, form, code points of prefix and middle, and the text in that form."""
    lines = SkipList(data)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or PREFIX in data or SUFFIX in data or MIDDLE in data or h3 % 100 >= share:
        return lines.n, "plain", None, None, data
    (p, a), (q, b) = (lines.find(rank) for rank in sorted((h1 % (lines.n + 1), h2 % (lines.n + 1))))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm_share:
        return lines.n, "spm", p, q - p, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return lines.n, "psm", p, q - p, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def _rearrange(seed: int, share: int, spm_share: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.chunks(batches):
            data, offsets = text.raw(batch.column("text"))
            ids, bounds = batch.column("doc_id").to_pylist(), offsets.tolist()
            rows = [
                arrange(data[a:b].tobytes(), i, seed, share, spm_share) for i, a, b in zip(ids, bounds[:-1], bounds[1:], strict=True)
            ]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string()),
            ], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def rearrange(docs: DataFrame, seed: int = 7, share: int = 100, spm_share: int = 50) -> DataFrame:
    """One row per row of `docs`: `doc_id`; `n`, the lines of the text; `form`, plain, psm (prefix, suffix,
    middle) or spm (suffix, prefix, middle); `prefix_chars` and `middle_chars` in code points, null if plain;
    `output`, the text in that form with a sentinel before each part.

    `share` percent of the texts are rearranged and `spm_share` percent of those as spm; where the cuts stand
    and which form is taken depend on doc_id and `seed` alone. A text stays plain if it is empty or null or
    holds a sentinel itself. Rows without doc_id draw as an empty id; repeated rows give repeated rows; other
    columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_rearrange(seed, share, spm_share), _OUT)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that stood before rearrangement. A rearranged text holds each sentinel once."""
    parts = F.split(F.col(output), f"{PREFIX.decode()}|{SUFFIX.decode()}|{MIDDLE.decode()}")
    order = F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2])).when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1]))
    return F.coalesce(order, F.col(output))
