"""Fill-in-the-middle texts: a text is cut into prefix, middle and suffix between lines and written in another order.

A rolling hash cuts every text into chunks that depend on its content alone, so passages that texts share become equal
chunks. What is known of a chunk (line ends, code points before each, marks, its edges) is kept in a memory of bounded
size under the chunk's bytes, so a hit is a comparison of contents. Sums over the chunk counts say which chunk holds a
cut, and only that chunk's line ends are looked at. No row leaves its task.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrays import as_bytes, chunks, prefix_hash, span_hash

# The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
WINDOW, LEAST, MOST = 48, 256, 16_384
MEMORY = 16 << 20
_RARE = np.uint64(54)


class Chunk:
    """What one chunk says about every text that holds it."""

    __slots__ = ("chars", "chars_at", "ends", "lines", "marked")

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, dtype=np.uint8)
        starts = np.cumsum((raw & 0xC0) != 0x80)
        ends = np.flatnonzero(raw == 10)
        self.lines, self.chars = len(ends), int(starts[-1])
        self.ends, self.chars_at = (ends + 1).tolist(), starts[ends].tolist()
        self.marked = any(m in data for m in MARKS)


class ChunkMemory:
    """Chunks by their bytes, in two generations of at most ``limit`` bytes each: the older one goes when the newer is full."""

    def __init__(self, limit: int = MEMORY):
        self.limit, self.size, self.new, self.old = limit, 0, {}, {}
        self.hits = self.misses = 0

    def get(self, data: bytes) -> Chunk:
        found = self.new.get(data)
        if found is not None:
            self.hits += 1
            return found
        found = self.old.get(data)
        if found is None:
            self.misses += 1
            found = Chunk(data)
        else:
            self.hits += 1
        if self.size + len(data) > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[data] = found
        self.size += len(data)
        return found


def content_cuts(texts: list[bytes]) -> list[list[int]]:
    """Chunk ends of each text: after a rare value of the rolling hash, LEAST to MOST bytes apart (the last may be shorter)."""
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    stops = np.arange(WINDOW, len(joined) + 1)
    rare = stops[span_hash(prefix_hash(joined), stops - WINDOW, stops) >> _RARE == 0].tolist() if len(stops) else []
    out, base = [], 0
    for text in texts:
        end, at, cuts = base + len(text), base, []
        while at < end:
            k = bisect_left(rare, at + LEAST)
            at = min(rare[k] if k < len(rare) else end, at + MOST, end)
            cuts.append(at - base)
        out.append(cuts)
        base = end
    return out


class Parts:
    """A text's chunks with running totals of their lines and code points."""

    def __init__(self, text: bytes, cuts: list[int], memory: ChunkMemory):
        self.text = text
        self.starts = [0, *cuts]
        self.held = [memory.get(text[a:b]) for a, b in zip(self.starts, cuts)]
        self.lines = list(accumulate((c.lines for c in self.held), initial=0))
        self.chars = list(accumulate((c.chars for c in self.held), initial=0))
        self.n = self.lines[-1] + bool(text and not text.endswith(b"\n"))
        edges = (text[max(0, c - 2) : c + 2] for c in self.starts[1:-1])
        self.marked = any(c.marked for c in self.held) or any(m in e for e in edges for m in MARKS)

    def place(self, line: int) -> tuple[int, int]:
        """(bytes, code points) before the end of the first ``line`` lines."""
        if line == 0:
            return 0, 0
        if line > self.lines[-1]:
            return len(self.text), self.chars[-1]
        k = bisect_left(self.lines, line) - 1
        inner = line - self.lines[k] - 1
        return self.starts[k] + self.held[k].ends[inner], self.chars[k] + self.held[k].chars_at[inner]


def _rearrange(batches: Iterator[pa.RecordBatch], infill_percent: int, spm_percent: int) -> Iterator[pa.RecordBatch]:
    memory = ChunkMemory()
    for batch in batches:
        texts = as_bytes(batch.column(1))
        draws = np.array(batch.column(2).to_pylist(), dtype=np.int64).reshape(-1, 4).tolist()
        rows = []
        for lo, hi in chunks(texts):
            for text, cuts, (first, second, whether, order) in zip(texts[lo:hi], content_cuts(texts[lo:hi]), draws[lo:hi]):
                parts = Parts(text, cuts, memory)
                if not text or parts.marked or whether % 100 >= infill_percent:
                    rows.append((parts.n, "plain", None, None, text))
                    continue
                (a, a_chars), (b, b_chars) = map(parts.place, sorted((first % (parts.n + 1), second % (parts.n + 1))))
                spm = order % 100 < spm_percent
                pieces = (SUFFIX, text[b:], PREFIX, text[:a]) if spm else (PREFIX, text[:a], SUFFIX, text[b:])
                rows.append((parts.n, "spm" if spm else "psm", a_chars, b_chars - a_chars, b"".join((*pieces, MIDDLE, text[a:b]))))
        n, form, prefix, middle, out = zip(*rows) if rows else ([],) * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary())],
            names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, infill_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars (code points) and output of every document.

    The two cuts, whether a text is rearranged and in which order come from the sha256 of ``seed``, a colon and the
    id, so a run repeats exactly. A text that is empty or holds one of the marks stays plain, with null counts. Null
    texts are empty; a null id draws as an empty one. Repeated rows give equal rows, one each; other columns are
    ignored, whatever their names; an empty table gives no rows. A very long text is one value of one task.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), draws.alias("draws"))
    kind = rows.schema["id"].dataType.simpleString()
    run = partial(_rearrange, infill_percent=infill_percent, spm_percent=spm_percent)
    made = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` rearranged, from what it wrote alone."""
    parts = F.split(output, "<[PSM]>", -1)
    in_order = F.when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))
    return F.when(form == "plain", output).otherwise(in_order)
