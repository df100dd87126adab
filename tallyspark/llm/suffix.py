"""Removal of long repeated byte strings by sorting suffixes.

Only text near a repeated landmark is sorted. A landmark is the least hashed gram inside a window of ``length`` bytes,
so equal windows have equal landmarks at equal places: windows whose landmark occurs once are unique. The windows of
one landmark are a span; spans in a row, up to a landmark that ends it, are a stream; equal streams, and equal spans of
different streams, are one row with a count, however many documents hold them. Spans are cut into
stretches by the distance to the landmark, and stretches that share the bytes common to all their windows form a
group. Groups are dealt to tasks, and there all suffixes are sorted: those smaller than their successor directly, the
others by scanning the buckets in order. Neighbours with ``length`` bytes in common are the repeats; the same sort
answers a longer length, and says which of equal windows stands first. Groups of many different stretches are dealt
again by narrower stretches until they are small or fully decided.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrays import MORE_POWERS, as_bytes, chunks, mix, next_hash, prefix_hash, signed, span_hash
from tallyspark.session import cut_lineage

LENGTH, GRAM = 400, 32
PASSAGE = 250
GROUP = 512
PIECE = 2 << 20
PART = 1 << 18
SORT_BYTES = 1 << 19
WIDTHS = (128, 16, 2, 1)
WORDS = WIDTHS[0] // 64
STREAM, LONGEST = 16, 64
_MASK = np.uint64((1 << 23) - 1)
_U = np.uint64


@dataclass(frozen=True)
class Windows:
    """What counts as a repeat: ``length`` equal bytes. ``longer`` asks for a second, larger length in the same pass;
    ``first`` asks which of equal windows stands first, by (id, place)."""

    length: int = LENGTH
    longer: int | None = None
    first: bool = False
    gram: int = GRAM

    def __post_init__(self):
        if not 8 <= self.gram <= self.length or (self.longer is not None and (self.longer < self.length or self.first)):
            raise ValueError("8 <= gram <= length <= longer is needed, and either longer or first")

    @property
    def span(self) -> int:
        """Windows that can have one landmark."""
        return self.length - self.gram + 1

    @property
    def reach(self) -> int:
        """Bytes that decide a window."""
        return self.longer or self.length

    @property
    def kinds(self) -> list[str]:
        """Which windows are repeats, longer repeats, and first of their kind."""
        return ["base", *["longer"] * (self.longer is not None), *["first"] * self.first]

    @property
    def masks(self) -> list[str]:
        """Names of the words of bits of each kind."""
        return [f"{k}{w}" for k in self.kinds for w in range(WORDS)]


def _items(texts: list[bytes], w: Windows = Windows()) -> list[tuple[int, int, bytes]]:
    """(text number, offset, bytes): whole texts, long ones in pieces of PIECE windows that share reach - 1 bytes."""
    step = PIECE + w.reach - 1
    places = ((i, t, range(0, len(t) - w.length + 1, max(len(t), 1) if len(t) < step else PIECE)) for i, t in enumerate(texts))
    return [(i, at, t if len(t) < step else t[at : at + step]) for i, t, starts in places for at in starts]


def _least(key: np.ndarray, span: int) -> np.ndarray:
    """The minimum of every ``span`` neighbours."""
    width = 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = span - width
    return np.minimum(key[: len(key) - rest], key[rest:])


def _landmarks(parts: list[bytes], w: Windows):
    """For the joined parts: bytes, prefix hashes, gram hashes, part ends, and per window its start, part and landmark place."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    prefix = prefix_hash(data)
    gram = mix(next_hash(prefix, w.gram))
    best = (_least((gram & ~_MASK) | np.arange(len(gram), dtype=_U), w.span) & _MASK).view(np.int64)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    count = np.maximum(sizes - w.length + 1, 0)
    count[sizes >= PIECE + w.reach - 1] = PIECE
    part = np.repeat(np.arange(len(parts)), count)
    starts = np.arange(len(part)) + np.repeat(ends - sizes - np.cumsum(count) + count, count)
    return data, prefix, gram, ends, starts, part, best[starts]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _sketch(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    """The different landmarks of every text (or piece of one) with at least one window, and 1 or 2 for once or more."""
    for batch in batches:
        texts = as_bytes(batch.column(1))
        items = _items(texts, w)
        for lo, hi in chunks([x[2] for x in items], PART):
            _, _, gram, _, _, part, best = _landmarks([x[2] for x in items[lo:hi]], w)
            head = _runs(part, best)
            owner, mark = part[head], gram[best[head]]
            order = np.lexsort((mark, owner))
            owner, mark = owner[order], mark[order]
            first = _runs(owner, mark)
            times = np.minimum(np.diff(np.append(first, len(mark))), 2).astype(np.int8)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=hi - lo))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(signed(mark[first]))), pa.ListArray.from_arrays(offsets, pa.array(times))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in items[lo:hi]])), *lists], names=["id", "marks", "times"])


def _cells(d: np.ndarray, width: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of a landmark distance, and the largest and smallest distance in that cell."""
    cell = d // width
    return cell, np.minimum(cell * width + width - 1, span - 1), cell * width


def _by_cell(rel: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``count`` windows, the first at landmark distance ``rel``, cut by cell: row, first window and windows of each piece."""
    top = rel // width
    pieces = top - (rel - count + 1) // width + 1
    row = np.repeat(np.arange(len(rel)), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    off = np.maximum(rel[row] - (top[row] - number + 1) * width + 1, 0)
    stop = np.minimum(rel[row] - (top[row] - number) * width + 1, count[row])
    return row, off, stop - off


def _shape(rel: np.ndarray, n: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (rel.astype(_U) << _U(42)) + (n.astype(_U) << _U(21)) + size.astype(_U)


def _stretches(prefix: np.ndarray, more: np.ndarray, lo: np.ndarray, n: np.ndarray, rel: np.ndarray, size: np.ndarray, width: int, w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """core: hash of the bytes that all windows of the cell share; seg: hash of all bytes that decide the stretch."""
    cell, far, close = _cells(rel, width, w.span)
    core = mix(span_hash(prefix, lo + rel - close, lo + rel - far + w.length) + cell.astype(_U) * _U(0x9E3779B97F4A7C15), width)
    seg = mix(span_hash(more, lo, lo + size, MORE_POWERS) + _shape(rel, n, size), width)
    return core, seg


_CELL = "core long, seg long, off int, rel int, n int, size int"
_CELLS = f"array<struct<{_CELL.replace(' ', ':').replace(',:', ',')}>>"
_STREAMS = f"id long, at long, sa long, sb long, spans array<struct<off:int,a:bigint,b:bigint,cells:{_CELLS}>>, bytes array<binary>"


def _streams(part: np.ndarray, head: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stream begins, and for every span its number inside the stream.

    ``head`` are places in the list of all spans: a span follows the one before it if nothing was left out between
    them. ``ends`` says that a landmark ends its stream; by that, equal text gives equal streams wherever it stands.
    """
    new = np.ones(len(head), dtype=bool)
    new[1:] = (part[1:] != part[:-1]) | (head[1:] != head[:-1] + 1) | ends[:-1]
    at = np.arange(len(head))
    number = at - np.maximum.accumulate(np.where(new, at, 0))
    new |= number % LONGEST == 0
    return np.flatnonzero(new), at - np.maximum.accumulate(np.where(new, at, 0))


def _cut(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    """Streams of the spans of windows whose landmark is one of the text's repeated ones, each with its stretches."""
    width = WIDTHS[0]
    for batch in batches:
        texts = as_bytes(batch.column(1))
        items = _items(texts, w)
        marks = batch.column(2)
        for lo, hi in chunks([x[2] for x in items], PART):
            part_bytes = [x[2] for x in items[lo:hi]]
            data, prefix, gram, ends, starts, part, best = _landmarks(part_bytes, w)
            more = prefix_hash(data, MORE_POWERS)
            head = _runs(part, best)
            count = np.diff(np.append(head, len(starts)))
            owner = np.array([x[0] for x in items[lo:hi]])
            first, last = int(owner[0]), int(owner[-1])
            held = marks.slice(first, last - first + 1)
            of = np.repeat(np.arange(first, last + 1), np.diff(held.offsets.to_numpy()))
            known = mix(held.flatten().to_numpy().view(_U) + mix(of.astype(_U), 5))
            wanted = np.isin(mix(gram[best[head]] + mix(owner[part[head]].astype(_U), 5)), known)
            place_of, head, count = np.flatnonzero(wanted), head[wanted], count[wanted]
            at, rel, stop = starts[head], best[head] - starts[head], ends[part[head]]
            size = np.minimum(count - 1 + w.reach, stop - at)
            shape = _shape(rel, count, size)
            names = [mix(span_hash(prefix, at, at + size) + shape, 301), mix(span_hash(more, at, at + size, MORE_POWERS) + shape, 302)]

            row, off, n = _by_cell(rel, count, width)
            place = at[row] + off
            held_bytes = np.minimum(n - 1 + w.reach, stop[row] - place)
            core, seg = _stretches(prefix, more, place, n, rel[row] - off, held_bytes, width, w)
            cells = pa.StructArray.from_arrays([pa.array(signed(core)), pa.array(signed(seg)), *[pa.array(x.astype(np.int32)) for x in (off, rel[row] - off, n, held_bytes)]], names=["core", "seg", "off", "rel", "n", "size"])
            joined = data.tobytes()
            base = np.concatenate([[0], np.cumsum([len(b) for b in part_bytes])])
            inside = at - base[part[head]] + np.array([x[1] for x in items[lo:hi]], dtype=np.int64)[part[head]]
            opens, number = _streams(part[head], place_of, gram[best[head]] % _U(STREAM) == 0)
            lengths = np.diff(np.append(opens, len(head)))
            off = at - np.repeat(at[opens], lengths)
            order = mix((number.astype(_U) << _U(32)) + off.astype(_U), 303)
            whole = [np.add.reduceat(mix(x + order, 304 + k), opens) if len(opens) else x for k, x in enumerate(names)]
            spans = pa.StructArray.from_arrays(
                [
                    pa.array(off.astype(np.int32)), *[pa.array(signed(x)) for x in names],
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(head) + 1)).astype(np.int32)), cells),
                ],
                names=["off", "a", "b", "cells"],
            )
            bounds = pa.array(np.append(opens, len(head)).astype(np.int32))
            held_spans = pa.array([joined[x : x + k] for x, k in zip(at.tolist(), size.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner[part[head[opens]]])), pa.array(inside[opens].astype(np.int64)), *[pa.array(signed(x)) for x in whole],
                    pa.ListArray.from_arrays(bounds, spans), pa.ListArray.from_arrays(bounds, held_spans),
                ],
                names=["id", "at", "sa", "sb", "spans", "bytes"],
            )


_UNIT = "core long, seg long, m long, id long, at long, rel int, n int, size int"


def _narrower(batches: Iterator[pa.RecordBatch], width: int, w: Windows) -> Iterator[pa.RecordBatch]:
    """Cut stretches into those of a smaller cell width."""
    for batch in batches:
        held = as_bytes(batch.column(8))
        for lo, hi in chunks(held, PART):
            data = np.frombuffer(b"".join(held[lo:hi]), dtype=np.uint8)
            base = np.concatenate([[0], np.cumsum([len(b) for b in held[lo:hi]])])[:-1]
            rel0, n0, size0 = (batch.column(k).to_numpy()[lo:hi].astype(np.int64) for k in (5, 6, 7))
            row, off, n = _by_cell(rel0, n0, width)
            place, size = base[row] + off, np.minimum(n - 1 + w.reach, size0[row] - off)
            core, seg = _stretches(prefix_hash(data), prefix_hash(data, MORE_POWERS), place, n, rel0[row] - off, size, width, w)
            joined = data.tobytes()
            own = pa.array(row + lo)
            first = batch.column(4).take(own).to_numpy() + off
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(own), batch.column(1).take(own), pa.array(off.astype(np.int32)), pa.array(signed(core)), pa.array(signed(seg)), batch.column(2).take(own), batch.column(3).take(own), pa.array(first),
                    *[pa.array(x.astype(np.int32)) for x in (rel0[row] - off, n, size)], pa.array([joined[x : x + k] for x, k in zip(place.tolist(), size.tolist())], pa.binary()),
                ],
                names=["pcore", "pseg", "off", "core", "seg", "m", "id", "at", "rel", "n", "size", "bytes"],
            )


def suffix_order(parts: list[bytes], reach: int = LENGTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of the joined parts in the order of their suffixes, compared up to ``reach`` bytes inside the part.

    With ``wanted``, the number of places asked for at the start of each part, places behind are left out as far as
    no wanted one follows from them.

    A suffix smaller than its successor is sorted directly. Any other suffix starts a bucket's first half and
    follows from its successor: the buckets are scanned in byte order, and what stands before a suffix already
    in place is appended to its own bucket. Equal bytes in a row are resolved inside their bucket.
    """
    data = b"".join(parts)
    text = np.frombuffer(data, dtype=np.uint8)
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    n = len(text)
    last = np.zeros(n, dtype=bool)
    last[ends - 1] = True
    first = np.zeros(n, dtype=bool)
    first[ends - sizes] = True
    follow = np.append(text[1:], 0)
    differs = last | (text != follow)
    decider = np.flatnonzero(differs)[np.searchsorted(np.flatnonzero(differs), np.arange(n))]
    smaller = ~last[decider] & (text[decider] < follow[decider])
    end_of = np.repeat(ends, sizes)
    if wanted is None:
        needed = np.ones(n, dtype=bool)
    else:
        sure = np.append(np.flatnonzero(smaller), n)
        stop = np.minimum(sure[np.searchsorted(sure, ends - sizes + wanted - 1)], ends - 1)
        needed = np.arange(n) <= np.repeat(stop, sizes)
    direct = np.flatnonzero(smaller & needed)
    stops = np.minimum(direct + reach, end_of[direct])
    keys = [data[a:b] for a, b in zip(direct.tolist(), stops.tolist())]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys
    sorted_bucket = text[direct]
    cut = np.searchsorted(sorted_bucket, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def spread(placed: np.ndarray, least: int) -> None:
        """Hand what stands before the placed suffixes to the buckets from ``least`` on."""
        before = placed[~first[placed]] - 1
        before = before[~smaller[before] & (text[before] >= least)]
        of = text[before]
        order = np.argsort(of, kind="stable")
        before, of = before[order], of[order]
        edges = [*_runs(of).tolist(), len(of)] if len(of) else []
        for a, b in pairwise(edges):
            waiting[of[a]].append(before[a:b])

    out = []
    closing = ends[needed[ends - 1]] - 1
    order = np.argsort(text[closing], kind="stable")
    for place in np.split(closing[order], _runs(text[closing[order]])[1:]) if len(closing) else []:
        waiting[text[place[0]]].append(place)
    for c in range(256):
        k = 0
        while k < len(waiting[c]):
            placed = waiting[c][k]
            out.append(placed)
            spread(placed, c)
            k += 1
        placed = direct[cut[c] : cut[c + 1]]
        if len(placed):
            out.append(placed)
            spread(placed, c + 1)
        waiting[c] = []
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def equal_ahead(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes (eight at least) from a and from b on are equal."""
    out = np.zeros(len(a), dtype=bool)
    if not len(a):
        return out
    steps = np.append(np.arange(0, length - 8, 8), length - 8)
    eight = np.ndarray((len(text) - 7,), dtype="<i8", buffer=np.ascontiguousarray(text).data, strides=(1,))
    ends = np.flatnonzero((eight[a] == eight[b]) & (eight[a + (length - 8)] == eight[b + (length - 8)]))
    for lo in range(0, len(ends), 4096):
        some = ends[lo : lo + 4096]
        out[some] = (eight[a[some, None] + steps] == eight[b[some, None] + steps]).all(axis=1)
    return out


def _bits(row: np.ndarray, place: np.ndarray, rows: int) -> np.ndarray:
    """One row of WORDS 64-bit words per stretch."""
    bits = np.zeros((rows, WIDTHS[0]), dtype=bool)
    bits[row, place] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _sort_groups(units: dict[str, np.ndarray], held: list[bytes], w: Windows) -> np.ndarray:
    """Per stretch the words of bits named by ``w.masks``, from the sorted suffixes of all."""
    n = units["n"]
    text = np.frombuffer(b"".join(held), dtype=np.uint8)
    sizes = np.array([len(b) for b in held])
    row = np.repeat(np.arange(len(held)), sizes)
    base = np.cumsum(sizes) - sizes
    order = suffix_order(held, w.reach, n)
    order = order[order - base[row[order]] < n[row[order]]]
    row, place = row[order], order - base[row[order]]
    same = equal_ahead(text, order[:-1], order[1:], w.length)
    twice = np.append(same, False) | np.append(False, same) | (units["m"][row] > 1)
    out = [_bits(row[twice], place[twice], len(held))]
    if w.longer is not None:
        whole = sizes[row] - place >= w.longer
        far = np.zeros(len(order), dtype=bool)
        pairs = np.flatnonzero(same & whole[:-1] & whole[1:])
        equal = pairs[equal_ahead(text, order[pairs], order[pairs + 1], w.longer)]
        far[equal] = far[equal + 1] = True
        far |= whole & (units["m"][row] > 1)
        out.append(_bits(row[far], place[far], len(held)))
    if w.first:
        kind = np.cumsum(np.append(True, ~same))
        ahead = np.lexsort((units["at"][row] + place, units["id"][row], kind))
        least = ahead[_runs(kind[ahead])]
        least = least[twice[least]]
        out.append(_bits(row[least], place[least], len(held)))
    return np.concatenate(out, axis=1)


def _sort(batches: Iterator[pa.RecordBatch], w: Windows) -> Iterator[pa.RecordBatch]:
    """Whole groups, a few at a time, into masks. Rows come sorted by core."""

    def ready(table: pa.Table) -> pa.RecordBatch:
        masks = _sort_groups({c: table[c].to_numpy() for c in ("n", "m", "id", "at")}, as_bytes(table["bytes"].combine_chunks()), w)
        hit = pa.array(masks.any(axis=1))
        names = ["core", "seg", "id", "at"]
        columns = [*[table[c].combine_chunks() for c in names], *[pa.array(np.ascontiguousarray(masks[:, k])) for k in range(masks.shape[1])]]
        return pa.RecordBatch.from_arrays(columns, names=[*names, *w.masks]).filter(hit)

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        core = table["core"].to_numpy()
        grown = np.cumsum(table["size"].to_numpy().astype(np.int64))
        bounds = _runs(core)
        at = 0
        for k, edge in enumerate(bounds[1:], 1):
            behind = grown[at - 1] if at else 0
            beyond = bounds[k + 1] if k + 1 < len(bounds) else len(core)
            if grown[beyond - 1] - behind > SORT_BYTES:
                yield ready(table.slice(at, edge - at))
                at = edge
        rest = table.slice(at)
    if rest is not None and rest.num_rows:
        yield ready(rest)


def _first_bits(n: str, name: str) -> list:
    """Mask, in two words, of the first n windows."""
    return [
        F.expr(f"CASE WHEN {n} >= 64 THEN -1L WHEN {n} <= 0 THEN 0L ELSE shiftrightunsigned(-1L, 64 - {n}) END").alias(f"{name}0"),
        F.expr(f"CASE WHEN {n} >= 128 THEN -1L WHEN {n} > 64 THEN shiftrightunsigned(-1L, 128 - {n}) ELSE 0L END").alias(f"{name}1"),
    ]


def _lifted(off: str, name: str) -> list:
    """The mask moved up by ``off`` windows."""
    low, high = f"{name}0", f"{name}1"
    return [
        F.expr(f"CASE WHEN {off} < 64 THEN shiftleft({low}, {off}) ELSE 0L END").alias(low),
        F.expr(f"CASE WHEN {off} = 0 THEN {high} WHEN {off} < 64 THEN shiftrightunsigned({low}, 64 - {off}) | shiftleft({high}, {off}) ELSE shiftleft({low}, {off} - 64) END").alias(high),
    ]


def _repeats(units: DataFrame, with_bytes: Callable[[DataFrame], DataFrame], w: Windows, level: int = 0) -> DataFrame:
    """(core, seg, id, at, masks): one row per different stretch with repeats. ``units`` are the different stretches, with
    their count m and the first (id, at) that holds them; ``with_bytes`` adds the bytes to some of them.

    A stretch that occurs twice is all repeats. In a group of one stretch nothing else is to be found; groups in which
    every stretch occurs twice are sorted only if the first of equal windows is asked for.
    """
    if WIDTHS[level] == 1:
        return _single(units, w)
    whole = {"base": "n", "longer": f"least(n, size - {w.longer} + 1)", "first": "n"}
    groups = units.groupBy("core").agg(F.count("*").alias("g"), F.min("m").alias("least"))
    alone = units.where("m > 1")
    if w.first:
        alone = alone.join(groups.where("g = 1").select("core"), "core", "left_semi")
    found = alone.select("core", "seg", "id", "at", *[c for k in w.kinds for c in _first_bits(whole[k], k)])
    wanted = units.join(groups.where("g > 1" if w.first else "g > 1 and least = 1").select("core", "g"), "core")
    names = [c.split()[0] for c in _UNIT.split(", ")]
    small = with_bytes(wanted.where(F.col("g") <= GROUP)).select(*names, "bytes").repartition("core").sortWithinPartitions("core", "seg")
    masks = ", ".join(f"{c} long" for c in w.masks)
    found = found.union(cut_lineage(small.mapInArrow(partial(_sort, w=w), f"core long, seg long, id long, at long, {masks}"), "repeats"))
    hot = wanted.where(F.col("g") > GROUP)
    if not hot.isEmpty():
        cut = with_bytes(hot).select(*names, "bytes")
        schema = f"pcore long, pseg long, off int, {_UNIT}, bytes binary"
        parts = cut_lineage(cut.mapInArrow(partial(_narrower, width=WIDTHS[level + 1], w=w), schema), "narrower")
        bytes_of = parts.groupBy("core", "seg").agg(F.first("bytes").alias("bytes"))
        inner = _repeats(_units(parts), lambda some: some.join(bytes_of, ["core", "seg"]), w, level + 1)
        up = parts.select("pcore", "pseg", F.col("id").alias("pid"), F.col("at").alias("pat"), "off", "core", "seg").join(inner, ["core", "seg"])
        up = _own_first(up, "pid", "pat", w).withColumn("pat", F.col("pat") - F.col("off"))
        found = found.union(up.select("pcore", "pseg", "pid", "pat", *[c for k in w.kinds for c in _lifted("off", k)]))
    return found.groupBy("core", "seg").agg(F.first("id").alias("id"), F.first("at").alias("at"), *[F.bit_or(c).alias(c) for c in w.masks])


def _own_first(rows: DataFrame, id_col: str, at_col: str, w: Windows) -> DataFrame:
    """The masks of a stretch as part of a larger one: its first windows stand there only if its first place does."""
    here = (F.col("id") == F.col(id_col)) & (F.col("at") == F.col(at_col))
    return rows.withColumns({c: F.when(here, F.col(c)).otherwise(F.lit(0)) for c in w.masks if c.startswith("first")})


def _single(units: DataFrame, w: Windows) -> DataFrame:
    """The masks of stretches of one window each: those of a group are equal, and need no sorting."""
    groups = units.groupBy("core").agg(F.sum("m").alias("held"), F.min(F.struct("id", "at")).alias("lead")).where("held > 1")
    one = {"base": F.lit(1), "longer": F.expr(f"if(m > 1 and size >= {w.longer}, 1, 0)"), "first": F.expr("if(id = lead.id and at = lead.at, 1, 0)")}
    bits = [c for k in w.kinds for c in (one[k].cast("long").alias(f"{k}0"), F.lit(0).cast("long").alias(f"{k}1"))]
    return units.join(groups, "core").select("core", "seg", "id", "at", *bits)


def _units(rows: DataFrame) -> DataFrame:
    """Different stretches (core, seg) with the sum of m, the first (id, at) and its offset."""
    held = rows.groupBy("core", "seg").agg(F.sum("m").alias("m"), F.min(F.struct("id", "at", "off")).alias("p"), F.first("rel").alias("rel"), F.first("n").alias("n"), F.first("size").alias("size"))
    return cut_lineage(held.select("core", "seg", "m", "p.id", "p.at", "p.off", "rel", "n", "size"), "stretch")


def _whole_characters(data: np.ndarray, starts: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``gone`` and the other bytes of every UTF-8 character that has lost one. Texts begin at ``starts``."""
    place = np.flatnonzero(data >= 0x80)  # ASCII bytes are characters by themselves, and end any other
    if not len(place) or not gone.any():
        return gone
    byte, at = data[place], np.arange(len(place))
    head = (byte >> 6 != 2) | np.isin(place, starts)
    lead = np.maximum.accumulate(np.where(head, at, 0))
    size = 1 + (byte >= 0xC0).astype(np.int64) + (byte >= 0xE0) + (byte >= 0xF0)
    behind = place - place[lead]
    owner = np.where((behind < size[lead]) & (behind == at - lead), lead, at)
    out = gone.copy()
    out[place] = (np.bincount(owner, weights=gone[place], minlength=len(place)) > 0)[owner]
    return out


def _covered(sizes: np.ndarray, owner: np.ndarray, at: np.ndarray, masks: np.ndarray, whole: np.ndarray, length: int) -> np.ndarray:
    """Bytes of the joined texts that the set windows cover, and all bytes of the texts that are ``whole`` repeats."""
    starts = np.cumsum(sizes) - sizes
    row, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=1, bitorder="little")) if len(masks) else (np.zeros(0, np.int64),) * 2
    first = starts[owner[row]] + at[row] + bit
    n = int(sizes.sum())
    edge = np.bincount(first, minlength=n + 1) - np.bincount(first + length, minlength=n + 1)
    return (np.cumsum(edge)[:n] > 0) | np.repeat(whole & (sizes >= length), sizes)


def _erase(batches: Iterator[pa.RecordBatch], w: Windows, characters: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, whole, marks: list of (at, masks)) into what is left of each text."""
    for batch in batches:
        texts = as_bytes(batch.column(1))
        whole = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        held = batch.column(3)
        offsets = np.concatenate([[0], np.cumsum(held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
        marks = held.flatten()
        at, words = marks.field("at").to_numpy(), {c: marks.field(c).to_numpy() for c in w.masks}
        for lo, hi in chunks(texts, PART):
            data = np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8)
            sizes = np.array([len(t) for t in texts[lo:hi]])
            a, b = offsets[lo], offsets[hi]
            owner = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
            columns = [batch.column(0).slice(lo, hi - lo), pa.array(sizes.astype(np.int64))]
            for kind, length in (("base", w.length), ("longer", w.longer)):
                if length is None:
                    continue
                masks = np.stack([words[f"{kind}{k}"][a:b] for k in range(WORDS)], axis=1)
                gone = _covered(sizes, owner, at[a:b], masks, whole[lo:hi], length)
                starts = np.cumsum(sizes) - sizes
                if characters and kind == "base":
                    gone = _whole_characters(data, starts, gone)
                ends = np.concatenate([[0], np.cumsum(gone)])
                new = gone & ~np.concatenate([[False], gone[:-1]])
                new[starts[sizes > 0]] = gone[starts[sizes > 0]]
                runs = np.concatenate([[0], np.cumsum(new)])
                kept, cuts = data[~gone].tobytes(), starts - ends[starts]
                left = sizes - (ends[starts + sizes] - ends[starts])
                columns += [pa.array(sizes - left), pa.array(runs[starts + sizes] - runs[starts]), pa.array([kept[x : x + k] for x, k in zip(cuts.tolist(), left.tolist())], pa.binary())]
            names = [f"{p}{c}" for p in ("", "longer_")[: 1 + (w.longer is not None)] for c in ("removed", "spans", "kept")]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", *names])


def repeated_windows(docs: DataFrame, w: Windows, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, whole, marks): per document and span, the windows that also start elsewhere in the table (with ``w.first``:
    earlier). They are the set bits of the masks in ``marks``, counted from its ``at``. ``whole`` is a text that stands
    elsewhere (earlier) as a whole.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    base = cut_lineage(texts.where(F.octet_length("text") >= w.length).select("id", F.unhex(F.sha2("text", 256)).alias("sha")), "texts")
    same = base.groupBy("sha").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    sketch = texts.mapInArrow(partial(_sketch, w=w), "id long, marks array<long>, times array<tinyint>")
    single = cut_lineage(sketch.join(same.select(F.col("first").alias("id")), "id", "left_semi"), "marks")
    each = single.select("id", F.explode(F.arrays_zip("marks", "times")).alias("x")).select("id", F.col("x.marks").alias("mark"), F.col("x.times").alias("times"))
    often = cut_lineage(each.groupBy("mark").agg(F.sum("times").alias("k")).where("k > 1").select("mark"), "often")
    hits = each.select("id", "mark").join(often, "mark", "left_semi").groupBy("id").agg(F.collect_set("mark").alias("marks"))
    streams = cut_lineage(texts.join(hits, "id").select("id", "text", "marks").mapInArrow(partial(_cut, w=w), _STREAMS), "streams")

    equal = streams.groupBy("sa", "sb").agg(F.count("*").alias("m"), F.min(F.struct("id", "at")).alias("p"), F.first("spans").alias("spans"))
    held = cut_lineage(equal.select("sa", "sb", "m", "p", F.explode("spans").alias("x")).select("sa", "sb", "m", F.struct("p.id", (F.col("p.at") + F.col("x.off")).alias("at")).alias("p"), "x.*"), "spans")
    different = held.groupBy("a", "b").agg(F.sum("m").alias("m"), F.min("p").alias("p"), F.first("cells").alias("cells"))
    cells = different.select("a", "b", "m", "p", F.explode("cells").alias("c")).select("a", "b", "m", "p", "p.id", (F.col("p.at") + F.col("c.off")).alias("at"), *[f"c.{x.split()[0]}" for x in _CELL.split(", ")])
    cells = cut_lineage(cells, "cells")

    def with_bytes(some: DataFrame) -> DataFrame:
        place = streams.select("id", "at", F.explode(F.expr("arrays_zip(spans.off, bytes)")).alias("x")).select("id", (F.col("at") + F.col("x.off")).alias("span_at"), "x.bytes")
        return some.withColumn("span_at", F.col("at") - F.col("off")).join(place, ["id", "span_at"]).withColumn("bytes", F.expr("substring(bytes, off + 1, size)"))

    masks = cut_lineage(_repeats(_units(cells), with_bytes, w), "masks")
    marked = _own_first(cells.select("a", "b", "p", "core", "seg", "off", F.col("id").alias("pid"), F.col("at").alias("pat")).join(masks, ["core", "seg"]), "pid", "pat", w)
    marked = cut_lineage(marked.groupBy("a", "b").agg(F.first("p").alias("p"), F.collect_list(F.struct("off", *w.masks)).alias("marks")), "marked")
    # marks meet the different streams, and only streams with marks meet the texts
    found = held.select("sa", "sb", F.col("off").alias("to"), "a", "b").join(marked, ["a", "b"])
    found = found.select("sa", "sb", F.expr("transform(marks, x -> named_struct('to', to, 'p', p, 'x', x))").alias("marks"))
    found = cut_lineage(found.groupBy("sa", "sb").agg(F.flatten(F.collect_list("marks")).alias("marks")), "found")  # read from files, so a join key with most rows can be split
    runs = streams.select("id", "at", "sa", "sb").join(found, ["sa", "sb"])
    lead = "(id = y.p.id AND at + y.to = y.p.at)" if w.first else "false"
    bits = ", ".join(f"'{c}', " + (f"y.x.{c} & ~if({lead}, y.x.first{c[-1]}, 0L)" if w.first and c.startswith("base") else f"y.x.{c}") for c in w.masks)
    runs = runs.select("id", F.lit(False).alias("whole"), F.expr(f"transform(marks, y -> named_struct('at', at + y.to + y.x.off, {bits}))").alias("marks"))
    copies = base.join(same.where("copies > 1"), "sha").where("id <> first" if w.first else "true").select("id", F.lit(True).alias("whole"))
    return runs.unionByName(copies, allowMissingColumns=True)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", characters: bool = False, windows: Windows = Windows()) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (the remaining UTF-8 bytes) of every document.

    Every byte covered by ``windows.length`` bytes that also start elsewhere, in the same document or another, is
    removed; overlaps count, and strings are judged on the input. With ``windows.longer``, longer_removed, longer_spans
    and longer_kept say the same for that length. With ``windows.first``, the first of equal windows by (id, place)
    removes nothing, so one copy of every passage stays.

    Null texts are empty; texts shorter than the length stay. Texts with equal bytes are searched once and lose
    everything (with ``windows.first``, all but the one with the smallest id). Ids must be unique and not null (a null
    id's text is judged and kept whole); other columns are ignored; an empty table gives no rows. With ``characters`` a
    character that loses a byte loses all of them (not in the columns for ``windows.longer``); bytes that are no UTF-8
    count singly.
    """
    runs = repeated_windows(docs, windows, id_col, text_col).groupBy("id").agg(F.bool_or("whole").alias("whole"), F.flatten(F.collect_list("marks")).alias("marks"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    joined = texts.join(runs, "id", "left").select("id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "marks")
    longer = ", longer_removed long, longer_spans long, longer_kept binary" if windows.longer is not None else ""
    out = joined.mapInArrow(partial(_erase, w=windows, characters=characters), f"id long, n_bytes long, removed long, spans long, kept binary{longer}")
    return out.withColumnsRenamed({"removed": "n_removed", "spans": "n_spans"})
