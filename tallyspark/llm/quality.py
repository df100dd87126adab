"""Text quality from weak labels: noisy rules vote, their accuracies are estimated, a linear scorer learns the result.

No hand-made label is used. Expectation-maximisation runs over the counts of vote patterns of all documents
(at most 3^rules patterns, however large the corpus). The scorer is fitted on a bounded sample of documents and
scores all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.arrays import as_bytes, chunks, mix, word_hashes
from tallyspark.session import cut_lineage

DIMENSIONS = 1 << 12
TRAIN_ROWS = 20_000
ROUNDS = 60
RULES = ("noisy", "capitals", "echo", "bars", "variety", "stops", "symbols")
_U = np.uint64


def _table(members) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(members)] = 1
    return out


_UPPER = _table(range(65, 91))
_LOWER = _table([*range(97, 123), *range(128, 256)])
_DIGIT = _table(range(48, 58))
_SPACE = _table([0x20, *range(0x09, 0x0E)])
_MARK = 1 - np.clip(_UPPER + _LOWER + _DIGIT + _SPACE, 0, 1)
_ODD = _table(b"#$%&*|!@^~<>{}=\\")


class Words:
    """Word counts of a chunk of texts."""

    def __init__(self, texts: list[bytes]):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        space = _SPACE[joined].astype(bool)
        edge = np.flatnonzero(np.diff(space, prepend=True))
        start, stop = edge[0::2], edge[1::2]
        self.owner, self.hash = word_hashes(texts)
        self.n = np.bincount(self.owner, minlength=len(texts))
        self.upper, self.lower, self.digit, self.mark, self.odd = (self._count(t, joined, start, stop) for t in (_UPPER, _LOWER, _DIGIT, _MARK, _ODD))
        self.ends = joined[stop - 1] == ord(".") if len(stop) else np.zeros(0, dtype=bool)
        self.echo = np.zeros(len(self.owner), dtype=bool)
        self.echo[1:] = (self.owner[1:] == self.owner[:-1]) & (self.hash[1:] == self.hash[:-1])

    @staticmethod
    def _count(kind: np.ndarray, joined: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[joined])])
        return total[stop] - total[start]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=values, minlength=len(self.n))


def votes(texts: list[bytes]) -> np.ndarray:
    """(texts, rules): 1 for junk, 0 for clean, -1 for no opinion."""
    w = Words(texts)
    n = np.maximum(w.n, 1)
    letters = w.per_text(w.upper + w.lower)
    size = np.maximum(w.per_text(w.upper + w.lower + w.digit + w.mark), 1)
    order = np.lexsort((w.hash, w.owner))
    o, h = w.owner[order], w.hash[order]
    fresh = np.ones(len(o), dtype=bool)
    fresh[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    distinct = np.bincount(o[fresh], minlength=len(n))
    measures = (
        (w.per_text(w.mark >= 2) / n, 0.2, 0.05, w.n >= 5),
        (w.per_text(w.upper) / np.maximum(letters, 1), 0.5, 0.2, letters >= 20),
        (w.per_text(w.echo) / n, 0.2, 0.05, w.n >= 10),
        (w.per_text((w.mark > 0) & (w.upper + w.lower + w.digit == 0)) / n, 0.1, 0.02, w.n >= 5),
        (1 - distinct / n, 0.9, 0.7, w.n >= 50),
        (1 - w.per_text(w.ends) / n, 0.995, 0.97, w.n >= 40),
        (w.per_text(w.odd) / size, 0.05, 0.01, w.n >= 5),
    )
    out = np.full((len(texts), len(RULES)), -1, dtype=np.int8)
    for k, (value, junk, clean, enough) in enumerate(measures):
        out[(value > junk) & enough, k] = 1
        out[(value < clean) & enough, k] = 0
    return out


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, dimension, value): hashed word shapes, pairs of shapes, repeats and words; squares sum to one."""
    w = Words(texts)
    shape = np.minimum(w.upper, 3) + 4 * np.minimum(w.lower, 3) + 16 * np.minimum(w.digit, 2) + 64 * np.minimum(w.mark, 4) + 512 * w.echo
    shape = shape.astype(_U)
    pair = shape[1:] * _U(4096) + shape[:-1]
    same = w.owner[1:] == w.owner[:-1]
    owner = np.concatenate([w.owner, w.owner[1:][same], w.owner])
    code = np.concatenate([mix(shape, 1), mix(pair[same], 2), mix(w.hash, 3)]) % _U(DIMENSIONS)
    cell, count = np.unique(owner * DIMENSIONS + code.astype(np.int64), return_counts=True)
    owner, dim = cell // DIMENSIONS, cell % DIMENSIONS
    value = np.sqrt(count)
    norm = np.sqrt(np.bincount(owner, weights=value**2, minlength=len(texts)))
    return owner, dim, value / norm[owner]


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Accuracies by expectation-maximisation: P(junk vote | junk), P(junk vote | clean), P(junk).

    Starts from rules that are half sensitive and rarely wrong; abstentions carry no weight. Each rule is smoothed
    by one vote, so a rule that never speaks keeps its start.
    """
    junk, clean = (patterns == 1).astype(float), (patterns == 0).astype(float)
    hit, false, prior = np.full(patterns.shape[1], 0.5), np.full(patterns.shape[1], 0.05), 0.2
    for _ in range(ROUNDS):
        p = posterior(patterns, hit, false, prior)
        a, b = counts * p, counts * (1 - p)
        hit = (a @ junk + 0.5) / (a @ (junk + clean) + 1)
        false = (b @ junk + 0.05) / (b @ (junk + clean) + 1)
        prior = float(np.clip(a.sum() / max(counts.sum(), 1), 1e-6, 0.5))
    return hit, false, prior


def posterior(patterns: np.ndarray, hit: np.ndarray, false: np.ndarray, prior: float) -> np.ndarray:
    """P(junk) of every vote pattern."""
    junk, clean = patterns == 1, patterns == 0
    odds = np.log(prior / (1 - prior)) + junk @ np.log(hit / false) + clean @ np.log((1 - hit) / (1 - false))
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit(offsets: np.ndarray, dim: np.ndarray, value: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logistic weights (the last one is the constant) by full-batch adaptive steps.

    Row i has the dimensions and values from offsets[i] to offsets[i + 1]. A step walks over slices of the rows, so
    it needs little more memory than the sample itself.
    """
    sizes = np.diff(offsets)
    full = sizes > 0
    starts, sizes, target = offsets[:-1][full], sizes[full], target[full]
    cuts = np.unique(np.searchsorted(starts, np.arange(0, int(offsets[-1]) + 1, 1 << 20)))
    slices = [(i, j) for i, j in zip(cuts, [*cuts[1:], len(starts)]) if i < j]
    weights = np.zeros(DIMENSIONS + 1)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    n = max(len(target), 1)
    for step in range(1, 201):
        slope = 1e-6 * weights
        for i, j in slices:
            a, b = starts[i], starts[j - 1] + sizes[j - 1]
            d, v = dim[a:b], value[a:b]
            margin = np.add.reduceat(v * weights[d], starts[i:j] - a) + weights[-1]
            error = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - target[i:j]) / n
            slope[:-1] += np.bincount(d, weights=v * np.repeat(error, sizes[i:j]), minlength=DIMENSIONS)
            slope[-1] += error.sum()
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        weights -= 0.2 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column(1))
        for lo, hi in chunks(texts):
            code = (votes(texts[lo:hi]).astype(np.int64) + 1) @ (3 ** np.arange(len(RULES)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(code)], names=["id", "pattern"])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column(1))
        for lo, hi in chunks(texts):
            owner, dim, value = features(texts[lo:hi])
            offsets = pa.array(np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(dim.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32)))], names=["target", "dim", "value"]
            )


def _train(rows: pa.Table) -> pa.Table:
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in rows["dim"].chunks] or [np.zeros(0, dtype=np.int64)])
    dim, value = (np.concatenate([c.flatten().to_numpy() for c in rows[name].chunks] or [np.zeros(0)]) for name in ("dim", "value"))
    weights = fit(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), dim, value, rows["target"].to_numpy())
    return pa.table({"weights": pa.array([weights.tolist()], pa.list_(pa.float64()))})


def drawn(rows: DataFrame, share: float) -> DataFrame:
    """About ``share`` of the rows with a text, each drawn by its text and its place in the files.

    Null ids, repeated ids and repeated texts are drawn row by row like any other; the same files give the same draw.
    """
    full = rows.where(F.octet_length("text") > 0).withColumn("row", F.monotonically_increasing_id())
    return full.where(F.pmod(F.xxhash64("text", "row"), F.lit(1 << 30)) < int(share * (1 << 30))).drop("row")


def _scorer(docs: DataFrame, id_col: str, text_col: str, train_rows: int) -> Callable[[pa.Array], Iterator[tuple[int, int, np.ndarray, np.ndarray]]]:
    """Train on ``docs``; the result takes texts and gives (from, to, p_junk, score) of one chunk after the other."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    voted = cut_lineage(rows.mapInArrow(_vote, "id long, pattern long"), "votes")
    table = voted.groupBy("pattern").count().toPandas()  # at most 3^rules rows
    codes, counts = table["pattern"].to_numpy(dtype=np.int64), table["count"].to_numpy(dtype=float)
    patterns = (codes[:, None] // 3 ** np.arange(len(RULES))) % 3 - 1
    believed = dict(zip(codes.tolist(), posterior(patterns, *estimate(patterns, counts)).tolist()))
    total = int(counts.sum())
    share = min(1.0, train_rows / max(total, 1))
    junk = np.zeros(3 ** len(RULES))
    junk[list(believed)] = list(believed.values())

    def target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in chunks(texts):
                code = (votes(texts[lo:hi]).astype(np.int64) + 1) @ (3 ** np.arange(len(RULES)))
                part = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(1 - junk[code])], names=["id", "text", "target"])
                yield from _featurise([part])

    taught = drawn(rows, share).mapInArrow(target, "target double, dim array<int>, value array<float>").limit(train_rows)
    learned = taught.groupBy(F.lit("all").alias("all")).applyInArrow(_train, "weights array<double>").first()
    weights = np.array(learned["weights"]) if learned else np.zeros(DIMENSIONS + 1)

    def score(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        texts = as_bytes(column)
        for lo, hi in chunks(texts):
            part = texts[lo:hi]
            code = (votes(part).astype(np.int64) + 1) @ (3 ** np.arange(len(RULES)))
            owner, dim, value = features(part)
            margin = np.bincount(owner, weights=value * weights[dim], minlength=hi - lo) + weights[-1]
            yield lo, hi, junk[code], np.where(np.bincount(owner, minlength=hi - lo) > 0, 1 / (1 + np.exp(-np.clip(margin, -40, 40))), 0.5)

    return score


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id, p_junk (posterior of the rules), score (probability of good text) and kept (score >= 0.5).

    The scorer is fitted on at most ``train_rows`` documents, drawn row by row; accuracies are estimated on all documents. Texts that are null, empty or without words get no votes and
    score 0.5, so they are kept. Repeated rows give a row each, null ids too; other columns are ignored; an empty
    table gives no rows.
    """
    score = _scorer(docs, id_col, text_col, train_rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, bad, p in score(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(bad), pa.array(p)], names=["id", "p_junk", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scored, "id long, p_junk double, score double").withColumn("kept", F.col("score") >= 0.5)


def without_junk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that ``quality_scores`` keeps, all columns as they are.

    Every row is judged by its own text where it stands, so null ids and repeated ids need no join. Texts that are null,
    empty or without words stay; columns may have any names; an empty table gives an empty one.
    """
    score = _scorer(docs, id_col, text_col, train_rows)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [p >= 0.5 for _, _, _, p in score(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["row"]).filter(pa.array(np.concatenate([np.zeros(0, dtype=bool), *kept])))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(good, rows.select("row").schema).select("row.*")
