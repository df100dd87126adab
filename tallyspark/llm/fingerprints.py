"""Fingerprints of texts by ordered minimal k-mers, so that their likeness follows edit distance. Column functions only.

A k-mer is K words in a row, numbered by its occurrence in the text: the second "a b c" differs from the first. A hash
places the numbered k-mers on a ring; a slot of the fingerprint starts at its own point of the ring, takes the
two k-mers that come first from there, puts them back into the order of the text and hashes that tuple. Two texts agree
in a slot when the same minimal k-mers stand in the same order. RINGS rings, whose orders differ, have SLOTS points each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
RINGS, SLOTS = 2, 32
SPACE, LONGEST = r" \t\n\r\f\x0B", 16
PLACE_BITS = 28
_PLACE = (1 << PLACE_BITS) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACE)).cast("int")


def _packed(h: Column, place: Column) -> Column:
    """The high bits of a hash with the place in the text below them."""
    return h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.cast("long"))


def _heads(ordered: Column, bits: int) -> Column:
    """Where the value above the low ``bits`` of sorted numbers changes."""
    behind = lambda i: ordered[F.greatest(i - 1, F.lit(0))]
    at = F.transform(ordered, lambda x, i: F.when((i == 0) | (F.shiftright(x.bitwiseXOR(behind(i)), bits) != 0), i).otherwise(-1))
    return F.array_remove(at, -1)


def _numbered(grams: Column) -> Column:
    """Per k-mer a hash of it and of how often it stood in the text before, packed with its place."""

    def of(ordered: Column) -> Column:
        one = lambda x, times: _packed(F.xxhash64(F.shiftright(x, PLACE_BITS), times), _place(x))
        after = lambda heads, j: F.coalesce(F.get(heads, j + 1), F.size(ordered))

        def run(head: Column, stop: Column) -> Column:
            many = F.transform(F.sequence(head, stop - 1), lambda i: one(ordered[i], i - head))
            return F.when(stop == head + 1, F.array(one(ordered[head], F.lit(0)))).otherwise(many)

        return _let(_heads(ordered, PLACE_BITS), lambda heads: F.flatten(F.transform(heads, lambda head, j: run(head, after(heads, j)))))

    return _let(F.sort_array(F.transform(grams, _packed)), of)


def _ring(units: Column, ring: int) -> Column:
    """The k-mers in the order of one ring."""
    again = F.transform(units, lambda x: _packed(F.xxhash64(F.shiftright(x, PLACE_BITS), F.lit(ring)), _place(x)))
    return F.sort_array(units if ring == 0 else again)


def _slots(ordered: Column, grams: Column) -> Column:
    """One ring's part of the fingerprint, from its k-mers in ring order."""
    n = F.size(ordered)
    width = 64 - SLOTS.bit_length() + 1
    cell = lambda i: (F.shiftright(ordered[i], width) + F.lit(SLOTS // 2)).cast("int")

    def spread(heads: Column) -> Column:
        """Every slot's first k-mer: that of its own cell, else of the next cell that has one, around the ring."""
        behind = lambda j: F.when(j == 0, F.lit(-1)).otherwise(cell(heads[F.greatest(j - 1, F.lit(0))]))
        ahead = F.flatten(F.transform(heads, lambda i, j: F.array_repeat(i, cell(i) - behind(j))))
        return F.concat(ahead, F.array_repeat(F.lit(0), F.lit(SLOTS - 1) - cell(heads[F.size(heads) - 1])))

    def tuple_of(i: Column) -> Column:
        a, b = _place(ordered[i]), _place(ordered[F.when(i + 1 < n, i + 1).otherwise(0)])
        return F.xxhash64(grams[F.least(a, b)], grams[F.greatest(a, b)]).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.transform(_let(_heads(ordered, width), spread), tuple_of)


def order_minhash(text: Column) -> Column:
    """The fingerprint: RINGS * SLOTS numbers of 32 bits, or none for a text without words.

    Words are runs without white space, cut every 16 characters; a text of fewer than K words is one k-mer. Null is an
    empty text. Time grows as n log n in the words; the words and places of one text are held at a time.
    """
    given = F.coalesce(text, F.lit(""))
    long = F.regexp_extract_all(given, F.lit(f"[^{SPACE}]{{1,{LONGEST}}}"), F.lit(0))
    whole = F.array_remove(F.split(given, f"[{SPACE}]+", -1), "")

    def of_words(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*[w[i + k] for k in range(K)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < K, F.array(F.xxhash64(w))).otherwise(grams)

    def of_grams(grams: Column) -> Column:
        rings = lambda units: F.concat(*[_let(_ring(units, r), lambda ordered: _slots(ordered, grams)) for r in range(RINGS)])
        return F.when(F.size(grams) == 0, F.array().cast("array<bigint>")).otherwise(_let(_numbered(grams), rings))

    words = _let(whole, lambda w: F.when(F.exists(w, lambda x: F.length(x) > LONGEST), long).otherwise(w))
    return _let(_let(words, of_words), of_grams)


def fingerprint_text(numbers: Column) -> Column:
    """Eight hex digits a slot; empty for a text without words."""
    return F.array_join(F.transform(numbers, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of slots that agree; 1 for two texts without words, 0 if only one has words."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(RINGS * SLOTS))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(same)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint (eight hex digits a slot) of every document; no row leaves its task.

    Null, empty and blank texts have an empty fingerprint. Equal texts have equal fingerprints; repeated rows and null
    ids give a row each; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    return docs.select(F.col(id_col).alias("id"), fingerprint_text(order_minhash(F.col(text_col))).alias("fingerprint"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, numbers (its fingerprint), next_text and next_numbers: each document beside the one after it.

    The order is ascending by id (null first), then by text; the last document is followed by the first, a single
    one by itself. Null texts are empty. The order is cut into as many ranges as there are shuffle partitions; only
    the ranges' first keys reach the driver, and each range also gets a copy of the first row of the range after it.
    Rows with one id fall into several ranges if their texts differ.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("h"))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), key.alias("key"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select("key").repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key"))
    heads = sorted({(r.key.known, r.key.id, r.key.h) for r in ranged.collect()})
    starts = F.array(*[F.struct(F.lit(k).alias("known"), F.lit(i).cast("long").alias("id"), F.lit(h).cast("long").alias("h")) for k, i, h in heads])
    dealt = rows.select("id", "text", "key", order_minhash(F.col("text")).alias("numbers"), F.size(F.filter(starts, lambda s: s <= F.col("key"))).alias("part"))
    first = dealt.where(F.array_contains(starts, F.col("key"))).dropDuplicates(["key"])
    behind = F.when(F.col("part") == 1, F.lit(max(len(heads), 1))).otherwise(F.col("part") - 1)
    both = dealt.withColumn("copy", F.lit(False)).unionByName(first.withColumn("part", behind).withColumn("copy", F.lit(True)))
    order = Window.partitionBy("part").orderBy("copy", "key", "text")
    after = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "numbers")]
    return both.select("id", "text", "numbers", "copy", *after).where("not copy").drop("copy")


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by as many of ``other``, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(other, F.lit(1), half))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, edited, and the fingerprint numbers of both and of the next document's text.

    A document's edited text ends in the beginning of the next one (``with_next``), which puts likeness to the test.
    """
    rows = with_next(docs, id_col, text_col).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return rows.select("id", "text", "edited", "numbers", order_minhash(F.col("edited")).alias("edited_numbers"), "next_numbers")
