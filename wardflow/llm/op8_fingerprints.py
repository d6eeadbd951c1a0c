"""Winnowing fingerprints in DataFrame functions alone.

A text is read as a list of tokens: runs of up to 16 characters without white space, and the single
characters of longer runs, so that passages without blanks match wherever they begin. Every ``K``
tokens in a row are hashed by a cyclic (rolling) polynomial: the sum of the tokens' hashes, each
rotated by its distance from the end. Of every ``W`` neighbouring hashes the smallest is kept, of
equal ones the rightmost, together with its place. Two texts that share ``W + K - 1`` tokens in a
row therefore share a fingerprint, and nothing shorter than ``K`` tokens is ever matched.

A kept hash is one long: 31 bits of hash, then 32 bits of inverted place. The least of such longs
is the smallest hash at the rightmost place.

Defined results: NULL text counts as empty; an empty text has an empty fingerprint, one with fewer
than ``K`` tokens the hash of them all; two empty fingerprints are alike (1.0), an empty one and
another are not (0.0). Repeated rows stay, each next to the other (rows of equal doc_id are ordered
by their texts' hashes); NULL doc_id comes last. A table of one row has itself as its next document.
An empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.llm.tables import BLOCK_ROWS

K = 3
W = 6
_INK = r"[^\x20\x09-\x0D]"
_TOKEN = rf"(?<!{_INK}){_INK}{{1,16}}+(?!{_INK})|{_INK}"
_PLACES = (1 << 32) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _rotated(value: Column, bits: int) -> Column:
    if not bits:
        return value
    return F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits))


def _packed(hashed: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hashed, 33), 32) + (F.lit(_PLACES) - place)


def _grams(tokens: Column) -> Column:
    """The packed hash of every K tokens in a row."""

    def gram(i: Column) -> Column:
        hashed = _rotated(F.get(tokens, i), K - 1)
        for j in range(1, K):
            hashed = hashed.bitwiseXOR(_rotated(F.get(tokens, i + j), K - 1 - j))
        return _packed(hashed, i)

    short = F.array(_packed(F.xxhash64(tokens), F.lit(0)))
    return F.when(F.size(tokens) >= K, F.transform(F.sequence(F.lit(0), F.size(tokens) - K), gram)).otherwise(short)


def _minima(grams: Column) -> Column:
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(grams) - W + 1, F.lit(1))), lambda i: F.array_min(F.slice(grams, i, W))
    )
    return F.array_distinct(windows)


def winnow(text: Column) -> Column:
    """Fingerprint of a text: packed minima in the order of their places."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))
    tokens = F.transform(words, lambda word: F.xxhash64(word))
    kept = _let(tokens, lambda t: F.when(F.size(t) > 0, _let(_grams(t), _minima)))
    return F.coalesce(kept, F.array().cast("array<bigint>"))


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32)))


def likeness(one: Column, other: Column) -> Column:
    """Share of hashes that two sets of hashes have in common."""
    common = F.size(F.array_intersect(one, other))
    every = F.size(one) + F.size(other)
    return _let(common, lambda n: F.when(every == 0, F.lit(1.0)).otherwise(n / (every - n)))


def as_string(fingerprint: Column) -> Column:
    """``hash@place`` of every minimum, hashes in hexadecimal."""
    place = lambda x: F.lit(_PLACES) - x.bitwiseAND(F.lit(_PLACES))
    return F.array_join(
        F.transform(fingerprint, lambda x: F.concat(F.hex(F.shiftright(x, 32)), F.lit("@"), place(x).cast("string"))), " "
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (array of packed minima) of every row of ``docs``."""
    return docs.select("doc_id", winnow(F.col("text").cast("string")).alias("fingerprint"))


def _blocks(rows: DataFrame) -> Column:
    """Number of a row's block: blocks are ranges of doc_id with about equally many rows."""
    spark = rows.sparkSession
    n = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // BLOCK_ROWS)
    shares = [i / n for i in range(1, n)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, 10 * n).alias("b")).head()["b"]
    if not bounds:
        return F.lit(0)
    # Two steps, so that a row is compared with about 2 * sqrt(n) bounds.
    step = max(1, int(len(bounds) ** 0.5))
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.array(*[F.lit(part[0]).cast("long") for part in fine])
    fine_array = F.array(*[F.array(*[F.lit(x).cast("long") for x in part]) for part in fine])
    reached = lambda values: F.size(F.filter(values, lambda x: x <= F.col("doc_id")))
    inside = _let(reached(coarse), lambda c: F.when(c > 0, (c - 1) * step + reached(F.get(fine_array, c - 1))))
    return F.coalesce(inside, F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row with its fingerprint (_print), and the text (next_text) and fingerprint (_next_print) of
    the next document by falling doc_id; after the last, the first.

    Texts are shuffled once, by block. The first row of every block is also sent to the block before
    it, so that the last row there finds its next document.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    keyed = rows.select("doc_id", "text", _blocks(rows).alias("_block"), F.xxhash64("text").alias("_hash"))
    top = F.max(F.struct("doc_id", "_hash")).alias("_top")
    # One row per block; blocks are bounded by the number of rows over BLOCK_ROWS.
    heads = keyed.groupBy("_block").agg(top).select("_block", "_top.*")
    onward = F.coalesce(F.lead("_block").over(Window.orderBy("_block")), F.min("_block").over(Window.partitionBy()))
    heads = heads.select("_block", "doc_id", "_hash", onward.alias("_to"))
    same_row = F.col("k.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("k._hash") == F.col("h._hash"))
    copies = keyed.alias("k").join(F.broadcast(heads).alias("h"), (F.col("k._block") == F.col("h._block")) & same_row)
    copies = copies.select("k.doc_id", "k.text", F.col("h._to").alias("_block"), "k._hash", F.lit(1).alias("_copy"))
    both = keyed.withColumn("_copy", F.lit(0)).unionByName(copies).withColumn("_print", winnow(F.col("text")))
    order = Window.partitionBy("_block").orderBy("_copy", F.desc_nulls_last("doc_id"), F.desc("_hash"))
    return (
        both.withColumn("next_text", F.lead("text").over(order))
        .withColumn("_next_print", F.lead("_print").over(order))
        .where("_copy = 0")
        .drop("_block", "_hash", "_copy")
    )


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are."""
    size = F.char_length("text")
    cut = F.expr("char_length(text) div 3").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (size - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    edited_rows = with_next(docs).withColumn("_edited", edited)
    printed = edited_rows.withColumn("_edited_print", winnow(F.col("_edited")))
    sets = {f"{name}_set": hashes(F.col(name)) for name in ("_print", "_edited_print", "_next_print")}
    return printed.withColumns(sets).select(
        "doc_id",
        size.cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("_print")).alias("fingerprint"),
        as_string(F.col("_edited_print")).alias("edited_fingerprint"),
        likeness(F.col("_print_set"), F.col("_edited_print_set")).alias("near_edited"),
        likeness(F.col("_print_set"), F.col("_next_print_set")).alias("near_next"),
    )
