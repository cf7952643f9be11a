"""Document fingerprints by order MinHash: signatures that follow the edit distance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsweave.llm.common import partitions, text_of

#: Words of a k-mer. A tuple has two k-mers, a fingerprint 64 tuples.
K = 2
#: Lower bits of a packed number that hold a position, upper ones that tell the bin of a k-mer.
POSITION_BITS, BIN_SHIFT = 24, 58
_LAST = (1 << POSITION_BITS) - 1
_LEAST_BIN = -(1 << 63 - BIN_SHIFT)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x09-\x0D\x20]+"), lambda w: w != "")


def pack(value: Column, position: Column) -> Column:
    """The upper 40 bits of `value` and a position (places beyond 16 million count as one)."""
    return value.bitwiseAND(F.lit(~_LAST)).bitwiseOR(F.least(position.cast("long"), F.lit(_LAST)))


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(_LAST))


def _value(packed: Column) -> Column:
    return F.shiftright(packed, POSITION_BITS)


def _bin(packed: Column) -> Column:
    return F.shiftright(packed, BIN_SHIFT)


def kmers(words: Column, k: int) -> Column:
    """Every run of k words as a packed hash and position, sorted; fewer words are one run."""
    last = F.greatest(F.size(words) - k, F.lit(0))
    return F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: pack(
        F.xxhash64(*[F.get(words, i + j) for j in range(k)]), i)))


def numbered(runs: Column) -> Column:
    """Of sorted packed k-mers, the packed hashes of (k-mer, its how-manieth occurrence), sorted.

    Occurrences of one k-mer follow each other in text order, so the number of one is its distance from the
    first of its run.
    """
    n = F.size(runs)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
        _value(F.get(runs, i)) != _value(F.get(runs, i - 1))))

    def expanded(begin: Column) -> Column:
        ends = F.concat(F.slice(begin, F.lit(2), F.size(begin)), F.array(n))
        return F.flatten(F.zip_with(begin, ends, lambda a, b: F.transform(F.sequence(a, b - 1), lambda i: pack(
            F.xxhash64(_value(F.get(runs, i)), i - a), _place(F.get(runs, i))))))

    return F.sort_array(let(starts, expanded))


def tuples(chosen: Column) -> Column:
    """Per bin one number: the bin, and a hash of two k-mers in the order they stand in the text: the two that come first
    from the bin's border on, around the circle of hashes. So only a text of one k-mer has tuples without an order."""
    n = F.size(chosen)
    firsts = F.filter(F.sequence(F.lit(0), F.size(chosen) - 1), lambda i: (i == 0) | (
        _bin(F.get(chosen, i)) != _bin(F.get(chosen, i - 1))))

    def pair(i: Column) -> Column:
        a, b = F.get(chosen, i), F.get(chosen, F.pmod(i + 1, n))
        hashed = (F.when(n == 1, F.xxhash64(_value(a)))
                  .when(_place(a) <= _place(b), F.xxhash64(_value(a), _value(b)))
                  .otherwise(F.xxhash64(_value(b), _value(a))))
        return hashed.bitwiseAND(F.lit((1 << BIN_SHIFT) - 1))

    def bins(first: Column, last: Column, hashed: Column) -> Column:
        return F.transform(F.sequence(first, last), lambda b: F.shiftleft(b, BIN_SHIFT).bitwiseOR(hashed))

    def of_bins(i: Column) -> Column:
        """The tuples of the bin that starts at i and of the empty ones before it."""
        before = F.when(i == 0, F.lit(_LEAST_BIN - 1)).otherwise(_bin(F.get(chosen, i - 1)))
        return let(pair(i), lambda hashed: bins(before + 1, _bin(F.get(chosen, i)), hashed))

    last = _bin(F.get(chosen, n - 1))
    rest = F.when(last < -_LEAST_BIN - 1, let(pair(F.lit(0)), lambda hashed: bins(last + 1, F.lit(-_LEAST_BIN - 1).cast("long"), hashed)))
    return F.concat(F.flatten(F.transform(firsts, of_bins)), F.coalesce(rest, F.array().cast("array<long>")))


def signature(text: Column, k: int = K) -> Column:
    """The fingerprint of a text, an array of 64 longs; of a text without words an empty one.

    One hash deals the occurrence-numbered k-mers to 64 bins, and the two least of every bin
    make a tuple, kept in text order; a bin that has fewer takes the least of the next ones. Two texts share a tuple if they
    share its k-mers, with their counts, in the same order.
    """
    def of_words(words: Column) -> Column:
        least = let(kmers(words, k), lambda runs: let(numbered(runs), lambda s: F.filter(
            s, lambda x, i: (i < 2) | (_bin(x) != _bin(F.get(s, i - 2))))))
        return F.when(F.size(words) > 0, let(least, tuples)).otherwise(F.array().cast("array<long>"))

    return let(words_of(text), of_words)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that either fingerprint fills; 1 for two empty ones."""
    bins = F.size(F.array_union(F.transform(a, _bin), F.transform(b, _bin)))
    return F.when(bins > 0, F.size(F.array_intersect(a, b)) / bins).otherwise(F.lit(1.0))


def as_string(signature_: Column) -> Column:
    """16 hexadecimal digits per tuple."""
    return F.array_join(F.transform(signature_, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def with_next(rows: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """Adds to each row, as next_..., columns of the row that follows by falling key; the first follows the last.

    Rows are dealt to ranges of keys whose borders are keys of the table. A row at a border
    comes first in its range and is put, once more, behind the rows of the range before it:
    so no range needs another, and none is larger than its share of the rows.
    """
    ranges = 4 * partitions(rows.sparkSession)  # several to a partition even out
    cuts = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 20 * ranges)).alias("c"),
                    F.max(key).alias("m")).first()
    borders = sorted({*(cuts["c"] or []), *([cuts["m"]] if cuts["m"] is not None else [])}, reverse=True)
    kind = rows.schema[key].dataType.simpleString()
    listed = F.array(*[F.lit(b) for b in borders]).cast(f"array<{kind}>")
    own = F.when(F.col(key).isNull(), len(borders) - 1).otherwise(F.size(F.filter(listed, lambda b: b >= F.col(key))) - 1)
    before = F.pmod(own - 1, F.lit(max(1, len(borders))))
    lots = F.when(F.array_contains(listed, F.col(key)), F.array(F.struct(own.alias("range"), F.lit(False).alias("guest")),
                                                                F.struct(before.alias("range"), F.lit(True).alias("guest"))))
    alone = F.array(F.struct(own.alias("range"), F.lit(False).alias("guest")))
    dealt = rows.withColumn("_lot", F.explode(F.coalesce(lots, alone)))
    order = Window.partitionBy("_lot.range").orderBy(F.col("_lot.guest"), F.desc_nulls_last(key), *carried)
    return (dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
            .where(~F.col("_lot.guest")).drop("_lot"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of the same text after an edit: key, n_chars, edited_text,
    fingerprint, edited_fingerprint (arrays), near_edited, near_next.

    The edit replaces the last half of the code points by the first as many (or all) of the
    text that follows by falling key, for the last the first. `near_...` is the likeness
    of the text's fingerprint to the edited text's, and to the following text's. Null texts
    are empty. Rows that repeat a key follow each other in the order of their texts; rows with a null
    key come last (where no row has a key, an empty text follows the last). Other
    columns are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("content")).withColumn("print", signature(F.col("content"), k))
    following = with_next(rows, "id", ["content", "print"])
    n = F.length("content")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("content", n - half), F.left(F.coalesce("next_content", F.lit("")), half))
    empty = F.array().cast("array<long>")
    found = (following.withColumn("edited_text", edited)
             .withColumn("edited_print", signature(F.col("edited_text"), k)))
    return found.select(F.col("id").alias(key), n.cast("long").alias("n_chars"), "edited_text",
                        F.col("print").alias("fingerprint"), F.col("edited_print").alias("edited_fingerprint"),
                        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
                        likeness(F.col("print"), F.coalesce("next_print", empty)).alias("near_next"))
