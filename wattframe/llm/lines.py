"""Line deduplication by a deletion-neighbourhood join.

Two lines are near if one insertion, deletion or substitution of a character turns one into the other.
Every line then shares a variant with each near line: both without the same character (substitution),
or one whole and the other without one character. So each line emits the hashes of its variants, equal
variants meet, and the earliest line of each variant is the witness against the others; the edit
distance to the witness is then verified. Lines of one variant are never paired with each other, so
many near lines of one another cost no more than their own variants.

A character-wise neighbourhood of all lines would be far larger than the text. Three coarse rounds go
before: lines emit themselves without their first or second half, then without one eighth, then without
one part in 32; lines that share none of these with another line have no near line, and go no further. Hashes that stand for
a line without its i-th character come from running XORs over its characters, so a line of n characters
costs n steps, however long.

Everything is built from DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.common import free_name, join_written_groups, settled, written

#: Shorter lines have no near ones: one edit would turn most short words into others.
MIN_CHARS = 10
#: Shorter lines are not compared at all, so that empty ones, which part paragraphs, stay.
EXACT_CHARS = 1
COARSE, FINE = 2, (8, 32)


def order() -> Column:
    """Where a line stands; the smallest is the earliest."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "line_no")


def gap_keys(line: Column, size: Column, parts: int) -> Column:
    """Hashes of the line without each of its parts, as it meets lines of its own length and one more.

    A line of n + 1 characters is also cut as if it had n, with the gap a character wider.
    """
    def keys(wider: int) -> Column:
        n = size - wider

        def without(j: Column) -> Column:
            low = F.floor(n * j / parts).cast("int")
            high = (F.floor(n * (j + 1) / parts) + wider).cast("int")
            return F.xxhash64(n, j, F.substring(line, F.lit(1), low), F.substring(line, high + 1, size))

        # One expression over a list of places, not one per place: plans stay small for the driver.
        return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), without)

    return F.concat(keys(0), keys(1))


def sharing(lines: DataFrame, keys: Column) -> DataFrame:
    """Ids (h1, h2) of the lines that share a key with another line."""
    keyed = lines.select("h1", "h2", F.explode(F.array_distinct(keys)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(shared, "keys")
    met = join_written_groups(keyed, shared, ["key"], "n", lines)
    return written(met.select("h1", "h2").distinct(), "lines")


def by_document(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Null-safe join on doc_id and text_hash. Neither side has a proven bound, so both are shuffled."""
    names = {c: f"__{c}" for c in ("doc_id", "text_hash")}
    other = other.withColumnsRenamed(names).hint("merge")
    match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()))
    return df.join(other, match, how).drop(*names.values())


def with_hash(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )


def split_lines(docs: DataFrame) -> DataFrame:
    found = docs.select(
        "doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    )
    return found.withColumns(
        {
            "h1": F.xxhash64("line"),
            "h2": F.xxhash64(F.lit(1), "line"),
            "size": F.char_length("line"),
        }
    )


def variants(lines: DataFrame) -> DataFrame:
    """Hashes of the lines' variants: (h1, h2, first, role, key).

    ``whole``: the line itself. ``gone``: the line without one character. ``swap``: the same, with the
    character's place. Whole and gone have comparable keys. XOR over hashes of (character, place)
    gives the key; what follows the gap counts one place less.
    """
    chars = lines.select("h1", "h2", "first", F.posexplode(F.split("line", "")).alias("at", "char"))
    chars = chars.filter("char != ''").withColumns(
        {"here": F.xxhash64("char", "at"), "less": F.xxhash64("char", F.col("at") - 1)}
    )
    line = Window.partitionBy("h1", "h2").orderBy("at")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("h1", "h2")
    after = F.bit_xor("less").over(total).bitwiseXOR(F.bit_xor("less").over(upto))
    without = F.coalesce(F.bit_xor("here").over(before), F.lit(0)).bitwiseXOR(after)
    gone = chars.withColumn("without", without)
    gone = gone.select(
        "h1",
        "h2",
        "first",
        F.explode(
            F.array(
                F.struct(F.lit("gone").alias("role"), F.col("without").alias("key")),
                F.struct(
                    F.lit("swap").alias("role"),
                    F.xxhash64("without", "at", F.lit("swap")).alias("key"),
                ),
            )
        ).alias("v"),
    ).select("h1", "h2", "first", "v.role", "v.key")
    whole = (
        chars.groupBy("h1", "h2")
        .agg(F.any_value("first").alias("first"), F.bit_xor("here").alias("key"))
        .select("h1", "h2", "first", F.lit("whole").alias("role"), "key")
    )
    return whole.unionByName(gone)


def near_lines(lines: DataFrame) -> DataFrame:
    """Distinct lines that have an earlier near line: h1, h2, and ``witness``, the earlier one's ids.

    ``lines``: h1, h2, first (the place of its first copy), line.
    """
    emitted = variants(lines).withColumn("own", F.struct("first", "h1", "h2"))
    groups = emitted.groupBy("key").agg(
        F.min(F.when(F.col("role") == "whole", F.col("own"))).alias("whole"),
        F.min(F.when(F.col("role") == "gone", F.col("own"))).alias("gone"),
        F.min(F.when(F.col("role") == "swap", F.col("own"))).alias("swap"),
        F.max(F.when(F.col("role") == "swap", F.col("own"))).alias("last"),
        F.count(F.lit(1)).alias("n"),
    )
    useful = (F.col("swap.first") < F.col("last.first")) | (
        F.col("whole").isNotNull() & F.col("gone").isNotNull()
    )
    groups = written(groups.filter(useful).drop("last"), "variants")
    met = join_written_groups(emitted, groups, ["key"], "n", lines)
    witness = (
        F.when(F.col("role") == "whole", F.col("gone"))
        .when(F.col("role") == "gone", F.col("whole"))
        .otherwise(F.col("swap"))
    )
    met = met.withColumn("witness", witness).filter(F.col("witness.first") < F.col("first"))
    pairs = met.select(
        "h1", "h2", F.col("witness.h1").alias("w1"), F.col("witness.h2").alias("w2")
    ).distinct()
    mine = pairs.join(lines.select("h1", "h2", "line"), ["h1", "h2"])
    theirs = lines.select(
        F.col("h1").alias("w1"),
        F.col("h2").alias("w2"),
        F.col("line").alias("other"),
        F.col("first").alias("place"),
    )
    both = mine.join(theirs, ["w1", "w2"])
    near = F.levenshtein("line", "other", 1).between(0, 1)
    return both.filter(near).groupBy("h1", "h2").agg(F.min("place").alias("witness"))


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """Lines to remove: doc_id, text_hash, line_no, witness (the earlier line's place), exact.

    Lines end at ``\\n``. Earlier means a smaller doc_id (null ids last), or further up in the same
    document. A line goes if an equal or near line stands earlier; this is judged on the input, not on
    what is left. Lines of fewer than ``min_chars`` characters go for equal ones only, and those of
    fewer than ``exact_chars`` stay. Rows that repeat both id and text count as one document.
    """
    docs = with_hash(docs)
    cut = split_lines(docs).filter(F.col("size") >= exact_chars)
    keys = F.when(F.col("size") >= min_chars, gap_keys(F.col("line"), F.col("size"), COARSE))
    lines = written(cut.withColumn("keys", keys).drop("line", "size"), "all-lines")
    distinct = lines.groupBy("h1", "h2").agg(
        F.min(order()).alias("first"),
        F.any_value("keys").alias("keys"),
        F.count(F.lit(1)).alias("n"),
    )
    distinct = written(distinct, "distinct-lines")
    some = sharing(distinct.filter("keys IS NOT NULL"), F.col("keys"))
    places = distinct.join(some, ["h1", "h2"]).select("h1", "h2", "first")
    place = places.select(
        F.col("first.doc_id").alias("doc_id"),
        F.col("first.text_hash").alias("text_hash"),
        F.col("first.line_no").alias("line_no"),
        "first",
    )
    place = place.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("line_no", "first")).alias("wanted")
    )
    texts = by_document(docs, place, "inner")
    texts = texts.select(F.split("text", "\n", -1).alias("cut"), F.explode("wanted").alias("w"))
    line = F.col("cut")[F.col("w.line_no")]
    texts = texts.select(line.alias("line"), F.col("w.first").alias("first")).distinct()
    texts = texts.withColumns(
        {"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line"), "size": F.char_length("line")}
    )
    texts = written(texts, "candidate-lines")
    for parts in FINE:
        some = sharing(texts, gap_keys(F.col("line"), F.col("size"), parts))
        texts = written(texts.join(some, ["h1", "h2"]), "candidate-lines")
    candidates = texts
    near = near_lines(candidates)
    again = distinct.filter("n > 1").select("h1", "h2", "first", "n")
    copies = join_written_groups(
        lines.select("doc_id", "text_hash", "line_no", "h1", "h2"), again, ["h1", "h2"], "n", lines
    ).filter(order() != F.col("first"))
    copies = copies.select(
        "doc_id", "text_hash", "line_no", F.col("first").alias("witness"), F.lit(True).alias("exact")
    )
    near = near.join(candidates.select("h1", "h2", "first"), ["h1", "h2"]).select(
        F.col("first.doc_id").alias("doc_id"),
        F.col("first.text_hash").alias("text_hash"),
        F.col("first.line_no").alias("line_no"),
        "witness",
        F.lit(False).alias("exact"),
    )
    return copies.unionByName(near)


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, into: str | None = None) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and a struct ``into``: n_lines, n_removed.

    Null and empty texts stay as they are, with 0 lines. All other columns are kept.
    """
    return without_lines(docs, gone_lines(docs, min_chars), into or free_name(docs, "lines"))


def gone_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash and ``gone``, the numbers of the lines to remove; other documents have no row."""
    gone = removed_lines(docs, min_chars)
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))


def without_lines(docs: DataFrame, gone: DataFrame, into: str) -> DataFrame:
    """``docs`` without the lines of ``gone_lines``, and what ``drop_lines`` adds."""
    packed = docs.select(
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.struct(*docs.columns).alias("row"),
    )
    joined = by_document(packed, gone, "left")
    cut = F.split("row.text", "\n", -1)
    kept = F.filter(cut, lambda line, i: ~F.array_contains("gone", i))
    n_removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    n_lines = F.when(F.coalesce(F.length("row.text"), F.lit(0)) > 0, F.size(cut)).otherwise(0)
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    columns = [
        text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns
    ]
    counts = F.struct(n_lines.cast("long").alias("n_lines"), n_removed.alias("n_removed"))
    return joined.select(*columns, counts.alias(into))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text without the removed lines."""
    out = drop_lines(docs.select("doc_id", "text"), into="lines")
    return out.select("doc_id", "lines.n_lines", "lines.n_removed", "text")


def unique_lines(docs: DataFrame) -> DataFrame:
    """Pipeline stage: ``docs`` without repeated lines; documents all of whose lines were repeats go.

    Documents that had no text before stay.
    """
    mark = free_name(docs, "lines")
    out = without_lines(docs, settled(lambda: gone_lines(docs), "gone-lines"), mark)
    left = (F.col(mark)["n_removed"] == 0) | (F.trim("text") != "")
    return out.filter(left).select(*docs.columns)
