"""Benchmark decontamination by template windows.

Texts become sequences of template tokens: words without their case, with numbers, units after a number
and names replaced by placeholders of their type. Windows of eight template tokens are hashed, and
documents' windows are joined with those of the benchmark. A question asked again with other numbers or
names has the same template.

A text has two forms. In one, a run of capitalised words is one name, and so is a single one unless it
begins a sentence, where any word is capitalised. In the other, case is not looked at and names stay words,
so that copies in upper or lower case are found. Where both are the same, only one goes on.

Then the slots are compared: aligned window by window, each value that an item has in its slots must
stand for one value in the document, all along. A document holds an item if it has at least half of the
item's windows and its slots are consistent.

Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.llm.common import BROADCAST_ROWS, settled, written

WINDOW = 8
#: Shorter items say too little to be found again.
LEAST = 4
COVERAGE = 0.5
#: Names of units, as they follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml l gal s sec min h hr hrs ms hz khz mhz ghz w kw mw kwh "
    "v a j kj cal kcal n pa kpa bar k c f usd eur gbp percent meter meters metre metres kilometer "
    "kilometers gram grams kilogram kilograms liter liters litre litres second seconds minute minutes "
    "hour hours day days week weeks month months year years mile miles inch inches foot feet pound pounds "
    "ounce ounces dollar dollars euro euros cent cents degree degrees"
).split()
NUMBER = r"\p{N}++(?:[.,]\p{N}++)*+"
#: Capitalised words; several stand together with blanks, hyphens, apostrophes or initials between them.
NAME = r"(?:\p{Lu}['\u2019])?\p{Lu}++\p{Ll}\p{L}*+"
JOINT = r"(?:[ \t]++(?:\p{Lu}\.[ \t]*+)*+|[-'\u2019])"
RUN = rf"(?:\p{{Lu}}\.[ \t]*+)*+{NAME}(?:{JOINT}{NAME})++|(?:\p{{Lu}}\.[ \t]*+)++{NAME}"
#: What may stand between a word and a name in one sentence.
WITHIN = r"(?<=[\p{L}\p{N}#&}][^\p{L}\p{N}.!?\n{]{1,8})"


def marked(text: Column, named: bool, values: bool) -> Column:
    """Template tokens of a text in one of its forms; with ``values``, placeholders have them in braces."""

    def mark(kind: str, group: int) -> str:
        return f"{kind}{{${group}}}" if values else kind

    text = F.regexp_replace(F.coalesce(text, F.lit("")), "[#@&{}]", " ")
    if not named:
        text = F.lower(F.upper(text))
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    unit = rf"({NUMBER})([^\p{{L}}\p{{N}}]*+)((?iu:{units}))(?!\p{{L}})"
    text = F.regexp_replace(text, unit, f"{mark('#', 1)}$2{mark('&', 3)} ")
    text = F.regexp_replace(text, rf"(?<!\{{|\p{{N}}|\p{{N}}[.,])({NUMBER})", mark("#", 1))
    if named:
        name = rf"(?=\p{{Lu}})(?<![\p{{L}}{{])({RUN}|{WITHIN}{NAME})"
        text = F.lower(F.upper(F.regexp_replace(text, name, mark("@", 1))))
    return F.regexp_extract_all(text, F.lit(r"[#@&]\{[^}]*+\}|\p{L}++|[#@&]"), F.lit(0))


def forms(df: DataFrame) -> DataFrame:
    """``df`` with columns form, template: 0 without regard to case, and 1 with names, if that is another."""
    named = df.withColumn("named", marked(F.col("text"), True, False))
    plain = F.when(F.array_contains("named", "@"), marked(F.col("text"), False, False)).otherwise(F.col("named"))
    both = F.array_distinct(F.array(plain, F.col("named")))
    return named.select(*df.columns, F.posexplode(both).alias("form", "template"))


def valued(text: Column, form: Column) -> Column:
    """Tokens of one of the forms, placeholders with their values."""
    return F.when(form == 0, marked(text, False, True)).otherwise(marked(text, True, True))


def windows(df: DataFrame, length: int, *keep: str) -> DataFrame:
    """(keep..., hash, at): every window of ``length`` template tokens of column ``template``."""
    last = F.size("template") - length
    some = F.when(last >= 0, F.sequence(F.lit(0), last))
    hashes = F.transform(some, lambda i: F.xxhash64(F.slice(F.col("template"), i + 1, F.lit(length))))
    return df.select(*keep, F.posexplode(hashes).alias("at", "hash"))


def consistent(slots: Column) -> Column:
    """Whether each value of the item stands for one value."""
    ours = F.array_distinct(F.transform(slots, lambda s: F.struct(s["kind"], s["our"])))
    return F.size(ours) == F.size(slots)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and an item it holds: doc_id, item_id, coverage, changed_slots.

    ``changed_slots`` counts the item's slot values that the document replaced by others, consistently;
    0 means a copy apart from case and punctuation. Null texts hold nothing, and items of fewer than
    ``LEAST`` tokens are not looked for; items of fewer than eight are one window. Rows that repeat an id
    count as one document (or item) if one of them matches. Empty tables give an empty result.
    """
    best = leaking_rows(docs, benchmark, coverage).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return best.select(
        "doc_id", "item_id", F.col("best.coverage").alias("coverage"), (-F.col("best.back")).alias("changed_slots")
    )


def leaking_rows(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The same pairs with the hash of the document's text: doc_id, text_hash, item_id, best."""
    items = forms(benchmark.filter("item_id IS NOT NULL").select("item_id", "text"))
    items = items.withColumn("ours", valued(F.col("text"), F.col("form")))
    items = items.filter((F.size("template") >= LEAST) & (F.size(marked(F.col("text"), False, False)) >= LEAST))
    items = items.withColumn("of", F.xxhash64("ours", "form")).drop("text", "form")
    items = written(items, "items")
    lengths = sorted(
        r[0] for r in items.select(F.least(F.size("template"), F.lit(WINDOW))).distinct().collect()
    )
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = forms(texts).drop("text")
    pieces = []
    for length in lengths:  # at most WINDOW of them
        fits = F.size("template") >= WINDOW if length == WINDOW else F.size("template") == length
        wanted = windows(items.filter(fits), length, "item_id", "of")
        wanted = wanted.withColumnRenamed("at", "item_at")
        wanted = written(wanted, "item-windows")
        n = wanted.count()
        side = F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted
        rows = texts.withColumn("row", F.struct("doc_id", "text_hash", "form"))
        pieces.append(windows(rows, length, "row").join(side, "hash").withColumn("length", F.lit(length)))
    if not pieces:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, text_hash long, item_id long, best struct<coverage: double, back: long>"
        )
    met = pieces[0]
    for piece in pieces[1:]:
        met = met.unionByName(piece)
    met = written(met.select("row", "item_id", "of", "item_at", "at", "length"), "met")
    total = items.select(
        "item_id", "of", F.greatest(F.size("template") - WINDOW + 1, F.lit(1)).alias("total")
    ).distinct()
    cover = met.groupBy("row", "item_id", "of").agg(F.countDistinct("item_at").alias("n"))
    cover = cover.join(total, ["item_id", "of"]).withColumn("coverage", F.col("n") / F.col("total"))
    cover = written(cover.filter(F.col("coverage") >= coverage).drop("n", "total"), "covered")
    # Slots: the values at the placeholders of each matched window, side by side, for every alignment.
    pairs = met.join(cover, ["row", "item_id", "of"], "left_semi")
    shift = pairs.groupBy("row", "item_id", "of", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.max("length").alias("length"), F.collect_set("item_at").alias("starts")
    )
    mine = items.select("item_id", "of", "ours", "template").distinct()
    places = F.filter(
        F.sequence(F.lit(0), F.size("template") - 1),
        lambda i: F.get(F.col("template"), i).isin("#", "@", "&")
        & F.exists("starts", lambda s: (i >= s) & (i < s + F.col("length"))),
    )
    asked = F.transform(
        places,
        lambda i: F.struct(
            F.get(F.col("template"), i).alias("kind"),
            F.get(F.col("ours"), i).alias("our"),
            (i + F.col("shift")).alias("at"),
        ),
    )
    shift = shift.join(mine, ["item_id", "of"]).select("row", "item_id", "of", "shift", "starts", asked.alias("asked"))
    shift = shift.groupBy("row").agg(F.collect_list(F.struct("item_id", "of", "shift", "starts", "asked")).alias("all"))
    values = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").distinct()
    values = values.select("text", F.explode(F.array(F.lit(0), F.lit(1))).alias("form"), "doc_id", "text_hash")
    values = values.select(F.struct("doc_id", "text_hash", "form").alias("row"), "text")
    values = shift.join(values.hint("merge"), "row")
    values = values.select("row", "all", valued(F.col("text"), F.col("row.form")).alias("theirs"))
    filled = F.transform(
        "all",
        lambda one: F.struct(
            one["item_id"].alias("item_id"),
            one["of"].alias("of"),
            one["shift"].alias("shift"),
            one["starts"].alias("starts"),
            F.array_distinct(
                F.transform(
                    one["asked"],
                    lambda s: F.struct(
                        s["kind"].alias("kind"), s["our"].alias("our"), F.get(F.col("theirs"), s["at"]).alias("their")
                    ),
                )
            ).alias("slots"),
        ),
    )
    judged = values.select("row", F.explode(filled).alias("one")).select("row", "one.*")
    judged = written(judged.filter(consistent(F.col("slots"))), "alignments")
    return passing(judged, total, coverage)


def passing(judged: DataFrame, total: DataFrame, coverage: float) -> DataFrame:
    """Pairs that hold with one alignment and those that agree with it.

    A word put in or left out moves the rest of a copy to another alignment. Each alignment is taken together
    with the others up to the item's length away, and the one with most windows with all others, where the
    slots of both are consistent.
    """
    one = judged.join(total, ["item_id", "of"])
    whole = F.lit(-(1 << 62))
    bucket = F.floor(F.col("shift") / (F.col("total") + WINDOW))
    rank = F.struct(F.size("starts").alias("n"), (-F.col("shift")).alias("back"))
    most = one.groupBy("row", "item_id", "of").agg(F.max(rank)["back"].alias("back"))
    one = one.join(most, ["row", "item_id", "of"])
    first = F.when(F.col("shift") == -F.col("back"), F.array(bucket, whole)).otherwise(F.array(bucket))
    leader = one.select(
        "row", "item_id", "of", "total", "shift", F.col("slots").alias("known"), F.explode(first).alias("key")
    )
    others = one.select(
        "row", "item_id", "of", "starts", "slots",
        F.explode(F.array(bucket - 1, bucket, bucket + 1, whole)).alias("key"),
    )
    both = leader.join(others, ["row", "item_id", "of", "key"])
    both = both.filter(consistent(F.array_distinct(F.concat("known", "slots"))))
    both = both.groupBy("row", "item_id", "of", "shift", "total").agg(
        F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"),
        F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"),
    )
    changed = F.size(F.array_distinct(F.filter("slots", lambda s: s["our"] != s["their"]))).cast("long")
    both = both.select("row", "item_id", (F.size("starts") / F.col("total")).alias("coverage"), changed.alias("n"))
    return both.filter(F.col("coverage") >= coverage).groupBy("row.doc_id", "row.text_hash", "item_id").agg(
        F.max(F.struct("coverage", (-F.col("n")).alias("back"))).alias("best")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pipeline stage: ``docs`` without the documents that hold an item of the benchmark.

    Documents are told apart by id and text, so another text under the same id stays; rows that repeat
    both stay or go together. Null texts and missing ids are documents as any other. An empty table, or
    an empty benchmark, takes nothing away.
    """
    def leaking() -> DataFrame:
        rows = leaking_rows(docs, benchmark)
        return rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()

    found = settled(leaking, "leaks")
    packed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.struct(*docs.columns).alias("row"))
    held = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return packed.join(found.hint("merge"), held, "left_anti").select("row.*")
