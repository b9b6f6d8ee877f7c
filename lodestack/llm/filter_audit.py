"""Audit of filters that are applied one after the other: what each removes in every order, by SQL CUBE and joins of filter subsets.

Five filters judge a document. A: too few words. B: too many repeated words. C: too many capital letters. D: holds marks of markup. E: a copy of
a text with a smaller id, anywhere in the table. A CUBE over the five failure flags and the part counts documents; of its rows those whose chosen
flags are all false are the survivors of that subset of filters. A step of an order goes from one subset to the one with one filter more, so all
of its counts are differences of two subsets' survivors, which a join on (part, subset) brings together.

Texts are read once, map-side: flags and a digest of the text are all that is shuffled. Documents meet their labels by id, copies are counted
by (digest, part, flags, labels) before they meet by digest, and the CUBE runs over those counts: 128 rows a part at most.

Defined results: a null text is empty, and an empty text fails A only (0 of 0 words are repeated); a null part is the empty string, as is an empty
one; a null id has no label and is no copy of a smaller id, nor a smaller id for others; rows with the same id and text are not copies of each
other by E, each counts; several labels of an id count as one that is set if any is; a null label is not set; an empty table has no parts and
gives no rows. Columns other than those named are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_table

FILTERS = "ABCDE"
#: Fixed values of the filters: words at least, percent of distinct words at least, percent of capitals at most, marks.
WORDS, DISTINCT, CAPITALS, MARKS = 200, 50, 3, "[#$%&*|]"


def failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C, D."""
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(F.regexp_replace(t, r"[\x09-\x0D]", " "), " "), "")
    n, capitals = F.size(words).cast("long"), F.regexp_count(t, F.lit("[A-Z]")).cast("long")
    return [n < WORDS, F.size(F.array_distinct(words)).cast("long") * 100 < n * DISTINCT, capitals * 100 > F.char_length(t).cast("long") * CAPITALS, t.rlike(MARKS)]


def flagged(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """n documents for each part, flags a to e, good and toxic."""
    four = [f.alias(c) for f, c in zip(failures(F.col("text")), "abcd", strict=True)]
    slim = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), *four)
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    # Rows of one id and text are counted first. Rows without an id are told apart from the rest by a number, so that they spread.
    keyed = slim.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("digest")))
    rows = keyed.groupBy("id", "salt", "part", "digest", *"abcd").agg(F.count("*").alias("n"))
    labelled = rows.join(known, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    # Of each group of copies the rows with the smallest id; groups are counted by task before they meet.
    alike = ["part", *"abcd", "good", "toxic"]
    by_kind = labelled.groupBy("digest", *alike).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), F.min("id").alias("first"), F.min_by("n", "id").alias("at_first"))
    kind = F.struct(F.col("first"), *(F.col(c) for c in alike), "n", "unnamed", "at_first")
    groups = by_kind.groupBy("digest").agg(F.min("first").alias("least"), F.collect_list(kind).alias("kinds"))
    each = groups.select("least", F.explode("kinds").alias("k")).select("least", "k.*")
    kept = F.col("unnamed") + F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(F.lit(0))
    sides = F.array(F.struct(F.lit(False).alias("e"), kept.alias("n")), F.struct(F.lit(True).alias("e"), (F.col("n") - kept).alias("n")))
    split = each.select(*alike, F.explode(sides).alias("s")).select(*alike, "s.e", "s.n").where("n > 0")
    return split.groupBy(*alike, "e").agg(F.sum("n").alias("n"))


def survivors(counted: DataFrame) -> DataFrame:
    """part (null: all parts), subset (bit k: filter k is applied), and the n documents, good and toxic ones that pass all of the subset."""
    cube = counted.cube(*"abcde", "part").agg(
        *(F.grouping(c).alias(f"no_{c}") for c in [*"abcde", "part"]),
        *(F.sum(x).alias(name) for name, x in (("n", F.col("n")), ("good", F.when(F.col("good"), F.col("n")).otherwise(0)), ("toxic", F.when(F.col("toxic"), F.col("n")).otherwise(0)))),
    )
    passed = cube.where(" AND ".join(f"(no_{c} = 1 OR NOT {c})" for c in "abcde"))
    subset = sum(((1 - F.col(f"no_{c}")) * (1 << k) for k, c in enumerate("abcde")), F.lit(0)).cast("int")
    return passed.select(F.when(F.col("no_part") == 0, F.col("part")).alias("part"), subset.alias("subset"), "n", "good", "toxic")


def steps() -> list[tuple]:
    """(filter_order, step, bit of its filter, subset before, subset after) of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        done = 0
        for step, k in enumerate(order, 1):
            out.append(("".join(FILTERS[x] for x in order), step, 1 << k, done, done | 1 << k))
            done |= 1 << k
    return out


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order and step, zeros included."""
    spark, whole = docs.sparkSession, (1 << len(FILTERS)) - 1
    # Several joins read these counts, so they are written: the texts are read once.
    found = write_table(survivors(flagged(docs, labels, part)).where("part IS NOT NULL"))
    # A part's table of subsets: subsets without survivors are missing in the CUBE, and are zeros.
    held = found.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("subset", F.struct("n", "good", "toxic")))).alias("by"))
    count = lambda at, name: F.coalesce(F.col("by")[at][name], F.lit(0))
    lattice = held.select("part", "by", F.explode(F.sequence(F.lit(0), F.lit(whole))).alias("subset")).select("part", "subset", *(count(F.col("subset"), c).alias(c) for c in ("n", "good", "toxic")))
    sides = {side: lattice.select("part", *(F.col(c).alias(f"{side}_{c}") for c in ("subset", "n", "good", "toxic"))) for side in ("before", "after")}
    plan = spark.createDataFrame(steps(), "filter_order string, step int, bit int, before_subset int, after_subset int")
    # Two subsets that differ in one filter: 80 pairs a part, whatever the orders.
    pairs = sides["before"].withColumn("bit", F.explode(F.array(*(F.lit(1 << k) for k in range(len(FILTERS)))))).where("before_subset & bit = 0").withColumn("after_subset", F.expr("before_subset | bit")).join(sides["after"], ["part", "after_subset"])
    removed = pairs.select("part", "bit", "before_subset", "after_subset", F.col("after_n").alias("kept"), (F.col("before_n") - F.col("after_n")).alias("removed"), (F.col("before_good") - F.col("after_good")).alias("good_lost"), (F.col("before_toxic") - F.col("after_toxic")).alias("toxic_lost"))
    failing = removed.where("before_subset = 0").select("part", "bit", F.col("removed").alias("failing"))
    alone = removed.where(f"after_subset = {whole}").select("part", "bit", F.col("removed").alias("unique_fails"))
    each = removed.join(F.broadcast(plan), ["bit", "before_subset", "after_subset"])
    shared = each.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    out = each.join(failing, ["part", "bit"]).join(alone, ["part", "bit"]).join(shared, ["part", "bit"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
