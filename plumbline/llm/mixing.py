"""Mixing sources to target weights by Pareto order sampling.

A source's share of the mix is a number of words. Its documents are wanted so
many times each; the whole part of that are certain copies, the fraction is the
inclusion probability of one more. Documents are ranked by their random odds
divided by their inclusion odds, and taken in that order until the source's
words are reached.

The cut in the order is found from word counts of fine ranges of rank, so that
only one range of each source has to be sorted. All is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import materialize, numbered, words_of

RANGES = 1 << 16


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources in their order and repeat; a document is taken ``most`` times at most."""

    weights: Sequence[int] = (5, 2, 1)
    most: int = 3
    seed: str = "mix"


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_column: str = "doc_id") -> DataFrame:
    """Rows (id, size, source_size, target, taken), one for each of ``docs``.

    ``docs`` has the id, ``text`` and ``source``. ``size`` is the number of
    words (0 for a null text). Sources are weighed in code point order, null
    last, as a source of its own; the targets add up to all words. A target
    above ``most`` times its source stops there, and what is left over is shared
    out again. ``taken`` is a multiple of ``size``: the words the mix takes.

    A long document is wanted somewhat more often than a short one: in
    proportion to the binary digits of its size. Every row has a draw of its own,
    rows without an id or with the id of others too: it follows from id, text and,
    among rows equal in these, their number. The same rows give the same mix.
    Each source's words come as near to its target as one document allows. An
    empty table gives an empty result; other columns are ignored.
    """
    sizes = materialize(_rows(docs, id_column))
    again = _repeated(sizes)
    sizes = _each_numbered(sizes, again)
    plan, cuts = _plan(sizes, mix)
    drawn = _with_copies(sizes, plan, cuts, mix)
    return drawn.select(
        F.col("id").alias(id_column),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns.

    The draw is the one of ``mix_sources``; documents without a word are left
    out, an empty table stays empty. Of rows equal in id, source and text but not
    in other columns it is open which of them is taken how often.
    """
    sizes = materialize(_rows(docs, "doc_id"))
    again = _repeated(sizes)
    plan, cuts = _plan(_each_numbered(sizes, again), mix)
    # The documents keep their columns, whatever they are called, inside one.
    whole = _rows(docs, "doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    drawn = _with_copies(_each_numbered(whole, again), plan, cuts, mix)
    repeated = drawn.where("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    )
    return repeated.select("row.*")


def _rows(docs: DataFrame, id_column: str, *kept: Column) -> DataFrame:
    """What is drawn: id, source, size and ``same``, a digest that equal rows share."""
    source = F.col("source").cast("string")
    parts = [F.col(id_column).cast("string"), source, F.col("text").cast("string")]
    whole = F.concat(*[F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts[:2]], F.lit("\n"))
    return docs.select(
        *kept,
        F.col(id_column).alias("id"),
        source.alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(whole, parts[2]).alias("same"),
    )


def _repeated(rows: DataFrame) -> DataFrame:
    """The digests that several rows share."""
    return materialize(rows.groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select("same"))


def _each_numbered(rows: DataFrame, again: DataFrame) -> DataFrame:
    """``rows`` with ``row_key``, which tells equal rows apart by their number.

    Only rows that are repeated are numbered; a row repeated however often is
    numbered by the parts of the table that hold it.
    """
    one = F.lit(0).cast("bigint")
    if again.isEmpty():
        found = rows.withColumn("index", one)
    else:
        alone = rows.join(again, "same", "left_anti").withColumn("index", one)
        several = numbered(rows.join(again, "same", "left_semi"), "same", []).drop("n")
        found = alone.unionByName(several.select(*alone.columns))
    return found.withColumn("row_key", F.xxhash64("same", "index")).drop("same", "index")


def _plan(sizes: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """What each class of documents gets, and where each source's order is cut.

    Both tables have a few rows per source. They are written, so that Spark
    knows their size when it decides how to join them.
    """
    classes = (
        sizes.groupBy("source", _digits().alias("digits"))
        .agg(F.sum("size").alias("class_size"))
        .withColumn("source_key", _key(F.col("source")))
    )
    targets = _targets(classes, mix)
    # Within a source each document is wanted c * digits times, ``most`` at most;
    # c is found as the targets are: the longest documents reach the limit first.
    down = Window.partitionBy("source_key").orderBy(F.desc("digits"))
    here = classes.join(targets, "source_key")
    above = F.coalesce(F.sum("class_size").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("class_size") * F.col("digits")).over(down.rowsBetween(0, Window.unboundedFollowing))
    tried = here.withColumn("above", above).withColumn("rest", rest).withColumn(
        "c", F.when(F.col("rest") > 0, (F.col("target") - mix.most * F.col("above")) / F.col("rest")).otherwise(F.lit(0.0))
    )
    fits = F.when(F.col("c") * F.col("digits") <= mix.most, F.col("c"))
    solved = tried.withColumn("chosen", F.first(fits, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    wanted = F.least(F.lit(float(mix.most)), F.coalesce("chosen", F.lit(float(mix.most))) * F.col("digits"))
    plan = materialize(
        solved.withColumn("wanted", wanted)
        .withColumn("certain", F.floor("wanted"))
        .select(
            "source_key",
            "digits",
            "class_size",
            "source_size",
            "target",
            "certain",
            (F.col("wanted") - F.col("certain")).alias("chance"),
        )
    )
    return plan, _cuts(sizes, plan, mix)


def _targets(classes: DataFrame, mix: Mix) -> DataFrame:
    """Words for each source, however many sources there are.

    The level, words for each unit of weight, rises as sources reach their limit
    and drop out, until no other does.
    """
    sources = classes.groupBy("source_key").agg(F.sum("class_size").alias("source_size"))
    weights = F.array(*[F.lit(int(w)) for w in mix.weights])
    placed = numbered(sources.withColumn("all", F.lit("")), "all", ["source_key"])
    weighed = materialize(
        placed.select("source_key", "source_size", F.get(weights, (F.col("index") % len(mix.weights)).cast("int")).cast("bigint").alias("weight"))
    )
    limit = mix.most * F.col("source_size")
    level, open_ = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= limit
        held = weighed.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, limit)).alias("given"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.count(F.when(~full, 1)).alias("open"),
        ).first()
        if not held["weight"] or held["open"] == open_:
            break
        level, open_ = (held["total"] - (held["given"] or 0)) / held["weight"], held["open"]
    target = F.least(limit.cast("double"), F.lit(level) * F.col("weight"))
    return weighed.select("source_key", "source_size", target.alias("target"))


def _cuts(sizes: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """Per source: the last place of the order that is taken, and the document that closes the gap."""
    need = plan.groupBy("source_key").agg(
        (F.first("target") - F.sum(F.col("certain") * F.col("class_size"))).alias("need")
    )
    ranked = _ranked(sizes, plan, mix).where("rank IS NOT NULL")
    ranges = ranked.groupBy("source_key", "range").agg(F.sum("size").alias("words"))
    up = Window.partitionBy("source_key").orderBy("range")
    ended = (
        ranges.withColumn("end", F.sum("words").over(up))
        .join(need, "source_key")
        .withColumn("before", F.col("end") - F.col("words"))
    )
    # The first range that does not fit as a whole; null if all do.
    cut_range = ended.groupBy("source_key").agg(
        F.min(F.when(F.col("end") > F.col("need"), F.struct("range", "before"))).alias("cut"),
        F.first("need").alias("need"),
        F.max("end").alias("all_words"),
    )
    cut_range = materialize(cut_range.select("source_key", "need", "all_words", "cut.range", "cut.before"))
    inside = ranked.join(
        cut_range.select("source_key", "range", "before", "need"), ["source_key", "range"]
    )
    step = Window.partitionBy("source_key", "range").orderBy("rank", "row_key")
    taken = (
        inside.withColumn("end", F.col("before") + F.sum("size").over(step.rowsBetween(Window.unboundedPreceding, 0)))
        .where("end <= need")
        .groupBy("source_key")
        .agg(F.max(F.struct("rank", "row_key")).alias("last"), F.max("end").alias("end"))
    )
    reached = cut_range.join(taken, "source_key", "left").select(
        "source_key",
        F.col("range").alias("cut_range"),
        F.col("last.rank").alias("last_rank"),
        F.col("last.row_key").alias("last_key"),
        (F.col("need") - F.coalesce("end", "before", "all_words")).alias("gap"),
    )
    left = ranked.join(materialize(reached), "source_key").where(~_before_cut())
    closing = left.where(F.abs(F.col("size") - F.col("gap")) < F.col("gap")).groupBy("source_key").agg(
        F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("miss"), "rank", "row_key")).alias("closing")
    )
    return materialize(
        reached.join(closing, "source_key", "left").select(
            F.col("source_key"), "cut_range", "last_rank", "last_key",
            F.col("closing.rank").alias("closing_rank"), F.col("closing.row_key").alias("closing_key"),
        )
    )


def _with_copies(rows: DataFrame, plan: DataFrame, cuts: DataFrame, mix: Mix) -> DataFrame:
    drawn = _ranked(rows, plan, mix).join(cuts, "source_key", "left")
    closing = (F.col("rank") == F.col("closing_rank")) & (F.col("row_key") == F.col("closing_key"))
    extra = F.col("rank").isNotNull() & (_before_cut() | F.coalesce(closing, F.lit(False)))
    return drawn.withColumn("copies", (F.col("certain") + extra.cast("int")).cast("bigint"))


def _before_cut() -> Column:
    """Whether a place of the order lies before the source's cut."""
    whole = F.col("cut_range").isNull() | (F.col("range") < F.col("cut_range"))
    inside = (F.col("rank") < F.col("last_rank")) | (
        (F.col("rank") == F.col("last_rank")) & (F.col("row_key") <= F.col("last_key"))
    )
    return whole | ((F.col("range") == F.col("cut_range")) & F.coalesce(inside, F.lit(False)))


def _ranked(rows: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """The rows with what their class gets, and their Pareto rank if one more copy is possible.

    The rank q is given as q / (1 + q), which lies between 0 and 1.
    """
    keyed = rows.withColumn("source_key", _key(F.col("source"))).withColumn("digits", _digits())
    met = keyed.drop("source").join(plan.drop("class_size"), ["source_key", "digits"])
    draw = (
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{mix.seed}:"), F.col("row_key").cast("string"))), 1, 12), 16, 10).cast("double") + 0.5
    ) / float(1 << 48)
    odds = (draw / (1 - draw)) / (F.col("chance") / (1 - F.col("chance")))
    rank = F.when((F.col("chance") > 0) & (F.col("size") > 0), odds / (1 + odds))
    ranked = met.withColumn("rank", rank)
    return ranked.withColumn("range", F.floor(F.col("rank") * RANGES))


def _digits() -> Column:
    """Binary digits of the size: classes of like length, 64 at most."""
    return F.length(F.bin("size")).cast("bigint")


def _key(source: Column) -> Column:
    """A source as a key that is never null: null sorts last."""
    return F.struct(source.isNull().alias("missing"), F.coalesce(source, F.lit("")).alias("name"))
