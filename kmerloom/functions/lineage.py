"""Taxonomic lineage strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.dna import normalize_category

# Rank names with their prefixes, top to bottom, and labels that are no species.
RANK_TO_PREFIX = {"domain": "k__", "phylum": "p__", "class": "c__", "order": "o__", "family": "f__", "genus": "g__", "species": "s__"}
SKIP_SPECIES = ("unidentified", "uncultured", "unclassified")
RANKS = ("k__", "p__", "c__", "o__", "f__", "g__", "s__")


def _valid(x: Column) -> Column:
    return x.contains("__") & ~x.endswith("__")


def lineage_tokens(lineage: Column) -> Column:
    """Valid rank labels of ``k__A; p__B; ...``, left-trimmed, spaces as underscores."""
    return F.transform(F.filter(F.transform(F.split(lineage, ";"), lambda x: F.ltrim(x)), _valid), normalize_category)


def all_ranks(lineage: Column) -> Column:
    """Valid rank labels, trimmed on both sides."""
    return F.filter(F.transform(F.split(lineage, ";"), lambda x: F.trim(x)), _valid)


def lowest_rank(lineage: Column) -> Column:
    """The last valid rank label, or ``unclassified``."""
    return F.coalesce(F.try_element_at(all_ranks(lineage), F.lit(-1)), F.lit("unclassified"))


def is_bacterial(lineage: Column) -> Column:
    return lineage.startswith("Bacteria;")


def prefixed_taxonomy(lineage: Column, ranks: Column) -> Column:
    """Plain path ``Bacteria;...`` to ``k__Bacteria;...`` with ranks from a map of cumulative path to rank name.

    The last token is the species unless it is a placeholder; a placeholder on the way gives null, as does a path
    without ``Bacteria``; tokens whose path has no known rank are left out.
    """
    tokens = F.filter(F.split(lineage, ";"), lambda x: F.trim(x) != "")
    start = F.array_position(tokens, "Bacteria").cast("int")
    own = F.slice(tokens, F.greatest(start, F.lit(1)), F.greatest(F.size(tokens), F.lit(1)))
    n = F.size(own)
    prefixes = F.create_map(*[F.lit(x) for kv in RANK_TO_PREFIX.items() for x in kv])
    skipped = lambda x: F.lower(x).isin(*SKIP_SPECIES)
    middle = F.slice(own, 2, F.greatest(n - 2, F.lit(0)))

    def named(x: Column, i: Column) -> Column:
        path = F.concat(F.array_join(F.slice(own, F.lit(1), i + 2), ";"), F.lit(";"))
        return F.concat(F.try_element_at(prefixes, F.try_element_at(ranks, path)), x)

    last = F.try_element_at(own, F.lit(-1))
    tail = F.when((n > 1) & ~skipped(last), F.array(F.concat(F.lit("s__"), last))).otherwise(F.array().cast("array<string>"))
    labels = F.concat(F.array(F.lit("k__Bacteria")), F.filter(F.transform(middle, named), lambda x: x.isNotNull()), tail)
    return F.when((start > 0) & ~F.exists(middle, skipped), F.array_join(labels, ";"))


def prefixed_lineages(paths: DataFrame, ranks: DataFrame, path_col: str = "description") -> DataFrame:
    """(path, lineage) of the distinct plain paths, as :func:`prefixed_taxonomy`, with ranks (path, rank) joined by cumulative path."""
    known = ranks.where(F.col("rank").isin(*RANK_TO_PREFIX)).select(F.col("path").alias("rank_path"), "rank")
    skipped = lambda x: F.lower(x).isin(*SKIP_SPECIES)
    tokens = F.filter(F.split(F.col("path"), ";"), lambda x: F.trim(x) != "")
    listed = paths.select(F.col(path_col).alias("path")).distinct().withColumn("tokens", tokens)
    listed = listed.withColumn("start", F.array_position("tokens", "Bacteria").cast("int")).where("start > 0")
    listed = listed.withColumn("own", F.expr("slice(tokens, start, size(tokens))"))
    listed = listed.withColumn("middle", F.slice("own", 2, F.greatest(F.size("own") - 2, F.lit(0)))).where(~F.exists("middle", skipped))
    last = F.element_at("own", -1)
    tail = F.when((F.size("own") > 1) & ~skipped(last), F.concat(F.lit("s__"), last))
    rows = listed.select("path", tail.alias("tail"), "own", F.posexplode_outer("middle").alias("place", "token"))
    upto = F.concat(F.array_join(F.slice("own", F.lit(1), F.col("place") + 2), ";"), F.lit(";"))
    joined = rows.withColumn("upto", upto).join(known, F.col("upto") == F.col("rank_path"), "left")
    prefixes = F.create_map(*[F.lit(x) for kv in RANK_TO_PREFIX.items() for x in kv])
    label = F.concat(F.try_element_at(prefixes, F.col("rank")), F.col("token"))
    grouped = joined.withColumn("label", label).groupBy("path").agg(F.first("tail").alias("tail"), F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("place", "label")))).alias("labels"))
    return grouped.select("path", F.concat_ws(";", F.lit("k__Bacteria"), F.transform("labels", lambda x: x["label"]), "tail").alias("lineage"))
