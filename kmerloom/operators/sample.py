"""A seeded read simulator: labelled reads from species of a library (error-free)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.session import stored

# Defaults of the generator.
TOTAL_READS, NUM_TAXA, READ_LEN, MIN_LEN, MAX_LEN, MAX_TEMPLATES = 10_000, 25, 125, 90, 125, 50


def simulate_reads(library: DataFrame, lineages: DataFrame, total_reads: int = TOTAL_READS, num_taxa: int = NUM_TAXA, read_len: int = READ_LEN, min_len: int = MIN_LEN, max_len: int = MAX_LEN, max_templates: int = MAX_TEMPLATES, prefix: str = "s__", seed: int = 1) -> DataFrame:
    """(read_id, taxonomy, template_id, orig_len, final_len, sequence, quality).

    Taxa are sampled by a seeded digest, their abundances are Dirichlet(1), each taxon gets at least one read and the
    rest goes to taxa in turn; a read is a seeded piece of one of at most ``max_templates`` templates, cut to a
    length between ``min_len`` and ``max_len``; templates shorter than the cut are skipped. Reruns agree.
    """
    own = library.where(F.col("category").startswith(prefix) & (F.length("sequence") > 0))
    digest = lambda *c: F.md5(F.concat_ws(":", F.lit(str(seed)), *[x.cast("string") for x in c]).cast("binary"))
    unit = lambda *c: (F.conv(F.substring(digest(*c), 1, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)
    taxa = own.select("category").distinct().orderBy(digest(F.col("category"))).limit(num_taxa)
    taxa = taxa.withColumn("w", -F.log(unit(F.lit("w"), F.col("category"))))
    every = Window.partitionBy()
    shares = stored(taxa.withColumn("n", F.greatest(F.lit(1), F.floor(F.col("w") / F.sum("w").over(every) * total_reads)).cast("bigint")), "taxa")
    have, count = shares.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()[:]
    if count < num_taxa:
        raise ValueError("not enough categories available")
    short = max(0, total_reads - have)
    turn = F.row_number().over(Window.orderBy("category")) - 1
    shares = shares.withColumn("n", F.col("n") + F.lit(short // count) + (turn < short % count).cast("bigint"))
    order = Window.partitionBy("category").orderBy(digest(F.col("seq_id")), "seq_id")
    templates = own.join(F.broadcast(shares.select("category")), "category").withColumn("t", F.row_number().over(order) - 1).where(F.col("t") < max_templates)
    sizes = templates.groupBy("category").agg(F.count(F.lit(1)).alias("n_templates"))
    reads = shares.join(sizes, "category").withColumn("r", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    reads = reads.withColumn("t", F.floor(unit(F.lit("t"), F.col("category"), F.col("r")) * F.col("n_templates")).cast("int"))
    joined = reads.join(templates.select("category", "t", "seq_id", "sequence"), ["category", "t"]).join(lineages.select("seq_id", "lineage"), "seq_id", "left")
    final = (F.lit(min_len) + F.floor(unit(F.lit("l"), F.col("category"), F.col("r")) * (max_len - min_len + 1))).cast("int")
    start = F.floor(unit(F.lit("s"), F.col("category"), F.col("r")) * (F.greatest(F.length("sequence") - read_len, F.lit(0)) + 1)).cast("int")
    cut = joined.withColumn("final_len", final).withColumn("piece", F.substring(F.col("sequence"), start + 1, F.lit(read_len))).where(F.length("piece") >= F.col("final_len"))
    # reads are numbered within their taxon, after all reads of the taxa before it (a table of one row a taxon)
    sizes = cut.groupBy("category").agg(F.count(F.lit(1)).alias("kept"))
    before = sizes.select("category", F.coalesce(F.sum("kept").over(Window.orderBy("category").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("category").orderBy("r"))
    return cut.join(F.broadcast(before), "category").select(
        F.format_string("read_%08d", number).alias("read_id"),
        F.coalesce("lineage", F.lit("NA")).alias("taxonomy"),
        F.col("seq_id").alias("template_id"),
        F.lit(read_len).alias("orig_len"),
        "final_len",
        F.substring(F.col("piece"), F.lit(1), F.col("final_len")).alias("sequence"),
        F.repeat(F.lit("I"), F.col("final_len")).alias("quality"),
    )


def coverage(n_reads: int, read_len: int, total_length: int) -> float:
    """Reads times read length over the total template length."""
    return n_reads * read_len / total_length
