"""The pull plan: which source files make which output, and the roll-ups over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.functions import paths as p
from samplewright.functions import text as t
from samplewright.model import PULL_PLAN_COLUMNS

STREAMS = ["R1", "R2", "NA"]
GZIP_TENTHS = 3  # fixed value: estimated compressed size, in tenths of the source bytes


def fastq_stream(name: str = "name"):
    """R1, R2 or NA by the file name, null for other files."""
    has = lambda s: F.contains(F.col(name), F.lit(s))
    return (
        F.when(has("_1_sequence.fastq"), "R1").when(has("_2_sequence.fastq"), "R2").when(has("_NA_sequence.fastq"), "NA")
    )


def plan_sources(samples: DataFrame, strategy: DataFrame) -> DataFrame:
    """One row per (sample, plate) with the folder name on the server; no strategy gives a null plate.

    `samples(sample_annotation, folder)`; `strategy(batch, plates array, year_prefix)`, one row per batch.
    """
    joined = samples.join(strategy.withColumnRenamed("batch", "folder"), "folder", "left")
    server = F.concat("year_prefix", F.lit("-"), F.expr("substring(sample_annotation, 2)"))
    return joined.select(
        "sample_annotation", F.col("folder").alias("batch"), server.alias("server_id"), "plates",
        F.posexplode_outer("plates").alias("plate_no", "plate"),
    ).withColumn("source_dir", F.concat_ws("-", "server_id", "plate"))


def job_sources(samples: DataFrame, strategy: DataFrame, files: DataFrame) -> DataFrame:
    """Every source file of a sample in plate order, one per row. `files(source_dir, path, size, name)`."""
    listed = files.withColumn("stream", fastq_stream()).where("stream IS NOT NULL")
    return plan_sources(samples.distinct(), strategy).join(listed, "source_dir").select(
        "sample_annotation", "batch", "stream", "plate_no", "path", F.col("size").cast("bigint").alias("size"), "name")


def plan_jobs(samples: DataFrame, strategy: DataFrame, files: DataFrame, out_dir: str = "fastq") -> DataFrame:
    """The jobs of a pull: one per single-end sample, two per paired one, an error row where that cannot be told.

    Only counts and byte sums are gathered per sample, combined before the shuffle; the files themselves stay in
    `job_sources`. A sample that is listed twice makes one job.
    """
    listed = files.withColumn("stream", fastq_stream()).where("stream IS NOT NULL")
    per_dir = listed.groupBy("source_dir").agg(*[
        agg.alias(f"{c}_{s}") for s in STREAMS for c, agg in (
            ("n", F.count_if(F.col("stream") == s)), ("b", F.sum(F.when(F.col("stream") == s, F.col("size")))))
    ])
    found = plan_sources(samples.distinct(), strategy).join(per_dir, "source_dir", "left").groupBy(
        "sample_annotation", "batch"
    ).agg(
        F.bool_or(F.col("plate").isNull()).alias("_lost"), F.first("plates").alias("plates"),
        *[F.coalesce(F.sum(f"{c}_{s}"), F.lit(0)).cast("bigint").alias(f"{c}_{s}") for s in STREAMS for c in "nb"],
    )
    paired, single, sa = F.col("n_R1") > 0, F.col("n_NA") > 0, F.col("sample_annotation")
    text = lambda v: v if not isinstance(v, (str, type(None))) else F.lit(v).cast("string")
    zero = F.lit(0).cast("bigint")

    def job(kind, stream, n, size, error):
        return F.struct(text(kind).alias("kind"), text(stream).alias("stream"), n.alias("n_sources"),
                        size.alias("total_src_bytes"), text(error).alias("error"))

    def fail(*parts):
        return job(None, None, zero, zero, F.concat(*map(text, parts)))

    def stream_job(s):
        whole = job("paired-stream", s, F.col(f"n_{s}"), F.col(f"b_{s}"), None)
        return F.when(F.col(f"n_{s}") > 0, whole).otherwise(fail(sa, f": missing {s} stream"))

    single_kind = F.when(F.col("n_NA") == 1, "single").otherwise("single-merged")
    plates = F.array_join(F.transform("plates", lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    jobs = (
        F.when(F.col("_lost"), F.array(fail("no plate strategy for batch ", F.col("batch"))))
        .when(paired & single, F.array(fail(sa, ": AMBIGUOUS — has both paired and _NA_ files in same plate dirs")))
        .when(paired, F.array(stream_job("R1"), stream_job("R2")))
        .when(single, F.array(job(single_kind, "NA", F.col("n_NA"), F.col("b_NA"), None)))
        .otherwise(F.array(fail(sa, ": no FASTQs found in plate dirs [", plates, "]")))
    )
    tail = F.when(F.col("stream").isin("R1", "R2"), F.concat(F.lit("_"), F.col("stream"))).otherwise("")
    output = F.concat(F.lit(out_dir + "/"), "batch", F.lit("/"), "batch", F.lit("_"), sa, tail, F.lit(".fastq.gz"))
    return found.select("sample_annotation", "batch", F.inline(jobs)).withColumn(
        "output", F.when(F.col("error").isNull(), output))


def plan_table(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs as the ten text columns of a plan file. An error row holds its error only.

    The file format wants all sources of a job in one cell, so this view alone gathers them, in plate order.
    """
    keys = ["sample_annotation", "batch", "stream"]
    lists = sources.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("plate_no", "path", "size"))).alias("_s"))
    cells = {
        "source_paths": F.array_join(F.transform("_s", lambda s: s["path"]), ";"),
        "source_sizes": F.array_join(F.transform("_s", lambda s: s["size"].cast("string")), ";"),
        "error": F.coalesce("error", F.lit("")),
    }
    cell = lambda c: F.coalesce(cells.get(c, F.col(c).cast("string") if c in jobs.columns else None), F.lit(""))
    return jobs.join(lists, keys, "left").select(*[
        cell(c).alias(c) if c == "error" else F.when(F.col("error").isNull(), cell(c)).otherwise("").alias(c)
        for c in PULL_PLAN_COLUMNS
    ])


def parse_plan(plan: DataFrame) -> DataFrame:
    """Plan rows without errors, with their sources as array<struct<path, size, name>>."""
    sources = F.zip_with(
        F.split("source_paths", ";"), F.split("source_sizes", ";"),
        lambda path, size: F.struct(path.alias("path"), size.cast("bigint").alias("size"), p.base_name(path).alias("name")),
    )
    return plan.where(t.is_blank("error")).select(
        "sample_annotation", "batch", "kind", "stream", "output", sources.alias("sources"))


def plan_files(jobs: DataFrame) -> DataFrame:
    """Parsed plan rows to (output, source_no, path, size): the files of each output, in the plan's order."""
    each = jobs.select("output", F.posexplode("sources").alias("source_no", "_s"))
    return each.select("output", "source_no", F.col("_s")["path"].alias("path"), F.col("_s")["size"].alias("size"))


def plan_rollup(jobs: DataFrame) -> DataFrame:
    """Jobs, source bytes, errors and the estimated compressed size per batch, with a grand total."""
    per = jobs.rollup("batch").agg(
        F.count_if(F.col("error").isNull()).alias("n_jobs"), F.sum("total_src_bytes").alias("src_bytes"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.grouping("batch").alias("_total"),
    )
    return per.select(
        F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("batch")).alias("batch"), "n_jobs", "src_bytes", "n_errors",
        F.expr(f"src_bytes * {GZIP_TENTHS} div 10").alias("gzip_bytes"),
    )


def of_batch(samples: DataFrame, batch: str) -> DataFrame:
    return samples.where(F.col("folder") == batch)


def pending_jobs(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Jobs whose output is not there yet or empty: what a resumed pull has left to do."""
    done = outputs.where("length > 0").select(F.col("path").alias("output")).distinct()
    return jobs.where("error IS NULL").join(done, "output", "left_anti")
