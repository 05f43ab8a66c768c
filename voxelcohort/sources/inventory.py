"""File inventories: scan, classify, group into cases, and check them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelcohort.functions import constant_rows, violation, violations_of, violations_union

IMAGE_SUFFIXES = (".nii", ".nii.gz", ".mha", ".mhd")

# Fixed patterns: (category, expression) in order, first match wins; matched without case.
MRI_2015_RULES = (
    ("ot", r"groundtruth|ground_truth|(^|[./_-])ot([./_-]|$)"),
    ("flair", r"flair"),
    ("dwi", r"(^|[./_-])dwi([./_-]|$)|mr_dwi"),
    ("t2", r"(^|[./_-])t2([./_-]|$)|mr_t2"),
    ("t1", r"(^|[./_-])t1([./_-]|$)|mr_t1"),
)
CT_2024_RULES = (
    ("ncct", r"/raw_?data/sub-[^/]+/ses-0*1/[^/]*_ncct\.nii\.gz$"),
    ("cta", r"/derivatives/sub-[^/]+/ses-0*1/.*/?[^/]*space-ncct_cta\.nii\.gz$"),
    ("tmax", r"/derivatives/sub-[^/]+/ses-0*1/.*/?[^/]*space-ncct_tmax\.nii\.gz$"),
    ("cbf", r"/derivatives/sub-[^/]+/ses-0*1/.*/?[^/]*space-ncct_cbf\.nii\.gz$"),
    ("cbv", r"/derivatives/sub-[^/]+/ses-0*1/.*/?[^/]*space-ncct_cbv\.nii\.gz$"),
    ("mtt", r"/derivatives/sub-[^/]+/ses-0*1/.*/?[^/]*space-ncct_mtt\.nii\.gz$"),
    ("lesion_mask", r"/derivatives/sub-[^/]+/ses-0*2/[^/]*_lesion-msk\.nii\.gz$"),
    ("baseline_csv", r"/phenotype/ses-0*1/[^/]*_demographic_baseline\.csv$"),
)
SESSION_SPELLINGS = ("ses-%02d", "ses-%04d", "ses-%d")


def inventory_scan(spark: SparkSession, root: str, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Files below ``root`` with one of the suffixes; archive side files are dropped.

    Only listing columns are selected, so file contents are never read.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .select("path", "length", "modificationTime")
    )
    return keep_images(files, suffixes)


def keep_images(files: DataFrame, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower("path").endswith(s.lower())
    side_file = F.col("path").rlike(r"(^|/)__MACOSX(/|$)|(^|/)\._[^/]*$")
    return files.where(wanted & ~side_file)


def normalized_path(path: Column) -> Column:
    """Forward slashes, no leading dots or slashes, one slash in front."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[./]+", ""))


def tail_parts(path: Column, parts: int = 4) -> Column:
    """The last path components in lower case."""
    return F.lower(F.array_join(F.slice(F.concat(F.array_repeat(F.lit(""), parts), F.split(path, "/")), -parts, parts), "/"))


def classify_paths(df: DataFrame, rules: Sequence[tuple[str, str]], text: Column | None = None) -> DataFrame:
    """Adds ``category``: the first rule whose expression is found in the text, else null."""
    subject = normalized_path(F.col("path")) if text is None else text
    found = [F.when(subject.rlike(f"(?i){pattern}"), F.lit(name)) for name, pattern in rules]
    return df.withColumn("category", F.coalesce(*found))


def category_counts(df: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Required categories whose file count differs from the expected one.

    The expected table comes from the frame's own aggregate, so an absent category shows as 0.
    """
    counts = df.agg(*[F.count_if(F.col("category") == c).alias(f"n_{i}") for i, c in enumerate(expected)])
    return violations_of(counts, [
        (F.col(f"n_{i}") != n, "category_count", F.lit(c), F.col(f"n_{i}")) for i, (c, n) in enumerate(expected.items())
    ])


def subject_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(?i)(sub-[^/]+)", 1)


def case_key(path: Column, root: str = "") -> Column:
    """Directory parts below the root joined by ``__``."""
    relative = F.regexp_replace(F.regexp_replace(path, "^" + root.rstrip("/") + "/?", "") if root else path, "^/", "")
    parts = F.split(relative, "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "__")


def training_id(case_id: Column) -> Column:
    """Identifier with dashes turned into underscores."""
    return F.regexp_replace(case_id, "-", "_")


def id_collisions(cases: DataFrame) -> DataFrame:
    """Different case ids that become equal once normalised."""
    n = cases.select("case_id").distinct().groupBy(training_id(F.col("case_id")).alias("training_id")).agg(F.count(F.lit(1)).alias("n"))
    return violation(n.where("n > 1"), "training_id_collision", F.col("training_id"), F.col("n"))


def assemble_cases(
    files: DataFrame, required: Sequence[str], optional: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Files ``(case_id, category, path)`` as one row a case, plus violations.

    Repeated categories and missing required ones are violations; only complete cases remain.
    A plain conditional aggregate: nothing is collected per case.
    """
    wanted = [*required, *optional]
    aggs = []
    for c in wanted:
        mine = F.col("category") == c
        aggs += [F.min(F.when(mine, F.col("path"))).alias(c), F.count_if(mine).alias(f"_n_{c}")]
    wide = files.where(F.col("category").isin(wanted)).groupBy("case_id").agg(*aggs)
    case = F.col("case_id")
    rules = [(F.col(f"_n_{c}") > 1, "category_repeated", case, F.lit(c)) for c in wanted]
    rules += [(F.col(f"_n_{c}") == 0, "category_missing", case, F.lit(c)) for c in required]
    complete = F.lit(True)
    for c in wanted:
        complete = complete & ((F.col(f"_n_{c}") == 1) if c in required else (F.col(f"_n_{c}") <= 1))
    return wide.where(complete).select("case_id", *wanted), violations_of(wide, rules)


def acute_model_inputs(cases: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Available allow-listed channels of each case, long form."""
    present = [c for c in allowed if c in cases.columns]
    pairs = ", ".join(f"'{c}', `{c}`" for c in present)
    return cases.selectExpr("case_id", f"stack({len(present)}, {pairs}) as (channel, path)").where("path is not null")


def session_resolve(files: DataFrame, phase: int) -> DataFrame:
    """One path per case and category for a session, preferring its common spellings in order."""
    spelling = F.lower(F.regexp_extract("path", r"(?i)/(ses-\d+)/", 1))
    names = [s % phase for s in SESSION_SPELLINGS]
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), spelling)
    return (
        files.withColumn("_rank", rank).where(F.col("_rank") > 0)
        .groupBy("case_id", "category")
        .agg(F.min_by("path", F.struct(F.col("_rank"), F.col("path"))).alias("path"))
    )


def keyed_table_violations(
    rows: DataFrame, cases: DataFrame, channels: Sequence[str], expected_n: int | None = None
) -> DataFrame:
    """A (case, channel) table must hold every pair exactly once and nothing else."""
    need = constant_rows(cases.select("case_id").distinct(), channels, "channel").withColumn("_e", F.lit(1))
    have = rows.groupBy("case_id", "channel").agg(F.count(F.lit(1)).alias("n"))
    both = need.join(have, ["case_id", "channel"], "full_outer")
    key, none = F.concat_ws("/", "case_id", "channel"), F.lit("")
    out = [violations_of(both, [
        (F.col("n").isNull(), "key_missing", key, none),
        (F.col("_e").isNull(), "key_unexpected", key, none),
        (F.col("n") > 1, "key_repeated", key, F.col("n")),
    ])]
    if expected_n is not None:
        total = rows.agg(F.count(F.lit(1)).alias("n"))
        out.append(violation(total.where(F.col("n") != expected_n), "row_count", F.lit("table"), F.col("n")))
    return violations_union(out)


def required_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns a table should have but lacks (schema check, no data is read)."""
    return [c for c in columns if c not in df.columns]


def paired_files(files: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """Subjects holding exactly one file of both categories, with lower-case ids, plus violations."""
    n = files.groupBy(F.lower("subject").alias("case_id")).agg(
        F.count_if(F.col("category") == left).alias("l"), F.count_if(F.col("category") == right).alias("r"),
        F.min(F.when(F.col("category") == left, F.col("path"))).alias("left_path"),
        F.min(F.when(F.col("category") == right, F.col("path"))).alias("right_path"),
    )
    case = F.col("case_id")
    found = violations_of(n, [
        (F.col("l") > 1, "repeated", case, F.lit(left)),
        (F.col("r") > 1, "repeated", case, F.lit(right)),
        ((F.col("l") > 0) & (F.col("r") == 0), "one_sided", case, F.lit(left)),
        ((F.col("l") == 0) & (F.col("r") > 0), "one_sided", case, F.lit(right)),
    ])
    return n.where("l = 1 and r = 1").select("case_id", "left_path", "right_path"), found
