"""The corpus pipeline: documents pass quality rules, lose near duplicates and leaked benchmark items, are mixed and sharded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.decontaminate import decontaminated
from strandline.llm.exchange import staged, staged_alone
from strandline.llm.group_join import ngram_join
from strandline.llm.mixing import laid_out, mix
from strandline.llm.rules import quality_rules
from strandline.llm.sharding import shard

SHARD_BYTES = 16 << 20


def apart(docs: DataFrame, stage: Callable[[DataFrame], DataFrame], *taken: str) -> DataFrame:
    """stage(docs) with the columns of docs; those that have a taken name, which stage's operator uses, are called otherwise meanwhile."""
    names = {c: f"{unused(docs, *(f'own_{k}' for k in range(len(taken))))}own_{taken.index(c)}" if c in taken else c for c in docs.columns}
    out = stage(docs.withColumnsRenamed({c: n for c, n in names.items() if c != n}))
    return out.select(*(F.col(f"`{n}`").alias(c) for c, n in names.items()))


def unused(docs: DataFrame, *names: str) -> str:
    """A prefix with which none of the names is a column of docs."""
    prefix = ""
    while {f"{prefix}{n}" for n in names} & set(docs.columns):
        prefix += "_"
    return prefix


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest keep; limits come from the labelled rows.

    Null and empty texts go for want of words; repeated rows, rows of one id and rows without an id are judged each by
    its own text; own columns of any name and type stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return apart(docs, lambda d: quality_rules(d, labels).where("rules.kept"), "rules")


def row_key(text: Column) -> Column:
    return F.xxhash64("doc_id", text, F.col("text").isNull())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that of the least id, of equal ids that of the least hash of id and text; null ids come last.

    A document is an id with a text.  Texts that share an id are documents of their own and go only if they are near
    copies themselves; so do texts without an id.  Of rows with equal id and text the least in its columns' order stays (maps
    as JSON).  Documents are told apart by 64 bits of one hash and 128 of another: those few that only the second one tells apart
    stay, and group with none.  Null and empty texts group with none either.
    """
    known = F.coalesce(F.col("text"), F.lit(""))
    key, check = row_key(known).alias("key"), F.md5(F.concat_ws("\x1f", F.col("doc_id").cast("string"), F.col("text").isNull().cast("string"), known)).alias("check")
    ids = staged(docs.select("doc_id", key, check).groupBy("key").agg(F.min("doc_id").alias("id"), F.min("check").alias("least"), F.max("check").alias("most")))
    clash = ids.where("least <> most").select("key")
    some = not clash.isEmpty()
    light = docs.select(key, "text")
    parts = ngram_join(light.join(clash, "key", "left_anti") if some else light, "key").select(F.col("doc_id").alias("key"), "component_id").distinct().join(ids.select("key", "id"), "key")
    stays = parts.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("least")).select("least.key")
    rows = docs.select(key, check, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = rows.join(stays.unionAll(clash) if some else stays, "key", "left_semi")
    order = F.struct(*(F.to_json(F.col(f"row.`{c}`")) if "map<" in kind else F.col(f"row.`{c}`") for c, kind in docs.dtypes))
    return kept.groupBy("key", "check").agg(F.min_by("row", order).alias("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.  Null and empty texts hold none; repeated rows are judged alike; own columns stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return apart(docs, lambda d: decontaminated(d, items), "hits")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is dealt out, the rows of an output shard together in a file, in shuffled order.

    A document without words is never taken, as it adds nothing to a source's words; equal rows are taken alike; a null source is
    one of its own.  Own columns stay.
    """
    return apart(docs, lambda d: laid_out(mix(d)), "mix", "_place")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that each goes to, and its place in the mix.

    mix_file and mix_row are the file that the mix wrote a row to and its number there: in their order, a shard's rows are
    in the order that the mix dealt and shuffled them in.  They are null where docs is not read from files.  Null and empty texts
    have no bytes; rows of equal id and text share a shard, unless they don't fit.  Own columns stay; where one has an added
    column's name, the added ones get underscores in front.
    """
    prefix = unused(docs, "mix_file", "mix_row", "shard_id", "shard_depth", "shard_bytes", "shard_part")
    try:
        docs = docs.withColumns({f"{prefix}mix_file": F.col("_metadata.file_name"), f"{prefix}mix_row": F.col("_metadata.row_index")})
    except AnalysisException:
        docs = docs.withColumns({f"{prefix}mix_file": F.lit(None).cast("string"), f"{prefix}mix_row": F.lit(None).cast("long")})
    return shard(docs, SHARD_BYTES, prefix=f"{prefix}shard_")


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The forest, the edits of decontamination and the permuted mix have no SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        docs = staged_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
