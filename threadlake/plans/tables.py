"""The logical tables of session logs, seen in the driver's synthetic tables.

Conversations are sessions and messages, events are usage observations; files,
roots and projects follow from conversation ids by fixed rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import ORDINAL_BITS, preview

AGENTS = ("claude", "codex", "gemini", "other")
SUPPORTED = AGENTS[:3]
EPOCH = 1_700_000_000_000
RATES = [
    # model_pattern, input, output, cache write, cache read, extra reasoning, input includes cached, unmetered
    ("click", "2.000000", "10.000000", "2.500000", "0.200000", None, False, False),
    ("p*", "1.250000", "5.000000", None, "0.125000", "3.000000", True, False),
    ("pur*", "3.000000", "15.000000", "3.750000", "0.300000", None, True, False),
    ("view", None, None, None, None, None, False, True),
]


class Tables:
    """Logical tables for one data folder; each is a plan over only the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def supported(self) -> DataFrame:
        return self.spark.createDataFrame([(a,) for a in SUPPORTED], "agent string")

    def root(self) -> DataFrame:
        return self.spark.createDataFrame([(i + 1, a, f"/logs/{a}", True) for i, a in enumerate(AGENTS)], "id bigint, agent string, path string, is_default boolean")

    @staticmethod
    def agent_of(file_id):
        return F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (F.pmod(file_id, F.lit(4)) + 1).cast("int"))

    def message(self) -> DataFrame:
        c = self.raw("conversations").withColumn("session_id", F.col("conv_id"))
        file_id = F.floor(F.col("conv_id") / 10)
        w = Window.partitionBy("conv_id").orderBy("turn")
        return c.select(
            ((F.lit(EPOCH) + F.col("conv_id") * 60_000 + F.col("turn") * 1000) * (1 << ORDINAL_BITS)).alias("id"), file_id.alias("source_file_id"), "session_id", self.agent_of(file_id).alias("agent"),
            (F.row_number().over(w) - 1).alias("seq"), F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("source_key"), "role",
            (F.lit(EPOCH) + F.col("conv_id") * 60_000 + F.col("turn") * 1000).alias("ts"), F.coalesce("text", F.lit("")).alias("prose"), F.length("text").alias("char_count"),
            F.coalesce(F.length("text") % 11 == 0, F.lit(False)).alias("has_error"), (F.col("turn") % 5 == 4).alias("is_sidechain"),
        )

    def message_text(self) -> DataFrame:
        """Ids and texts alone, without the turns' numbering."""
        return self.raw("conversations").select(((F.lit(EPOCH) + F.col("conv_id") * 60_000 + F.col("turn") * 1000) * (1 << ORDINAL_BITS)).alias("id"), F.coalesce("text", F.lit("")).alias("prose"))

    def session(self) -> DataFrame:
        user = (F.col("role") == "user") & (F.col("prose") != "")
        return self.message().groupBy(F.col("session_id").alias("id"), "source_file_id", "agent").agg(
            F.min("ts").alias("started_at"), F.max("ts").alias("last_activity_at"), F.count("*").alias("message_count"), F.bool_or("has_error").alias("had_error"),
            F.min_by(preview(F.col("prose")), F.when(user, F.col("seq"))).alias("first_user_message"),
        ).select("*", F.pmod("source_file_id", F.lit(7)).alias("project_id"), F.concat(F.lit("conv-"), F.col("id").cast("string")).alias("external_id"), F.lit(None).cast("string").alias("generated_title"), F.lit(None).cast("string").alias("title"))

    def file_ids(self) -> DataFrame:
        return self.raw("conversations").select(F.floor(F.col("conv_id") / 10).alias("id")).distinct()

    def source_file(self) -> DataFrame:
        a = self.agent_of(F.col("id"))
        return self.file_ids().select("id", (F.pmod("id", F.lit(4)) + 1).alias("root_id"), a.alias("agent"), F.concat(F.lit("/logs/"), a, F.lit("/f"), F.col("id").cast("string"), F.lit(".jsonl")).alias("path"), F.when(F.col("id") % 5 == 0, "unreadable").alias("last_error"))

    def adapter_health(self) -> DataFrame:
        return self.file_ids().where("id % 3 <> 0").select(F.col("id").alias("source_file_id"), (F.lit(EPOCH) + F.col("id")).alias("last_success_ms"), F.when(F.col("id") % 6 == 1, "bad line").alias("last_error"))

    def scan_error(self) -> DataFrame:
        return self.file_ids().where("id % 4 < 2 and id % 8 < 5").select("id", (F.pmod("id", F.lit(4)) + 1).alias("root_id"), F.concat(F.lit("sub"), F.col("id").cast("string")).alias("relative_scope"), F.lit("permission denied").alias("error"))

    def project(self) -> DataFrame:
        return self.file_ids().select(F.pmod("id", F.lit(7)).alias("id")).distinct().select("id", F.concat(F.lit("/work/proj"), F.col("id").cast("string")).alias("canonical_key"), F.concat(F.lit("Proj"), F.col("id").cast("string")).alias("display_name"))

    def failure(self) -> DataFrame:
        return self.message().where("has_error and seq % 2 = 0").select("session_id", "source_key", "ts", F.lit("tool").alias("kind"), preview(F.col("prose"), 40).alias("detail"))

    def observations(self) -> DataFrame:
        e = self.raw("events")
        k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("none"))
        cents = F.floor(F.col("value") * 100).cast("bigint")
        return e.select(
            F.col("event_id").alias("id"), F.pmod("user_id", F.lit(50)).alias("source_file_id"), F.col("event_id").cast("string").alias("source_key"), F.element_at(F.array(*[F.lit(a) for a in SUPPORTED]), (F.pmod("user_id", F.lit(3)) + 1).cast("int")).alias("agent"),
            F.concat_ws(":", F.col("user_id").cast("string"), k).alias("dedupe_key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.pmod("user_id", F.lit(7)).alias("project_id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("model"),
            (F.col("event_id") % 4 == 0).alias("is_sidechain"), (F.col("event_id") % 1000).alias("input_tokens"), F.when(F.col("event_id") % 10 != 0, cents).alias("output_tokens"),
            F.when(F.col("event_type") != "purchase", F.col("event_id") % 7).alias("cache_write_tokens"), (F.col("event_id") % 300).alias("cache_read_tokens"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 50).alias("reasoning_tokens"),
        )

    def usage_project(self) -> DataFrame:
        return self.spark.range(7).select("id", F.concat(F.lit("Proj"), F.col("id").cast("string")).alias("display_name"))

    def rates(self) -> DataFrame:
        from ..sources.side_files import RATE_SCHEMA

        cols = [c.strip().split(" ")[0] for c in RATE_SCHEMA.replace("decimal(12,6)", "decimal").split(",")]
        raw = self.spark.createDataFrame([(*r, None) for r in RATES], "model_pattern string, a string, b string, c string, d string, e string, input_includes_cache_reads boolean, unmetered boolean, note string")
        return raw.select("model_pattern", *[F.col(x).cast("decimal(12,6)").alias(n) for x, n in zip("abcde", cols[1:6], strict=True)], "input_includes_cache_reads", "unmetered", "note")
