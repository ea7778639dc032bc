"""The canonical tables of a memory: one DataFrame a record type, each keyed by its codebook (column ``g``).

Absent text is the empty string inside (an empty ``conf`` ranks as med, an empty ``t`` falls back to the session date);
absent lists are empty. Rows delivered twice count once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.functions.symbols import norm_code
from engramma.session import table

LISTS = ("topics", "entities", "src", "obj", "place", "event")
NAMES = ("fact", "line", "unit", "topic", "edge", "entity", "alias", "speaker")


def strings(name: str) -> F.Column:
    """A list column without nulls; an absent list is empty."""
    return F.coalesce(F.filter(name, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def fact_time(t: F.Column) -> F.Column:
    """A real ``YYYY-MM`` or ``YYYY-MM-DD``, else the empty string (null too)."""
    month = t.rlike(r"^\d{4}-\d{2}$") & F.try_to_date(F.concat(t, F.lit("-01")), "yyyy-MM-dd").isNotNull()
    day = t.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(t, "yyyy-MM-dd").isNotNull()
    return F.when(month | day, t).otherwise("")


def facts(fact: DataFrame) -> DataFrame:
    """Distinct facts with their effective date ``eff``."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    out = fact.select(F.col("codebook_id").alias("g"), "id", text("unit"), text("unit_date"), fact_time(F.col("t")).alias("t"), *[text(c) for c in ("kind", "who", "conf", "dur", "text")], *[strings(c).alias(c) for c in LISTS])
    # by key: what a query does not read is not shuffled, as it would be to compare whole rows
    return out.dropDuplicates(["g", "id"]).withColumn("eff", F.when(F.col("t") != "", F.col("t")).otherwise(F.col("unit_date")))


def lines(line: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return line.select(F.col("codebook_id").alias("g"), "id", text("unit"), text("unit_date"), "pos", text("who"), text("text")).dropDuplicates(["g", "id"])


@dataclass
class Catalog:
    """DataFrames of the records and, made on first use and kept, of what is derived from them."""

    fact: DataFrame
    line: DataFrame
    unit: DataFrame
    topic: DataFrame  # g, code, status, born
    edge: DataFrame  # g, parent, child; also to undeclared parents
    entity: DataFrame  # g, code, etype, name
    alias: DataFrame  # g, surface, code
    speaker: DataFrame  # g, who
    derived: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> Catalog:
        t = lambda n: table(spark, root, n)
        return cls.of(t("fact"), t("line"), t("unit"), t("topic"), t("entity"), t("codebook"))

    @classmethod
    def of(cls, fact: DataFrame, line: DataFrame, unit: DataFrame, topic: DataFrame, entity: DataFrame, codebook: DataFrame) -> Catalog:
        g = F.col("codebook_id").alias("g")
        empty = lambda c: F.coalesce(F.col(c), F.lit(""))
        topics = topic.where("code is not null").groupBy(g, "code").agg(F.max(empty("status")).alias("status"), F.max(empty("born")).alias("born"))
        edges = topic.where("code is not null").select(g, F.explode("parents").alias("p"), F.col("code").alias("child")).select("g", norm_code("p").alias("parent"), "child").where("parent <> ''").distinct()
        entities = entity.where("code is not null").groupBy(g, "code").agg(F.max(empty("etype")).alias("etype"), F.max(empty("name")).alias("name"))
        aliases = entity.select(g, F.explode("aliases").alias("a"), "code").select("g", norm_code("a").alias("surface"), "code").where("surface <> '' and surface <> code").distinct()
        units = unit.select(g, "id", empty("date").alias("date"), empty("t").alias("t"), empty("title").alias("title"), F.coalesce("dur_min", F.lit(0)).alias("dur_min"), F.coalesce("n_lines", F.lit(0)).alias("n_lines")).distinct()
        speakers = codebook.select(g, F.explode(F.split(F.lower("speakers"), r"\s+")).alias("who")).where("who <> ''").distinct()
        return cls(facts(fact), lines(line), units, topics, edges, entities, aliases, speakers)

    def save(self, path: str) -> None:
        """Write the canonical tables once, clustered by codebook, so that queries neither drop repeats nor read others' rows.

        Ranges of (codebook, id) keep the files even though one codebook may hold a third of all rows.
        """
        for name in NAMES:
            df = getattr(self, name)
            second = {"edge": "child", "speaker": "who", "topic": "code", "entity": "code", "alias": "code"}.get(name, "id")
            df.repartitionByRange("g", second).sortWithinPartitions("g", second).write.parquet(f"{path}/{name}.parquet")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Catalog:
        """Tables that :meth:`save` wrote."""
        return cls(*(table(spark, path, name) for name in NAMES))

    def posting(self, axis: str) -> DataFrame:
        """(g, code, id): the facts of each code of one axis."""
        one = self.fact.select("g", F.explode(axis).alias("code"), "id") if axis in LISTS else self.fact.select("g", F.col(axis).alias("code"), "id")
        return one.distinct()

    def object_bridge(self) -> DataFrame:
        """(g, entity, obj): the object classes that occur in one fact with an entity."""
        return self.fact.select("g", F.explode("entities").alias("entity"), "obj").select("g", "entity", F.explode("obj").alias("obj")).distinct()

    def entity_targets(self) -> DataFrame:
        """(g, entity, axis, code): what else reaches an entity: itself, its aliases, and its object classes."""
        known = self.entity.select("g", F.col("code").alias("entity"), F.lit("entities").alias("axis"), "code")
        said = self.alias.select("g", F.col("code").alias("entity"), F.lit("entities").alias("axis"), F.col("surface").alias("code"))
        bridge = self.object_bridge().select("g", "entity", F.lit("obj").alias("axis"), F.col("obj").alias("code"))
        return known.unionByName(said).unionByName(bridge).distinct()
