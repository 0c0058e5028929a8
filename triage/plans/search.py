"""Search for members by parts of their names and addresses without reading all members."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triage.functions.text import full_name, trim_all
from triage.operators.joins import IdSet
from triage.operators.staging import of_tenant
from triage.schemas import schema_of
from triage.sources.store import VersionedTable

GRAM = 3
# Grams of a term that are looked up: its rarest ones. The rest is settled by looking at the texts.
PROBES = 3
# Members whose texts one task cuts: a small file holds many, and each makes some hundred postings.
MEMBERS_A_TASK = 10_000
POSTINGS = schema_of("gram string not null, member_id bigint not null")
COUNTS = schema_of("gram string not null, members bigint")
PROFILES = schema_of("member_id bigint not null, first_name string, last_name string, email_address string, network_role string, "
                     "join_date timestamp_ntz")


def _cut(text: Column, length: int) -> Column:
    """All parts of a text that have the length."""
    last = F.length(text) - (length - 1)
    parts = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(length)))
    return F.when(last >= 1, parts).otherwise(F.array().cast("array<string>"))


def grams(text: Column) -> Column:
    """What a text is found by: its parts of one to GRAM characters, and the empty one."""
    low = F.lower(text)
    cut = [F.array(F.lit(""))] + [_cut(low, n) for n in range(1, GRAM + 1)]
    return F.when(text.isNotNull(), F.array_distinct(F.concat(*cut))).otherwise(F.array().cast("array<string>"))


def asked(term: Column) -> Column:
    """Grams that every match of a term holds. ``%`` and ``_`` are wildcards, so only what is between them
    counts: parts of GRAM characters, of shorter runs the whole; of no run at all the empty gram."""
    runs = F.filter(F.split(F.lower(term), "[%_]"), lambda r: r != "")
    parts = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) >= GRAM, _cut(r, GRAM)).otherwise(F.array(r))))
    return F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(F.array_distinct(parts))


class MemberIndex:
    """Postings by gram and profiles by member, each in hash buckets of its key.

    A batch of terms opens the buckets of its rarest grams, intersects their postings, opens the buckets of
    the members left and looks for the term in their texts; so nothing is found that a scan would not find,
    and nothing is missed.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root = spark, root.rstrip("/")
        self.postings = VersionedTable(spark, f"{root}/postings", POSTINGS, buckets=buckets, key="gram")
        self.counts = VersionedTable(spark, f"{root}/counts", COUNTS, buckets=buckets, key="gram")
        self.profiles = VersionedTable(spark, f"{root}/profiles", PROFILES, buckets=buckets, key="member_id")

    def build(self, core_members: DataFrame, tenant: str) -> None:
        """Index the active members of a tenant, who have one row each."""
        active = of_tenant(core_members, tenant).filter((F.lower("member_status") == "active") & F.col("member_id").isNotNull())
        self.profiles.replace(active.select(*PROFILES.names))
        name = full_name(F.col("first_name"), F.col("last_name"))
        found = F.array_union(grams(name), grams(F.col("email_address")))
        texts = active.select("member_id", "first_name", "last_name", "email_address")
        dealt = texts.repartition(1 + self.profiles.read().count() // MEMBERS_A_TASK, "member_id")
        self.postings.replace(dealt.select(F.explode(found).alias("gram"), "member_id"))
        self.counts.replace(self.postings.read().groupBy("gram").agg(F.count("*").alias("members")))

    def search(self, terms: DataFrame, coaches: IdSet, limit: int = 20) -> DataFrame:
        """First ``limit`` members for each ``term`` whose name or address holds it; coaches are left out.

        Probes and candidates are asked for their buckets, counted and joined, so each is found once and stored.
        """
        wanted = terms.select("term").filter("term is not null").distinct().withColumn("gram", F.explode(asked(F.col("term"))))
        wanted = self._stored(wanted)
        probes = self._stored(self._rarest(wanted))
        held = self.postings.read_keys(probes.select("gram").distinct()).join(probes, "gram")
        full = held.groupBy("term", "member_id", "probes").agg(F.count("*").alias("hits")).filter("hits = probes")
        candidates = self._stored(full.join(coaches.side.toDF("member_id"), "member_id", "left_anti").select("term", "member_id"))
        people = self.profiles.read_keys(candidates.select("member_id").distinct())
        name = full_name(F.col("first_name"), F.col("last_name"))
        pattern = F.concat(F.lit("%"), F.replace(F.lower("term"), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
        hits = candidates.join(people, "member_id").filter(F.like(F.lower(name), pattern) | F.like(F.lower("email_address"), pattern))
        order = Window.partitionBy("term").orderBy(F.col("last_name").asc_nulls_first(), F.col("first_name").asc_nulls_first(), "member_id")
        first = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
        return first.select("term", "place", "member_id", trim_all(name).alias("full_name"), "email_address", "network_role", "join_date")

    def _stored(self, rows: DataFrame) -> DataFrame:
        path = f"{self.root}/searches/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _rarest(self, wanted: DataFrame) -> DataFrame:
        """(term, gram, probes): the rarest grams of each term; a term with a gram nobody has finds nobody."""
        sizes = self.counts.read_keys(wanted.select("gram").distinct())
        sized = wanted.join(sizes, "gram", "left").withColumn("members", F.coalesce("members", F.lit(0)))
        rank = F.row_number().over(Window.partitionBy("term").orderBy("members", "gram"))
        few = sized.withColumn("_rank", rank).filter(F.col("_rank") <= PROBES)
        return few.withColumn("probes", F.count("*").over(Window.partitionBy("term"))).select("term", "gram", "probes")
