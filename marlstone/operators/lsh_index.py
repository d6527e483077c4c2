"""An index of MinHash signatures that is kept: bands and signatures as bucketed tables, to which rows are added.

The bands are clustered by their hash and the signatures by key, into a fixed number of buckets.  A probe is an equi-join
on what the tables are clustered by, so the index is read in place and only the queries' bands, and the pairs that come of
them, are shuffled.  The tables lie in a folder and can be opened again by another session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.lineage import cut
from marlstone.operators.similarity import bands, signature_similarity


class LshIndex:
    """name: of the tables, name_bands and name_signatures; path: the folder that they are in, one for each index.

    buckets should give parts of a few hundred megabytes at the size that the index will grow to, since it stays.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, threshold: float = 0.5, k: int = 128, buckets: int = 64, key: str = "bigint"):
        self.spark, self.name, self.threshold, self.k, self.buckets = spark, name, threshold, k, buckets
        for table, columns, by in (("bands", f"band BIGINT, key {key}", "band"), ("signatures", f"key {key}, signature ARRAY<BIGINT>", "key")):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_{table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}/{table}'")

    def _table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    def insert(self, rows: DataFrame) -> None:
        """rows: (key, signature); keys that the index has are left as they are, null signatures (empty sets) are not kept.

        Signatures are written last: an insert that was lost half-way is made good by inserting the same rows again, and
        a band that stands twice by then gives no pair twice.
        """
        new = rows.where("signature IS NOT NULL").select("key", "signature").dropDuplicates(["key"])
        new = cut(new.join(self._table("signatures").select("key"), "key", "left_anti"))
        split = new.select(F.explode(bands("signature", self.threshold, self.k)).alias("band"), "key")
        split.repartition(self.buckets, "band").sortWithinPartitions("band").write.insertInto(f"{self.name}_bands")
        new.repartition(self.buckets, "key").sortWithinPartitions("key").write.insertInto(f"{self.name}_signatures")

    def probe(self, queries: DataFrame) -> DataFrame:
        """queries: (key, signature).  (query, hit, estimate): the index's rows of other keys that agree on a whole band."""
        asked = queries.where("signature IS NOT NULL").select(F.col("key").alias("query"), F.explode(bands("signature", self.threshold, self.k)).alias("band"))
        met = asked.join(self._table("bands").select("band", F.col("key").alias("hit")), "band").where("query <> hit").select("query", "hit").distinct()
        pairs = met.join(self._table("signatures").select(F.col("key").alias("hit"), F.col("signature").alias("theirs")), "hit")
        pairs = pairs.join(queries.select(F.col("key").alias("query"), F.col("signature").alias("own")), "query")
        return pairs.select("query", "hit", signature_similarity(F.col("own"), F.col("theirs")).alias("estimate"))

    def drop(self) -> None:
        """Forgets the tables; their files stay and can be opened again."""
        for table in ("bands", "signatures"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
