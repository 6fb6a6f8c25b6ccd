"""Rows laid out in the order of their pages, with the bounds of each file, so that a page reads the files past its cursor."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import reads
from .state import VersionedTable


class ClusteredTable:
    """Rows in runs that are sorted by a total order, nulls first, over files of bounded size; a table of bounds names the files
    and is pointed to last, so a crash before leaves the version before. append() adds a run, rewrite() makes one run of all.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, order: Sequence[str], rows_per_file: int = 1_000_000):
        self.spark, self.path, self.order, self.rows_per_file = spark, path.rstrip("/"), list(order), rows_per_file
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        self.bounds = VersionedTable(spark, f"{self.path}/bounds")

    # --- writing

    def _run(self, df: DataFrame) -> DataFrame:
        """Writes a run; (run, name, lo, hi, n) of its files."""
        run = f"run-{uuid.uuid4().hex}"
        ranged = df.select(*self.schema.names).repartitionByRange(*self.order).sortWithinPartitions(*self.order)
        ranged.write.option("maxRecordsPerFile", self.rows_per_file).parquet(f"{self.path}/{run}")
        stored = self.spark.read.schema(self.schema).parquet(f"{self.path}/{run}").select(*self.order, F.col("_metadata.file_name").alias("name"))
        key = F.struct(*self.order)
        return stored.groupBy(F.lit(run).alias("run"), "name").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"))

    def append(self, df: DataFrame) -> None:
        """Adds rows, of whatever place in the order, as a run of their own."""
        new, old = self._run(df), self.bounds.read()
        self.bounds.write(new if old is None else old.unionByName(new))

    def rewrite(self) -> None:
        """One run of all rows; the files of earlier runs stay for their readers."""
        self.bounds.write(self._run(self.read()))

    def read(self) -> DataFrame:
        known = self.bounds.read()
        runs = sorted(r[0] for r in known.select("run").distinct().collect()) if known is not None else []
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{r}" for r in runs)) if runs else self.spark.createDataFrame([], self.schema)

    # --- pages

    def _key(self, values: Sequence) -> Column:
        """The first columns of the order with these values; structs compare column by column, null first."""
        return F.struct(*(F.lit(v).cast(self.schema[c].dataType).alias(c) for c, v in zip(self.order, values, strict=False)))

    def page(self, limit: int = reads.DEFAULT_PAGE, after: tuple | None = None, descending: bool = False, prefix: tuple = (), where: Column | None = None) -> DataFrame:
        """The next rows after a cursor, and one more if there is one, as reads.page has them: ascending nulls first or descending
        nulls last. prefix fixes the first columns of the order (a chat), the cursor holds the others. A further condition may
        drop rows, so files are taken four times as many a round until a page is full.

        Files wholly past the cursor are sure to give their rows, so those that fill the page and all that reach before
        their end are read and no others.
        """
        known = self.bounds.read()
        if known is None:
            return self.read()
        want = min(max(limit, 1), reads.MAX_PAGE) + 1
        near, far = ("hi", "lo") if descending else ("lo", "hi")
        beyond = (lambda x, y: x < y) if descending else (lambda x, y: x > y)
        within = whole = F.lit(True)
        if prefix:
            lead = lambda side: F.struct(*(F.col(f"{side}.{c}").alias(c) for c in self.order[: len(prefix)]))
            within = (lead("lo") <= self._key(prefix)) & (lead("hi") >= self._key(prefix))
            whole = lead("lo").eqNullSafe(self._key(prefix)) & lead("hi").eqNullSafe(self._key(prefix))
        if after is not None:
            cursor = self._key((*prefix, *after))
            within, whole = within & beyond(F.col(far), cursor), whole & beyond(F.col(near), cursor)
        some = known.where(within)
        by = F.col(far).desc() if descending else F.col(far).asc()
        names = [(c, descending) for c in self.order]
        take = None
        while True:
            sure = some.where(whole).orderBy(by).limit(want if take is None else take).select(far, "n").collect()
            if take is None:  # the files that fill a page; no more than its rows, as none is empty
                total = take = 0
                while total < want and take < len(sure):
                    total, take = total + sure[take]["n"], take + 1
                full = total >= want
            else:
                full = len(sure) == take
            end = self._key(tuple(sure[take - 1][far])) if full else None  # without one all files are read
            files = some if end is None else some.where(~beyond(F.col(near), end))
            paths = [f"{self.path}/{r.run}/{r.name}" for r in files.select("run", "name").collect()]
            if not paths:
                return self.spark.createDataFrame([], self.schema)
            rows = self.spark.read.schema(self.schema).parquet(*paths)
            for c, v in zip(self.order, prefix, strict=False):
                rows = rows.where(F.col(c).eqNullSafe(F.lit(v)))
            if end is not None:
                rows = rows.where(~beyond(F.struct(*self.order), end))
            if after is not None:
                rows = rows.where(beyond(F.struct(*self.order), cursor))
            got = reads.page(rows if where is None else rows.where(where), names, limit)
            if where is None or end is None or got.count() >= want:
                return got
            take *= 4
