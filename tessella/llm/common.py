"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null id wherever ids are compared; below every real id.
NULL_ID = -(2**63)
#: Bytes after which a batch of rows for a Python worker is closed.
BATCH_BYTES = 2 << 20
#: Bits of a ``sieve`` (a power of two), 2 MB.
SIEVE_BITS = 1 << 24
#: Temporary folders of applications without a shared one.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="tessella-")
        path = _own[app]
    return path.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of a batch that goes to a Python worker, so that neither side holds thousands of long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and the rows survive lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_id(column: str) -> Column:
    """The id as a long, for joins and ordering: null has a value of its own, and an id that is no number is hashed."""
    hashed = F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column).cast("string")))
    return F.coalesce(F.col(column).try_cast("long"), hashed, F.lit(NULL_ID))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that working columns beside it clash with none of them, whatever their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def sieve(rows: DataFrame, hashed: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``, which is false only where ``hashed`` is none of the longs ``h`` of ``wanted``.

    A bit map of ``SIEVE_BITS`` bits at most is broadcast, whatever the size of
    ``wanted``. It sorts out; who needs certainty joins the rows that pass.
    """
    bit = lambda h: h.bitwiseAND(F.lit(SIEVE_BITS - 1))
    slot = lambda h: F.shiftright(bit(h), 6)
    place = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    h = F.col("h")
    slots = wanted.groupBy(slot(h).alias("_slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place(h))).alias("_bits"))
    met = rows.withColumns({"_h": hashed}).withColumn("_slot", slot(F.col("_h"))).join(F.broadcast(written(slots, "sieve")), "_slot", "left")
    return met.withColumn("_maybe", F.coalesce(F.bit_get("_bits", place(F.col("_h"))) == 1, F.lit(False))).drop("_slot", "_bits", "_h")


def neighbours(df: DataFrame, order: list[Column], carry: list[str]) -> DataFrame:
    """``df`` with ``_prev`` and ``_next``: structs of ``carry`` from the rows before and after in one global order.

    The rows are range-partitioned, so that a window runs inside each range
    and no task holds more than its share, whatever the keys are. Only the
    rows at the ends of the ranges (two for each partition) then meet in one
    window. The first row has a null ``_prev`` and the last a null ``_next``.
    ``order`` should have no ties; among ties the order is arbitrary.
    """
    inside, whole = Window.partitionBy("_p").orderBy(*order), Window.orderBy("_p", *order)
    row = F.struct(*carry)
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    table = written(ranged.withColumns({"_prev": F.lag(row).over(inside), "_next": F.lead(row).over(inside)}), "ordered")
    at_end = F.col("_prev").isNull() | F.col("_next").isNull()
    ends = table.where(at_end).withColumns(
        {"_before": F.lag(row).over(whole), "_after": F.lead(row).over(whole)}
    ).withColumns({"_prev": F.coalesce("_prev", "_before"), "_next": F.coalesce("_next", "_after")})
    return table.where(~at_end).unionByName(ends.drop("_before", "_after")).drop("_p")


def bounded_sample(df: DataFrame, id_col: str, size: int) -> DataFrame:
    """At most ``size`` rows, those with the smallest id hashes. Only about twice as many ever travel, however large ``df`` is."""
    grain = 1 << 30
    share = min(1.0, (2 * size + 50) / max(1, df.count()))
    lot = F.xxhash64(id_col)
    return df.where(F.pmod(lot, F.lit(grain)) <= int(share * grain)).orderBy(F.pmod(lot, F.lit(grain)), id_col).limit(size)
