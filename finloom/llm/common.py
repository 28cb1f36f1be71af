"""Helpers shared by the operators: table reading, staged tables, let-bindings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finloom.cluster import ship

#: Characters that separate words: space and \t \n \v \f \r.
WS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; under a local master, where none is set, a temporary one (tests)."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="finloom-shared-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held.rstrip("/")


#: Of this thread, so that two callers don't clear each other's tables.
_opened: ContextVar[list[Staging] | None] = ContextVar("opened", default=None)


@contextmanager
def staged():
    """The list of tables that are opened in the block."""
    held: list[Staging] = []
    before = _opened.set(held)
    try:
        yield held
    finally:
        _opened.reset(before)


class Staging:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    ``put`` writes and rereads a DataFrame; ``drop`` deletes what is no longer read, and
    ``clear`` all of it.  A result that is read lazily needs its tables until it is
    written: the caller that writes it within ``staged()`` may then clear what was opened there.
    """

    def __init__(self, spark: SparkSession, name: str):
        if (held := _opened.get()) is not None:
            held.append(self)
        ship(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            if path := getattr(df, "_staged_path", None):
                self._delete(path)

    def clear(self) -> None:
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


#: Ids of up to this many rows, 32 MB of them, are sent to every executor; more are joined by a shuffle.
FEW_IDS = 4_000_000


def few(ids: DataFrame) -> DataFrame:
    """``ids``, a staged table, to be sent to every executor if they are few enough."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose ``key`` is not in ``ids``, a staged table; their texts aren't shuffled while the ids are few."""
    return docs.join(few(ids), key, "left_anti").select(*docs.columns)


def text_ids(docs: DataFrame, tables: Staging, name: str = "text_id") -> DataFrame:
    """``docs`` with an id of each text: its doc_id, or a hash of both where several rows share it or it is null.

    Hashes are 2 ** 62 or more, so that among equal texts a doc_id of one row is the least.
    """
    again = tables.put(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    mixed = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    if again.isEmpty():
        return docs.withColumn(name, F.coalesce("doc_id", mixed))
    met = docs.join(few(again.withColumn("_again", F.lit(True))), "doc_id", "left")
    return met.select(*docs.columns, F.when(F.col("_again") | F.col("doc_id").isNull(), mixed).otherwise(F.col("doc_id")).alias(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    blank = F.translate(F.coalesce(text, F.lit("")), WS, " " * len(WS))
    return F.array_remove(F.split(blank, " "), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an int array, in blocks so that cost stays near linear."""

    def scan(values: Column, start: Column) -> Column:
        """Exclusive sums, with the total as last element."""
        zero = F.array(start.cast("long"))
        return F.aggregate(values, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x.cast("long"))))

    def body(v: Column) -> Column:
        blocks = F.transform(
            F.filter(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0))), lambda i: i % block == 0),
            lambda b: F.slice(v, b + 1, block),
        )

        def inner(bs: Column) -> Column:
            sums = F.transform(bs, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")))
            starts = scan(sums, F.lit(0))
            return F.flatten(
                F.transform(bs, lambda b, i: let(scan(b, F.get(starts, i)), lambda s: F.slice(s, 1, F.size(b))))
            )

        return let(blocks, inner)

    return let(lengths, body)


def cut(text: Column, spans: Column, mask: str) -> Column:
    """The text with every span of a sorted array of struct(start, end) replaced by ``mask``.

    Overlapping spans share one mask.  Spans that lie apart take one step each; only
    where some overlap, each looks at all before it.
    """

    def body(ss: Column) -> Column:
        ends = F.transform(ss, lambda s: s["end"])
        neighbour = F.transform(ss, lambda s, i: F.coalesce(F.get(ss, i - 1)["end"], F.lit(0)))
        furthest = F.transform(ss, lambda s, i: F.coalesce(F.array_max(F.slice(ends, 1, i)), F.lit(0)))
        apart = ~F.exists(F.zip_with(ss, neighbour, lambda s, b: s["start"] < b), lambda x: x)

        def joined(before: Column) -> Column:
            piece = lambda s, i: F.when(s["start"] < F.get(before, i), "").otherwise(
                F.concat(F.substr(text, (F.get(before, i) + 1).cast("int"), (s["start"] - F.get(before, i)).cast("int")), F.lit(mask))
            )
            rest = F.substr(text, (F.array_max(ends) + 1).cast("int"))
            return F.concat(F.array_join(F.transform(ss, piece), ""), rest)

        return let(F.when(apart, neighbour).otherwise(furthest), joined)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, body))
