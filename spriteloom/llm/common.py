"""Shared pieces of the training-data operators.

* ``table`` reads one of the corpus tables.
* ``materialize`` cuts lineage by writing a table into the shared folder the
  cluster names in ``spark.checkpoint.dir``; a lost executor then costs a read,
  never a recomputation of the whole job.
* ``connected_components`` is a distributed union-find (alternating large-star
  and small-star rounds); neither links nor labels ever reach the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The ASCII white space that separates words everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir``, or where it is unset
    a fresh folder in local mode and the warehouse on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.conf.get("spark.master", "local").split("[")[0] == "local":
        found = "file://" + tempfile.mkdtemp(prefix="spriteloom-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Under this setting a query's shuffle files go when the query ends, not when the driver's garbage collection finds them.
SHORT_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    What was shuffled for it is deleted with the end of the write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHORT_SHUFFLES, None)
    spark.conf.set(SHORT_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHORT_SHUFFLES)
        else:
            spark.conf.set(SHORT_SHUFFLES, before)
    written = _written.get()
    if written is not None:
        written.append((name, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: (name, path) of the tables that ``materialize`` wrote in the innermost ``scratch`` of this thread.
_written: ContextVar[list[tuple[str, str]] | None] = ContextVar("written", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(stored: DataFrame) -> None:
    """Deletes a materialized table that no later plan reads."""
    _delete(stored.sparkSession, stored._scratch)


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Deletes at its end what was materialized inside, but for the tables named ``keep``, which the caller's lazy result still reads."""
    outer, token = _written.get(), _written.set([])
    try:
        yield
        inner = _written.get()
    finally:
        _written.reset(token)
    for name, path in inner:
        if name not in keep:
            _delete(spark, path)
        elif outer is not None:
            outer.append((name, path))


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node named in ``links``; root is the smallest node reachable.

    Nodes may be of any orderable type.  Self-links keep a node alone in its
    component; null ends are ignored.  Each round aggregates a minimum per node
    (combined before the shuffle) and joins it back, so a hub with a third of
    all nodes is one hot join key, which adaptive execution splits.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = ends.select("u").union(ends.select("v")).distinct()
    edges = ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "cc-links")
    state = None
    for _ in range(max_rounds):
        # large-star: all larger neighbours of u hang on the smallest one around u
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        before, edges = edges, materialize(small, "cc-round")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if state == now or now[0] == 0:
            break
        if now[0] == now[2]:  # every node hangs on one root: done once no root hangs on another
            if edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0:
                break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(edges, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("root"))


def unused(df: DataFrame) -> str:
    """A beginning of names that no column of ``df`` has."""
    tag = "_"
    while any(c.lower().startswith(tag) for c in df.columns):
        tag += "_"
    return tag


def cut_lines(docs: DataFrame, cut: str) -> DataFrame:
    """``docs`` with the lines of ``text`` cut out whose numbers are in the sorted array column ``cut`` (null: none).

    ``n_chars``, if there is such a column, follows the new text.
    """
    # the kept runs of lines lie between the removed ones: cut there instead of asking for each line
    parts = F.split("text", "\n")
    edges = F.concat(F.array(F.lit(-1).cast("long")), F.col(cut), F.array(F.size(parts).cast("long")))

    def kept(parts: Column, edges: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda k: F.slice(parts, (F.element_at(edges, k) + 2).cast("int"), F.greatest(F.lit(0), F.element_at(edges, k + 1) - F.element_at(edges, k) - 1).cast("int")))
        return F.array_join(F.flatten(runs), "\n")

    # bound once per row, not once per run
    once = F.element_at(F.transform(F.array(F.struct(parts.alias("p"), edges.alias("e"))), lambda x: kept(x["p"], x["e"])), 1)
    whole = F.col(cut).isNull()
    out = docs.withColumn("text", F.when(whole, F.col("text")).otherwise(once))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def with_rows(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number of its own for every row, so that rows are told apart whatever their ids and texts.

    The rows of a plain reading of files are numbered by their file and their place
    in it, which every later reading repeats; any other ``docs`` is stored with its numbers.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or "_metadata" in (c.lower() for c in docs.columns):
        return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    path, place, number, known = (f"{name}_{k}" for k in ("path", "place", "number", "known"))
    files = docs.select(F.col("_metadata.file_path").alias(known)).distinct()
    # one row a file, numbered in the order of their paths
    files = materialize(files.select(known, F.row_number().over(Window.orderBy(known)).cast("long").alias(number)), "rows")
    if files.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        files = F.broadcast(files)
    placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    rows = placed.join(files, F.col(path) == F.col(known))
    return rows.withColumn(name, F.col(number) * F.lit(ROWS_PER_FILE) + F.col(place)).drop(path, place, known, number)


#: Rows of a file have numbers below this.
ROWS_PER_FILE = 1 << 38
#: Row keys up to this number may be broadcast (about 50 bytes each).
BROADCAST_KEYS = 500_000


def without(docs: DataFrame, keys: DataFrame, on: dict[str, object]) -> DataFrame:
    """The rows of ``docs`` that match no row of ``keys``; ``on`` gives, for each column of ``keys``, the expression over ``docs``.

    Nulls match nulls.  The keys are stored first and broadcast if their number
    is checked to be small; otherwise both sides are shuffled.
    """
    keys = materialize(keys.distinct(), "keys")
    tag = unused(docs)
    docs = docs.withColumns({f"{tag}_key_{c}": e for c, e in on.items()})
    keys = keys.select([F.col(c).alias(f"{tag}_match_{c}") for c in on])
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    same = None
    for c in on:
        one = docs[f"{tag}_key_{c}"].eqNullSafe(keys[f"{tag}_match_{c}"])
        same = one if same is None else same & one
    return docs.join(keys, same, "left_anti").drop(*[f"{tag}_key_{c}" for c in on])


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's calibration: (a, b) so that 1 / (1 + exp(-(a z + b))) fits labels 0/1.

    Damped Newton steps on smoothed targets, with a weak pull towards (1, 0) that
    keeps separable data from running off.
    """
    n, positives = float(len(y)), y.sum()
    return platt_by(lambda at: platt_moments(z, y, at, n, positives))


def platt_moments(z: np.ndarray, y: np.ndarray, at: np.ndarray, n: float, positives: float) -> np.ndarray:
    """What these rows, of ``n`` with ``positives`` of them, add to the gradient and the second derivatives at (a, b)."""
    target = np.where(y > 0, (positives + 1) / (positives + 2), 1 / (n - positives + 2))
    q = 1 / (1 + np.exp(-np.clip(at[0] * z + at[1], -40, 40)))
    w = q * (1 - q)
    return np.array([((q - target) * z).sum(), (q - target).sum(), (w * z * z).sum(), (w * z).sum(), w.sum()])


def platt_by(moments: Callable[[np.ndarray], np.ndarray]) -> tuple[float, float]:
    """Platt's calibration from the moments of all rows at any (a, b)."""
    at = np.array([1.0, 0.0])
    for _ in range(200):
        m, pull = moments(at), 0.05
        g = m[:2] + pull * (at - [1, 0])
        h = np.array([[m[2], m[3]], [m[3], m[4]]]) + pull * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(at[0]), 1e-3), float(at[1])


def bounded_sample(df: DataFrame, by: list[str], most: int, seed: int) -> DataFrame:
    """At most ``most`` rows, the first in the order of a seeded hash of ``by``.

    A first cut by the hash leaves about half as many more, so that what tasks send
    to the driver stays bounded in all, not per task.
    """
    order, n = F.xxhash64(F.lit(seed), *by), df.count()
    if n > 2 * most:
        df = df.where(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * (1.5 * most + 100) / n))
    return df.orderBy(order, *by).limit(most)
