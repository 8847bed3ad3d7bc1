"""Quality rules by cross-document line frequency (operator 5).

Lines are normalised (lower case, runs of digits become 0, white space collapses)
and hashed.  For every host the number of distinct documents that hold a line is
counted; a line above the limit is removed from every document of that host but
the first one (smallest doc_id), and a document that loses too much is depleted
and rejected.  Beside it stand the per-document base rules of ``base_metrics``.

Exact copies of a text count as one document: copies are the business of the
near-duplicate operators, and a page that exists twice does not make its lines
boilerplate.  The limit is ``max(least_docs, share * distinct documents of the
host)``, with a floor of a few documents, so it holds on small hosts and keeps its
meaning when the corpus grows.

Scale.  Only (host, line hash, text hash, counts) rows are shuffled, pre-combined
per task; the distinct count is a two-step aggregate keyed by (host, line, text)
first, so a line that a third of all documents share is spread over its texts.
The lines above the limit are broadcast when their number is checked to be small
and joined otherwise.  The base rules run where a text is read.

Edge cases: a null or empty text has no words and fails the base rules; a null
host is a host of its own; blank lines are never counted; a line repeated within
a document counts once for the frequency and with all its words for the loss;
repeated rows (same doc_id and text) get the same verdict; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut_lines, materialize, scratch, unused


#: A line that no more texts of a host than this have is never frequent; a few, so that small hosts have frequent lines too.
LEAST_DOCS = 4
SHARE = 0.01
#: A document is depleted if it keeps fewer words than this or less than this part of them.
KEEP_WORDS = 20
KEEP_PART = 0.4
BROADCAST_LINES = 200_000
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def repeated_window_words(words: list[bytes], size: int = WINDOW) -> int:
    """Number of words that lie in a window of ``size`` words found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    # exact ranks of windows by doubling: no hash, so no collision
    rank = ids
    width = 1
    while width < size:
        step = min(width, size - width)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width += step
    often = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(often):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, often, 1)
    np.add.at(edge, often + size, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def text_metrics(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(" \t\r\x0b\x0c")]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_window_words(words)


def base_metrics(docs: DataFrame) -> DataFrame:
    """(doc_id, host, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), a row for every row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_metrics(t.as_py()) for t in batch.column(3)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(found[:, k]) for k in range(len(names)))], names=["doc_id", "host", "text_hash", *names])

    return _rows(docs).select("doc_id", "host", "text_hash", "text").mapInArrow(kernel, "doc_id long, host string, text_hash long, " + ", ".join(f"{n} long" for n in names))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, host, text_hash, pos, line, words): the normalised lines of each document and their numbers from 0; line is a hash."""
    lines = _rows(docs).select("doc_id", "host", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower("line"), "[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))
    lines = lines.where(F.trim(F.translate("line", "\t\r\x0b\x0c", "    ")) != "").withColumn("line", clean)
    return lines.select("doc_id", "host", "text_hash", "pos", F.xxhash64("line").alias("line"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"))


def line_loss(docs: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """(__id, __host, __hash, lost_words, lost_lines, cut) of the documents that hold lines above their host's limit; cut has the lines' numbers."""
    lines = materialize(line_table(docs), "line-table")
    per_text = lines.groupBy("host", "line", "text_hash").agg(F.min("doc_id").alias("first"))
    counts = per_text.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.min("first").alias("first"))
    hosts = lines.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs"))
    hosts = hosts.withColumnRenamed("host", "__host")
    high = counts.where(F.col("n_docs") > least_docs).join(hosts, F.col("host").eqNullSafe(F.col("__host")))
    high = high.where(F.col("n_docs") > F.greatest(F.lit(float(least_docs)), share * F.col("host_docs")))
    high = materialize(high.select("__host", F.col("line").alias("__line"), F.col("first").alias("__first")), "line-high")
    if high.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        high = F.broadcast(high)
    hit = lines.join(high, F.col("host").eqNullSafe(F.col("__host")) & (F.col("line") == F.col("__line"))).where(~F.col("doc_id").eqNullSafe(F.col("__first")))
    lost = hit.groupBy("doc_id", "host", "text_hash").agg(F.sum("words").alias("lost_words"), F.count("*").alias("lost_lines"), F.array_sort(F.collect_set(F.col("pos").cast("long"))).alias("cut"))
    return lost.select(F.col("doc_id").alias("__id"), F.col("host").alias("__host"), F.col("text_hash").alias("__hash"), "lost_words", "lost_lines", "cut")


def _text_verdicts(docs: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE, keep_words: int = KEEP_WORDS, keep_part: float = KEEP_PART) -> DataFrame:
    """A row for every different (doc_id, host, text_hash), with the number of its copies and the lines to cut (null: none)."""
    base = base_metrics(docs)
    loss = line_loss(docs, least_docs, share)
    # repeated rows (same doc_id and text) add up their lines in ``loss``: divided by their number below
    again = base.groupBy("doc_id", "host", "text_hash").agg(*[F.first(c).alias(c) for c in base.columns[3:]], F.count("*").alias("copies"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("host").eqNullSafe(F.col("__host")) & (F.col("text_hash") == F.col("__hash"))
    lost = lambda c: F.coalesce(F.floor(F.col(c) / F.col("copies")), F.lit(0)).cast("long")
    out = again.join(loss, on, "left").select(*base.columns, "copies", lost("lost_words").alias("lost_words"), lost("lost_lines").alias("lost_lines"), "cut")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("lost_words")
    depleted = (F.col("lost_words") > 0) & ((left < keep_words) | (left < keep_part * F.col("n_words")))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def quality_verdicts(docs: DataFrame, **limits) -> DataFrame:
    """The base metrics of every row of ``docs``, its losses, and whether it is kept.

    ``limits``: least_docs, share, keep_words, keep_part.
    """
    out = _text_verdicts(docs, **limits)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy", "text_hash", "cut")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that pass, their texts without the lines above the limit; ``n_chars``, if there, follows.

    The first document of a host that has such a line keeps it.
    """
    tag = unused(docs)
    names = {c: f"{tag}_{c}" for c in ("doc_id", "host", "text_hash", "kept", "cut")}
    with scratch(docs.sparkSession, "quality-marked"):
        marked = _text_verdicts(docs, **limits).where("not kept or cut is not null")
        marked = materialize(marked.select([F.col(c).alias(n) for c, n in names.items()]), "quality-marked")
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(names["doc_id"])) & F.col("source").cast("string").eqNullSafe(F.col(names["host"])) & (text_hash == F.col(names["text_hash"]))
    out = docs.join(marked, on, "left").where(F.coalesce(F.col(names["kept"]), F.lit(True)))
    return cut_lines(out, names["cut"]).select(docs.columns)
