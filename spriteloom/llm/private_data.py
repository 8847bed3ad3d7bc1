"""Personal data by bootstrapped contextual extraction (operator 4, native).

Base spans come from four patterns (e-mail, IP address, card and phone number).
They are the seed entities.  Every mention, that is every run of characters with
the loose shape of an identifier, has lexical patterns: the word before it, the two
words before it, and the word behind it.  Seeds give their patterns a confidence
for a kind: the share of the distinct values seen in that pattern that are
instances of the kind.  Confident patterns lend a score to the other values seen
in them (one minus the product of what their patterns leave open), values above
``ACCEPT`` become instances, and the graph is scored again, ``ROUNDS`` times.
Mentions of accepted values in a confident pattern are added to the spans of
their kind if their loose shape fits it; base spans always stay.

Scale.  One pass over the texts leaves a table of spans and mentions (no text);
patterns and values are counted by aggregates that combine before the shuffle,
over distinct (pattern, value) pairs, so a phrase that a third of all documents
share is one pair.  Nothing is broadcast or collected.  All expressions run in the
JVM, patterns are possessive or anchored to the start of a run, so that time stays
linear in a text of any length.

Edge cases: a null text is an empty one; ties and repeated rows (same doc_id and
text) are each reported with all their spans; a null doc_id is kept as such; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
#: Java patterns of the base spans.  A look-behind keeps a match from being tried at every character of a long run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: The loose shape of an identifier: something@something, or a run of digits with separators.
MENTION = r"(?<![^\x20\x09-\x0D,;:<>\"'(\[])[^\x20\x09-\x0D@,;:<>\"'(\[]++@[^\x20\x09-\x0D@,;:<>\"')\]]++|(?<![A-Za-z0-9.+])[+(]{0,2}[0-9](?:[\x20().:/-]{0,3}+[0-9])++"
#: What a mention must look like to be added to a kind.
SHAPES = {
    "email": r"^[^@]+@[^@]*[A-Za-z0-9]$",
    "ip": rf"^{BYTE}(?:[.:/-]{BYTE}){{3}}$",
    "card": r"^(?:[0-9][\x20./-]?){12,18}[0-9]$",
    "phone": r"^[+(]*[0-9](?:[\x20().:/-]{0,3}[0-9]){6,14}$",
}
CONFIDENT = 0.8
ACCEPT = 0.9
LEAST_VALUES = 3
ROUNDS = 3
#: Characters around a mention in which its neighbouring words are looked for.
CONTEXT = 64


def located(text: Column, pattern: str, around: bool = False) -> Column:
    """All matches in ``text`` as structs (start, end, found), in code points; with ``around`` also the texts (before, after).

    The starts are running sums of the lengths of what lies between the matches,
    taken over blocks of about the square root of their number.
    """

    def place(found: Column) -> Column:
        def with_parts(parts: Column) -> Column:
            n = F.size(found)
            lengths = F.zip_with(F.slice(F.transform(parts, lambda p: F.length(p).cast("long")), 1, n), found, lambda p, m: p + F.length(m))
            width = F.ceil(F.sqrt(n.cast("double"))).cast("int")

            def with_lengths(lens: Column) -> Column:
                def add(xs: Column) -> Column:
                    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, b: a + b)

                sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda b: add(F.slice(lens, b * width + 1, width)))

                def with_sums(block: Column) -> Column:
                    def one(i: Column) -> Column:
                        b = F.floor(i / width).cast("int")
                        end = add(F.slice(block, F.lit(1), b)) + add(F.slice(lens, b * width + 1, i - b * width + 1))
                        m = F.element_at(found, i + 1)
                        fields = [(end - F.length(m)).alias("start"), end.alias("end"), m.alias("found")]
                        if around:
                            fields += [F.right(F.element_at(parts, i + 1), F.lit(CONTEXT)).alias("before"), F.left(F.element_at(parts, i + 2), F.lit(CONTEXT)).alias("after")]
                        return F.struct(*fields)

                    return F.transform(F.sequence(F.lit(0), n - 1), one)

                return F.element_at(F.transform(F.array(sums), with_sums), 1)

            return F.element_at(F.transform(F.array(lengths), with_lengths), 1)

        parts = F.split(text, pattern, -1)
        return F.when(F.size(found) > 0, F.element_at(F.transform(F.array(parts), with_parts), 1))

    kind = "array<struct<start:bigint,end:bigint,found:string" + (",before:string,after:string>>" if around else ">>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.coalesce(F.element_at(F.transform(F.array(hits), place), 1), F.array().cast(kind))


def valid(kind: str, found: Column) -> Column:
    """Whether a match of a base pattern is a span."""
    if kind == "ip":
        return found.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(found, "[ -]", "")
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def span_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans, mentions): the base spans (start, kind number, end, value) and the mentions of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,found:string>>")
    hint = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    digit = F.regexp_instr("text", F.lit("[0-9]")) > 0

    def of_kind(k: int, kind: str) -> Column:
        found = F.filter(located(F.col("text"), PATTERNS[kind]), lambda m: valid(kind, m["found"]))
        found = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["found"].alias("found")))
        return F.when(hint.get(kind, F.col("digit")), found).otherwise(none)

    spans = [of_kind(k, kind) for k, kind in enumerate(KINDS)]
    any_hint = F.col("digit") | F.contains("text", F.lit("@"))
    mentions = F.when(any_hint, located(F.col("text"), MENTION, around=True))
    rows = rows.withColumn("digit", digit)
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.array_sort(F.concat(*spans)).alias("spans"), mentions.alias("mentions"))


def _words(m: str) -> Column:
    """The lexical patterns of a mention: word before, two words before, word behind."""
    last = F.regexp_extract(F.lower(F.col(f"{m}.before")), r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    two = F.regexp_extract(F.lower(F.col(f"{m}.before")), r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    behind = F.regexp_extract(F.lower(F.col(f"{m}.after")), r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)
    made = F.array(F.concat(F.lit("< "), last), F.concat(F.lit("<< "), F.regexp_replace(two, r"[\x20\x09-\x0D]+", " ")), F.concat(F.lit("> "), behind))
    return F.filter(made, lambda p: F.length(p) > 3)


def discover(table: DataFrame, confident: float = CONFIDENT, accept: float = ACCEPT, least_values: int = LEAST_VALUES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_hash, start, kind, end) of mentions that the pattern graph accepts beside the base spans."""
    # a mention's kind is that of the base span that reaches furthest of those that begin before its end: one running maximum per text
    spans = table.select("doc_id", "text_hash", F.explode("spans").alias("s")).select("doc_id", "text_hash", F.col("s.start").alias("at"), F.lit(1).alias("late"), F.struct(F.col("s.end").alias("end"), F.col("s.kind").alias("kind")).alias("span"), F.lit(None).cast(table.schema["mentions"].dataType.elementType).alias("m"))
    mentions = table.select("doc_id", "text_hash", F.explode("mentions").alias("m")).select("doc_id", "text_hash", F.col("m.end").alias("at"), F.lit(0).alias("late"), F.lit(None).cast("struct<end:bigint,kind:int>").alias("span"), "m")
    so_far = Window.partitionBy("doc_id", "text_hash").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    flat = spans.union(mentions).withColumn("over", F.max("span").over(so_far)).where("m is not null")
    flat = flat.select("doc_id", "text_hash", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.found").alias("value"), _words("m").alias("patterns"), F.when(F.col("over.end") > F.col("m.start"), F.col("over.kind")).alias("kind"))
    flat = materialize(flat, "pii-mentions")
    # the graph: distinct (pattern, value), and the kind of the values that are seeds
    graph = flat.select("value", F.explode("patterns").alias("pattern")).distinct()
    graph = materialize(graph, "pii-graph")
    known = flat.where("kind is not null").groupBy("value").agg(F.min("kind").alias("kind"))
    free = flat.where("kind is null").select("value").distinct()
    fits = reduce(lambda a, b: a.union(b), [free.where(F.col("value").rlike(SHAPES[kind])).select("value", F.lit(k).alias("kind")) for k, kind in enumerate(KINDS)])
    values = graph.groupBy("pattern").agg(F.count("*").alias("n_values")).where(F.col("n_values") >= least_values)
    patterns = None
    for _ in range(rounds):
        per_kind = graph.join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("n_known")).where(F.col("n_known") >= least_values)
        patterns = per_kind.join(values, "pattern").withColumn("confidence", F.col("n_known") / F.col("n_values")).where(F.col("confidence") >= confident)
        patterns = materialize(patterns.select("pattern", "kind", "confidence"), "pii-patterns")
        if patterns.limit(1).count() == 0:
            break
        left_open = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        scored = graph.join(patterns, "pattern").join(fits, ["value", "kind"]).groupBy("value", "kind").agg((1 - F.exp(left_open)).alias("score"))
        best = scored.where(F.col("score") >= accept).groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        grown = materialize(known.union(best.join(known, "value", "left_anti").select("value", "kind")), "pii-known")
        if best.join(known, "value", "left_anti").limit(1).count() == 0:
            break
        known = grown
    seen = flat.where("kind is null").select("doc_id", "text_hash", "start", "end", "value", "patterns")
    taken = seen.join(known, "value").withColumn("pattern", F.explode("patterns")).join(patterns, ["pattern", "kind"], "left_semi")
    return taken.select("doc_id", "text_hash", "start", "kind", "end").distinct()


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_private_data(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) for every row of ``docs``.

    The counts and the digest are those of the base spans; ``spans`` lists all
    spans, ``n_found`` says how many of them the pattern graph added.
    """
    table = materialize(span_table(docs), "pii-spans")
    more = discover(table, **parameters)
    more = more.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))
    rows = table.join(more, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    extra = F.coalesce("more", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    digest = F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256")
    return rows.select("doc_id", *counts, digest, _joined(F.array_sort(F.concat(base, extra))).alias("spans"), F.size(extra).cast("long").alias("n_found"))
