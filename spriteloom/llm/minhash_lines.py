"""Fuzzy line dedup by MinHash (operator 3, native).

A line's shingles are all its runs of ``SHINGLE`` characters, one from every place
on, whether the text has spaces or not; they make up both the signature and the
exact similarity.  The signature is a bottom-k MinHash: the first ``SKETCH`` shingles
in a fixed random order.  That order goes by the tier of a shingle's first letter
(``TIERS``, then all other characters) and by hash within a tier, so that a line with
enough shingles of the first tier need not hash the others.  A band is a run of ``RUN`` neighbours in
that sketch: two lines of similarity j share each next shingle of their union with
probability j, so a run with j ** RUN, and some run of the sketch is shared by 97 %
of the pairs at 0.8 and by over 99 % from 0.85 on.  Lines that meet are verified by
the exact Jaccard similarity of their shingle sets, links go through the distributed
union-find, and of every component the earliest line (by doc_id, then place in the
document) stays.

Not all pairs of a band are formed:

1. Every line of a band is verified against the band's smallest line only.
2. Bands of the same smallest line are one from here on; those that still hold lines of
   different components are open.  Where their lines make at most ``CROWD`` pairs, the
   parities of each pair are compared in the join of the band with itself.  Of the
   pairs that these do not exclude, every line's with its smallest and its largest
   partner are verified first, and then those that still lie between different components.
3. The lines of all other open bands are joined by prefix filtering, which is exact:
   with the shingles of a line ordered from the rarest to the most frequent one, two
   lines that reach the similarity share a shingle in their first parts, and what lies
   behind that shingle is still enough for it.  A passage that very many lines hold
   makes its shingles frequent, so lines that have nothing else in common never meet.
   Here too a few lines of each shingle come first, and other pairs follow only
   between the components that are then left.

So no link between different components of a band is lost.

Scale.  Equal lines are one line from the start (a 128-bit hash; 64 bits of it name
the line while candidates meet, and a line whose name is not its own alone is left to
exact equality).  Bands are counted by an aggregate that combines before the shuffle;
the bands that lines share are broadcast if their number is checked to be small and
joined otherwise.  Only the texts of lines that met are shuffled.  All expressions run
in the JVM.

Edge cases: null and empty texts have no lines; blank lines are never compared
and never removed; a line shorter than a shingle is one shingle; a null doc_id
sorts before all others; repeated rows are equal lines, of which the first copy
by place stays (for ``line_classes``, rows equal in doc_id and place are one and the
same line; ``drop_repeated_lines`` tells all rows apart by numbers of its own); a document whose lines all go is itself dropped by
``drop_repeated_lines``; an empty table gives an empty result; extra columns,
whatever their names, pass through ``drop_repeated_lines`` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import connected_components, cut_lines, discard, materialize, scratch, unused, with_rows

SHINGLE = 12
SKETCH = 10
RUN = 3
SIMILARITY = 0.8
#: Letters whose shingles come first in the order of the signature, and those that come next.
TIERS = ("mpcdg", "aeio")
#: Pairs of lines up to which an open band is compared pair by pair (2,048 lines); over check_l a line cost about 12 ms by prefixes, a pair about 3 us here.
CROWD = 1 << 21
#: How often a shingle's first and last line, each time in another order, are verified before the pairs that are left.
HEAD_ROUNDS = 2
#: Parts in which the bands are counted, one after another.
BAND_PARTS = 2
#: Words of 64 parities by which pairs are excluded before their sets are made (a power of two).
WORDS = 16
#: Words to which these are folded where all pairs of a band are compared: with more, the join's code is too long for the JVM to compile.
FOLDED = 8
#: Line names and bands up to this number may be broadcast (8 bytes each).
BROADCAST_LINES = 1_000_000
#: A place is doc_id * PLACE + the line's number, as one long if all ids allow it and as a decimal otherwise; a null doc_id comes before all others.
PLACE = 1 << 31
_NO_ID = str(-(1 << 63) - 1)
_SPACE = "\t\r\x0b\x0c"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once per row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles(line: Column, size: int = SHINGLE) -> Column:
    """All character shingles of a line, repeats included; a line shorter than a shingle is one."""
    return F.when(F.length(line) < size, F.array(line)).otherwise(F.regexp_extract_all(line, F.lit(rf"(?s)(?=({'.' * size})).")))


def sketch(line: Column, size: int = SHINGLE, k: int = SKETCH) -> Column:
    """The hashes of the first ``k`` shingles in the signature's order."""
    classes = [f"[{letters}]" for letters in TIERS] + [f"[^{''.join(TIERS)}]"]

    def tier(letter: str) -> Column:
        """The hashes of the shingles that begin with such a letter, which itself is left out."""
        found = F.regexp_extract_all(line, F.lit(rf"(?s){letter}(?=({'.' * (size - 1)}))"))
        return F.slice(F.sort_array(F.array_distinct(F.transform(found, lambda s: F.xxhash64(s)))), 1, k)

    def filled(low: Column, rest: list[str]) -> Column:
        if not rest:
            return low
        return F.when(F.size(low) >= k, low).otherwise(bound(F.slice(F.concat(low, tier(rest[0])), 1, k), lambda more: filled(more, rest[1:])))

    return F.when(F.length(line) < size, F.array(F.xxhash64(line))).otherwise(bound(tier(classes[0]), lambda low: filled(low, classes[1:])))


def bands(low: Column, run: int = RUN) -> Column:
    """The hashes of the runs of neighbours in a sketch; of the whole sketch if it is shorter than a run."""
    runs = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - run + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(s, i, run)))
    return bound(low, runs)


def _row(df: DataFrame) -> list[str]:
    return ["row"] if "row" in df.columns else []


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line), and row if ``docs`` has it, of the lines that are not blank; the line is stripped of white space at its ends and its runs collapse."""
    text = F.col("text").cast("string")
    # other white space than a space is rare, so it is looked for once per text
    odd = F.lit(False)
    for c in _SPACE:
        odd = odd | F.contains(text, F.lit(c))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_row(docs), text.alias("text"), odd.alias("odd"))
    flat = docs.select("doc_id", *_row(docs), "odd", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # blank lines go by their beginning, so that no line is cleaned twice
    flat = flat.where(F.ltrim("line", F.lit(" " + _SPACE)) != "")
    clean = F.trim(F.when(F.col("odd") | F.contains("line", F.lit("  ")), F.regexp_replace("line", r"[\x09-\x0D\x20]+", " ")).otherwise(F.col("line")))
    return flat.select("doc_id", *_row(docs), "pos", clean.alias("line"))


def _named(lines: DataFrame) -> DataFrame:
    """With the line's name (64 bits) and 64 more bits of its hash."""
    return lines.withColumn("id", F.xxhash64("line")).withColumn("more", F.xxhash64(F.lit(1), "line"))


def _few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is checked to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else df


def _tokens(texts: DataFrame, size: int) -> DataFrame:
    """(columns of ``texts`` but the line, token): the hashes of each line's distinct shingles."""
    others = [c for c in texts.columns if c != "line"]
    return texts.select(*others, F.explode(F.array_distinct(shingles(F.col("line"), size))).alias("shingle")).select(*others, F.xxhash64("shingle").alias("token"))


def _parities(texts: DataFrame, size: int) -> DataFrame:
    """(id, n, p0 ...): the number of a line's shingles, and for each bit of ``WORDS`` words whether an odd number of them fall on it."""
    word, bit = F.col("token").bitwiseAND(F.lit(WORDS - 1)), F.shiftright("token", 32).bitwiseAND(F.lit(63)).cast("int")
    odd = [F.bit_xor(F.when(word == w, F.expr("shiftleft(1L, __bit)")).otherwise(F.lit(0).cast("long"))).alias(f"p{w}") for w in range(WORDS)]
    return _tokens(texts, size).withColumn("__bit", bit).groupBy("id").agg(F.count("*").cast("int").alias("n"), *odd)


def _reached(both: Column, similarity: float) -> Column:
    """Whether ``both`` shingles shared by lines of n and m shingles make the similarity; ``both`` is named once, as a join's condition works out every mention."""
    return both * (1 + similarity) >= similarity * (F.col("n") + F.col("m")) - 1e-9


def _able(similarity: float, words: int = WORDS) -> Column:
    """Whether lines of n and m shingles with parities x0 ... and y0 ... may reach the similarity.

    A shingle of both lines changes the same parity in either, so the bits in which
    their parities differ are at most as many as the shingles that only one of them has.
    """
    apart = sum((F.bit_count(F.col(f"x{w}").bitwiseXOR(F.col(f"y{w}"))) for w in range(words)), F.lit(0))
    return _reached(F.least(F.col("n"), F.col("m"), (F.col("n") + F.col("m") - apart) / 2), similarity)


def _parity_columns(name: str, words: int = WORDS) -> list[Column]:
    return [F.col(f"p{w}").alias(f"{name}{w}") for w in range(words)]


def _ends(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``lines`` that stored pairs (a, b) name, so that only these are shuffled, or all if the pairs are not few."""
    if 2 * pairs.count() > BROADCAST_LINES:
        return lines
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return lines.join(F.broadcast(ids), "id", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, marks: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of lines whose shingle sets have at least the similarity; pairs that their parities exclude need no sets."""
    return _similar(_able_pairs(pairs, marks, similarity), texts, size, similarity)


def _able_pairs(pairs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """(a, b, n, m): the pairs (a, b) that their parities do not exclude, with their numbers of shingles."""
    pairs = materialize(pairs, "lines-pairs")
    known = _ends(marks, pairs)
    one = known.select(F.col("id").alias("a"), "n", *_parity_columns("x"))
    two = known.select(F.col("id").alias("b"), F.col("n").alias("m"), *_parity_columns("y"))
    able = materialize(pairs.join(one, "a").join(two, "b").where(_able(similarity)).select("a", "b", "n", "m"), "lines-able")
    discard(pairs)
    return able


def _band_pairs(left: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """(a, b): of the rows (band, id, root) the pairs of lines that share a band, are in different components and are not excluded by their folded parities."""
    folded = [reduce(Column.bitwiseXOR, [F.col(f"p{w}") for w in range(k, WORDS, FOLDED)]).alias(f"p{k}") for k in range(FOLDED)]
    rows = materialize(left.select("band", "id", "root").join(marks.select("id", "n", *folded), "id"), "lines-rows")
    one = rows.select("band", F.col("id").alias("a"), F.col("root").alias("ra"), "n", *_parity_columns("x", FOLDED))
    two = rows.select("band", F.col("id").alias("b"), F.col("root").alias("rb"), F.col("n").alias("m"), *_parity_columns("y", FOLDED))
    far = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb"))
    return one.join(two, "band").where(far & _able(similarity, FOLDED)).select("a", "b").distinct()


def _apart(able: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of ``able`` that are in different components."""
    for end in ("a", "b"):
        able = able.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    return able.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "n", "m")


def _first_partners(able: DataFrame) -> DataFrame:
    """Of the pairs ``able`` those of each line with its smallest and its largest partner."""
    ends = able.select(F.col("a").alias("id"), F.col("b").alias("other")).union(able.select(F.col("b").alias("id"), F.col("a").alias("other")))
    ends = ends.groupBy("id").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).select("id", F.explode(F.array("lo", "hi")).alias("other"))
    chosen = ends.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return able.join(chosen, ["a", "b"], "left_semi")


def _similar(able: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of the stored pairs ``able`` (a, b, n, m) whose shingle sets have at least the similarity."""
    texts = _ends(texts, able)
    joined = able.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    # the sets are several times the texts, so they are made behind the shuffles
    both = F.size(F.array_intersect(shingles(F.col("x"), size), shingles(F.col("y"), size)))
    return joined.where(_reached(both, similarity)).select("a", "b")


def _prefixes(crowd: DataFrame, texts: DataFrame, marks: DataFrame, size: int, similarity: float) -> DataFrame:
    """(id, n, token, left): of each line of ``crowd`` (id, root) the rarest shingles, one of which it shares with any line that reaches the similarity; left is how many shingles follow, itself included."""
    tokens = materialize(_tokens(texts.join(crowd, "id"), size), "lines-tokens")
    # a shingle of one line, or of one component's lines, makes no pair, but has its place among the rarest
    often = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token", "df")
    often = materialize(often, "lines-often")
    shared = tokens.select("id", "token").join(often, "token")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "token"))
    # the shingles that are not shared come before all others
    left = shared.select("id", "token", (F.count("*").over(Window.partitionBy("id")) - rank + 1).alias("left")).join(marks.select("id", "n"), "id")
    ranked = materialize(left.where(F.col("left") >= similarity * F.col("n") - 1e-9), "lines-ranked")
    discard(tokens)
    discard(often)
    prefixes = materialize(_live(ranked.join(crowd, "id"), similarity).select("id", "n", "token", "left"), "lines-prefixes")
    discard(ranked)
    return prefixes


def _live(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows (token, id, root, n, left) whose shingle a line of another component and of a fitting length has in its prefix too; longer and shorter tell in which places of a pair.

    The shorter line of a pair needs the whole intersection behind their first shared
    shingle, which for its own length is a larger part than for the longer one's.
    Lines whose lengths fit are at most one class of lengths apart.
    """
    width = math.log(1 / max(similarity, 1e-9)) + 1e-6
    rows = rows.withColumn("length", F.floor(F.log(F.col("n").cast("double")) / width).cast("int")).withColumn("early", F.col("left") >= 2 * similarity / (1 + similarity) * F.col("n") - 1e-9)
    early = F.when(F.col("early"), F.col("root"))
    ends = rows.groupBy("token", "length").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(early).alias("early_lo"), F.max(early).alias("early_hi"))
    none = F.lit(None).cast("long")

    def seen(length: Column, longer: bool, shorter: bool) -> Column:
        """The roots of the longer and the shorter lines that a line of this length may meet."""
        return F.struct(length.alias("length"), *((F.col(c) if own else none).alias(c) for c, own in (("lo", longer), ("hi", longer), ("early_lo", shorter), ("early_hi", shorter))))

    near = F.array(seen(F.col("length"), True, True), seen(F.col("length") + 1, False, True), seen(F.col("length") - 1, True, False))
    reach = ends.select("token", F.explode(near).alias("s")).select("token", "s.*").groupBy("token", "length").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("early_lo").alias("early_lo"), F.max("early_hi").alias("early_hi"))
    reach = reach.where("least(lo, early_lo) <> greatest(hi, early_hi)")
    other = lambda lo, hi: F.coalesce((F.col(lo) != F.col("root")) | (F.col(hi) != F.col("root")), F.lit(False))
    found = rows.join(reach, ["token", "length"]).withColumn("longer", other("early_lo", "early_hi")).withColumn("shorter", F.col("early") & other("lo", "hi"))
    return found.where("longer or shorter").select("token", "id", "root", "n", "left", "longer", "shorter")


def _placed(df: DataFrame, roots: DataFrame) -> DataFrame:
    """With the root of every line's component; a line without links is its own."""
    return df.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _prefix_pairs(prefixes: DataFrame, roots: DataFrame, marks: DataFrame, similarity: float, heads: int | None) -> DataFrame:
    """(a, b): the pairs of lines in different components that share a shingle of their prefixes and may reach the similarity; with ``heads`` only those with the shingle's first or last line in an order that this number seeds."""
    rows = _placed(prefixes, roots)
    if heads is None:
        # a pair meets at all shingles that it shares, but is put out only at the first one, which nothing rarer that both have precedes;
        # the parities go along, so that the join itself puts out only pairs that they do not exclude
        rarer = F.collect_list("token").over(Window.partitionBy("id").orderBy(F.desc("left")).rowsBetween(Window.unboundedPreceding, -1))
        rows = _live(rows, similarity).withColumn("rarer", rarer).drop("n")
        rows = materialize(rows.join(marks, "id"), "lines-live")

    def side(k: str, r: str, n: str, left: str, parity: str) -> DataFrame:
        more = [] if heads is not None else [*_parity_columns(parity), F.col("rarer").alias(f"{k}_rarer")]
        own = rows if heads is not None else rows.where("longer" if k == "a" else "shorter")
        return own.select("token", F.col("id").alias(k), F.col("root").alias(r), F.col("n").alias(n), F.col("left").alias(left), *more)

    one, two = side("a", "ra", "n", "p", "x"), side("b", "rb", "m", "q", "y")
    if heads is not None:
        line = F.struct(F.xxhash64(F.lit(heads), "b").alias("order"), "b", "rb", "m", "q")
        ends = two.groupBy("token").agg(F.min(line).alias("lo"), F.max(line).alias("hi"))
        two = ends.select("token", F.explode(F.array("lo", "hi")).alias("h")).select("token", "h.b", "h.rb", "h.m", "h.q")
    # what lies behind the first shared shingle must hold the whole intersection
    need = similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-9
    far = (F.col("ra") != F.col("rb")) & (F.col("p") >= need) & (F.col("q") >= need)
    if heads is None:
        # the longer line of a pair is a
        far = far & (F.struct("n", "a") > F.struct(F.col("m").alias("n"), F.col("b").alias("a"))) & _able(similarity) & ~F.arrays_overlap("a_rarer", "b_rarer")
        return one.join(two, "token").where(far).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return one.join(two, "token").where(far).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def line_components(docs: DataFrame, size: int = SHINGLE, k: int = SKETCH, run: int = RUN, similarity: float = SIMILARITY, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Two tables: (doc_id, row if any, pos, id, more) of every line, and (id, root) of the lines that are linked to another one."""
    lines = _named(_lines(docs))
    signed = materialize(lines.select("doc_id", *_row(lines), "pos", "id", "more", bands(sketch(F.col("line"), size, k), run).alias("bands")), "lines-signed")
    banded = signed.select("id", F.explode("bands").alias("band"))
    # bands that two or more different lines share
    heads = None
    for part in range(BAND_PARTS):
        # a part of the bands at a time, as what is shuffled for them is more than all else that is stored
        own = banded.where(F.pmod("band", F.lit(BAND_PARTS).cast("long")) == part)
        some = own.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last").select("band", "head")
        some = materialize(some, "lines-heads")
        heads = some if heads is None else heads.union(some)
    met = materialize(banded.join(_few(heads), "band").distinct(), "lines-met")
    # the texts of the lines that met, from one more reading of the documents
    wanted = _few(materialize(met.select("id").distinct(), "lines-wanted"))
    texts = lines.select("id", "more", "line").join(wanted, "id", "left_semi").groupBy("id").agg(F.first("line").alias("line"), F.min("more").alias("lo"), F.max("more").alias("hi"))
    texts = materialize(texts.where("lo = hi").select("id", "line"), "lines-texts")
    # the bands are most of that table and no longer needed
    numbered = materialize(signed.drop("bands"), "lines-numbered")
    discard(signed)
    marks = materialize(_parities(texts, size), "lines-marks")

    def linked(able: DataFrame, roots: DataFrame | None = None) -> DataFrame:
        """The components of all links so far; those of the stored pairs ``able`` join earlier components only by their roots."""
        found = materialize(_similar(able, texts, size, similarity), "lines-links")
        if roots is None:
            return materialize(connected_components(found, "a", "b"), "lines-roots")
        for end in ("a", "b"):
            above = roots.select(F.col("node").alias(end), F.col("root").alias("__root"))
            found = found.join(above, end, "left").withColumn(end, F.coalesce("__root", end)).drop("__root")
        top = materialize(connected_components(found, "a", "b"), "lines-top")
        higher = top.select(F.col("node").alias("root"), F.col("root").alias("__top"))
        moved = roots.join(higher, "root", "left").select("node", F.coalesce("__top", "root").alias("root"))
        return materialize(moved.union(top.join(roots, "node", "left_anti")), "lines-roots")

    pairs = met.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    roots = linked(_able_pairs(pairs, marks, similarity))
    # lines of different components in bands of the same head, which has met them all
    placed = materialize(_placed(met.select("id", F.col("head").alias("band")).distinct(), roots), "lines-placed")
    parts = placed.groupBy("band").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    open_bands = parts.where("n > 2 and lo <> hi").select("band", (F.col("n") * (F.col("n") - 1) / 2 <= crowd).alias("small"))
    left = materialize(placed.join(open_bands, "band"), "lines-open")
    if left.limit(1).count():
        able = _able_pairs(_band_pairs(left.where("small and id <> band"), marks, similarity), marks, similarity)
        roots = linked(materialize(_first_partners(able), "lines-able"), roots)
        roots = linked(materialize(_apart(able, roots), "lines-able"), roots)
        many = materialize(left.where("not small").select("id", "root").distinct(), "lines-crowd")
        if many.limit(1).count():
            prefixes = _prefixes(many, texts, marks, size, similarity)
            for seed in [*range(HEAD_ROUNDS), None]:
                roots = linked(_able_pairs(_prefix_pairs(prefixes, roots, marks, similarity, seed), marks, similarity), roots)
    return numbered, roots.select(F.col("node").alias("id"), "root")


def line_classes(docs: DataFrame, **parameters) -> DataFrame:
    """(doc_id, line_no, class_doc_id, class_line_no, kept) for every line that is not blank; the class is named by its earliest line.

    Line numbers count all lines of the text from 0.
    """
    lines, roots = line_components(docs.select("doc_id", "text"), **parameters)
    ids = lines.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if ids["low"] is None or -PLACE < ids["low"] and ids["high"] < PLACE:
        # places fit into a long
        no_id = F.lit(-PLACE).cast("long")
        out = _kept_places(lines, roots, F.coalesce("doc_id", no_id) * F.lit(PLACE).cast("long") + F.col("pos"))
        number = F.pmod("keep", F.lit(PLACE).cast("long"))
        doc = F.shiftright("keep", 31)
    else:
        no_id = F.lit(_NO_ID).cast("decimal(20,0)")
        place = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), no_id) * F.lit(PLACE).cast("decimal(10,0)") + F.col("pos")
        out = _kept_places(lines, roots, place.cast("decimal(38,0)"))
        number = F.pmod("keep", F.lit(PLACE).cast("decimal(38,0)"))
        doc = ((F.col("keep") - number) / F.lit(PLACE).cast("decimal(10,0)")).cast("decimal(20,0)")
    return out.select("doc_id", F.col("pos").cast("long").alias("line_no"), F.when(doc != no_id, doc).cast("long").alias("class_doc_id"), number.cast("long").alias("class_line_no"), (F.col("place") == F.col("keep")).alias("kept"))


def _kept_places(lines: DataFrame, roots: DataFrame, place: Column) -> DataFrame:
    """``lines`` with their place and the place of their class's first line (keep)."""
    lines = lines.withColumn("place", place)
    named = lines.groupBy("id", "more").agg(F.min("place").alias("first"), F.count("*").alias("copies")).join(roots, "id", "left")
    # a line without a copy or a link is its own class's first line and meets nothing
    named = named.where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "id"))
    linked = named.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first").alias("best"))
    named = named.join(linked, "root", "left").select("id", "more", F.coalesce("best", "first").alias("keep"))
    return lines.join(named, ["id", "more"], "left").withColumn("keep", F.coalesce("keep", "place"))


def drop_repeated_lines(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with the removed lines cut out of the texts; documents left without a line go, texts without lines pass unchanged.

    ``n_chars``, if there is such a column, follows the new text.
    """
    tag = unused(docs)
    cut, row = f"{tag}_gone", f"{tag}_row"
    with scratch(docs.sparkSession, "rows", "lines-gone"):
        rows = with_rows(docs, row)
        lines, roots = line_components(rows.select("doc_id", F.col(row).alias("row"), "text"), **parameters)
        gone = _kept_places(lines, roots, F.struct("doc_id", "row", "pos")).where(~F.col("place").eqNullSafe(F.col("keep")))
        gone = gone.groupBy("row").agg(F.array_sort(F.collect_set(F.col("pos").cast("long"))).alias(cut))
        gone = materialize(gone.select(F.col("row").alias(row), cut), "lines-gone")
    joined = rows.join(gone, row, "left")
    out = cut_lines(joined, cut).where(F.col(cut).isNull() | (F.trim(F.translate("text", "\n\t\r\x0b\x0c", "     ")) != ""))
    return out.select(docs.columns)
