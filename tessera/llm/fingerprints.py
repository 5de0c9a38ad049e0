"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is the set of its paragraph digests (lines, long ones cut behind
sentence ends; 40 hash bits and 24 check bits in one long).  The sketch has 3
rows of 8 cells; each digest falls into one cell of each row, and a cell holds
the number of its digests and their exclusive or.  Sketches of two versions
subtract cell by cell, which leaves the differing digests.  Peeling takes a
cell with count 1 or -1 whose check bits fit, notes its digest, removes it
from its three cells and goes on; an empty sketch at the end means that every
differing digest was found.

A sketch that doesn't peel is retried larger: digests are dealt over 8
sub-sketches by three further bits, and only sub-sketches that fail again are
dealt on, so a retry of level n has up to 24 * 8**n cells.  After ``LEVELS``
levels all hash bits are used up; what is left then (digests that agree in 30
bits) is compared directly, so the difference is always found.

The likeness of two texts is |common| / |all| of their paragraphs,
(a + b - d) / (a + b + d) with d differing digests; 1 for two texts without
paragraphs.  Only DataFrame and SQL functions are used; everything but finding
the next document is local to the row.

Next documents: ids are dealt into cells of about ``RANGE`` documents, the first
document of each cell goes along to the cell before it, and a window over each
cell reads the next row.  A cell is a run of ids with the same leading binary
digits; cells are counted, and one of more than 4 * ``RANGE`` documents is cut
by further digits, as many as the span of its own ids asks for, until none is
left, so outliers and clusters of ids make no large cell.  A crowded cell of one
id (repeated, or null) is cut in the same way by the digits of a hash of the
text; only rows that agree in id and text stay together.  First documents are
counted (at most about half a million for evenly filled cells) and broadcast up
to twice that.  Ids are integers.  Null and empty texts have no paragraphs; null
ids come before all others; rows that share an id follow each other by a hash of
the text; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import staged

RANGE, FIRSTS = 256, 500_000
ROWS, CELLS, ROUNDS, LEVELS = 3, 8, 8, 10
SPLIT = "[\\\\r\\\\n]+|(?<=[.!?])[ \\\\t]+"


def paragraphs(text: str) -> str:
    """SQL: sorted distinct paragraph digests of a text."""
    digest = "shiftleft(shiftrightunsigned(xxhash64(p), 24), 24)"
    return (f"array_sort(array_distinct(transform(filter(split({text}, '{SPLIT}'), p -> trim(p) <> ''), "
            f"p -> {digest} | (xxhash64({digest}) & 16777215))))")


def sketch(digests: str) -> str:
    """SQL: cells (n, x) of the rows of the sketch, one row after another."""
    rows = [f"transform(transform(sequence(0, {CELLS - 1}), c -> filter({digests}, u -> (shiftrightunsigned(u, {24 + 3 * j}) & 7) = c)), "
            "f -> named_struct('n', size(f), 'x', aggregate(f, 0L, (x, u) -> x ^ u)))" for j in range(ROWS)]
    return f"concat({', '.join(rows)})"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('n', p.n - q.n, 'x', p.x ^ q.x))"


def peel(cells: str) -> str:
    """SQL: number of digests peeled from a subtracted sketch, -1 if some stay."""
    fits = "abs(c.n) = 1 and (xxhash64(shiftleft(shiftrightunsigned(c.x, 24), 24)) & 16777215) = (c.x & 16777215)"
    mine = f"(shiftrightunsigned(k.x, 24 + 3 * (i div {CELLS})) & 7) = i % {CELLS}"
    round_ = (
        f"aggregate(array(array_distinct(filter(s.cells, c -> {fits}))), s, (z, pure) -> if(size(pure) = 0, z, named_struct("
        f"'cells', transform(z.cells, (c, i) -> aggregate(filter(pure, k -> {mine}), c, "
        "(v, k) -> named_struct('n', v.n - k.n, 'x', v.x ^ k.x))), 'd', z.d + size(pure))))")
    return (f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'd', 0), (s, r) -> {round_}, "
            "s -> if(forall(s.cells, c -> c.n = 0 and c.x = 0L), s.d, -1))")


def difference(first: str, a: str, b: str) -> str:
    """SQL: number of differing digests of two sorted sets; ``first`` is the
    result of the smallest sketch."""
    deal = ("filter(flatten(transform(s.todo, g -> transform(sequence(0, 7), c -> named_struct("
            "'a', filter(g.a, u -> (shiftrightunsigned(u, 30 + 3 * l) & 7) = c), "
            "'b', filter(g.b, u -> (shiftrightunsigned(u, 30 + 3 * l) & 7) = c))))), g -> g.a <> g.b)")
    solve = f"transform({deal}, g -> named_struct('a', g.a, 'b', g.b, 'd', {peel(subtract(sketch('g.a'), sketch('g.b')))}))"
    step = (f"aggregate(array({solve}), s, (z, got) -> named_struct("
            "'todo', transform(filter(got, g -> g.d < 0), g -> named_struct('a', g.a, 'b', g.b)), "
            "'d', z.d + aggregate(got, 0, (t, g) -> t + greatest(g.d, 0))))")
    rest = "aggregate(s.todo, s.d, (t, g) -> t + size(array_except(g.a, g.b)) + size(array_except(g.b, g.a)))"
    return (f"if({first} >= 0, {first}, aggregate(sequence(1, {LEVELS}), named_struct('todo', array(named_struct('a', {a}, 'b', {b})), "
            f"'d', 0), (s, l) -> if(size(s.todo) = 0, s, {step}), s -> {rest}))")


def text_of_cells(cells: str) -> str:
    return (f"regexp_replace(base64(unhex(array_join(transform({cells}, c -> concat(lpad(hex(c.n), 8, '0'), "
            "lpad(hex(c.x), 16, '0'))), ''))), '[\\\\r\\\\n]', '')")


CELL = ["given", "at", "part"]      # whether there is an id, leading digits of the id, of the text's hash


def cells(rows: DataFrame, per: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc_id, text, ...) with their cell (``CELL``) and their place
    ``k``, ``h`` in it, and the counted cells (CELL, n, first)."""
    rows = rows.withColumns({"given": F.col("doc_id").isNotNull().cast("int"), "k": F.coalesce("doc_id", F.lit(0).cast("long")),
                             "h": F.lit(0).cast("long")})
    rows = rows.withColumns({"at": F.lit(-1 << 63).cast("long"), "part": F.lit(0).cast("long")})
    for value, digits in (("k", "at"), ("h", "part")):
        while True:
            counted = staged(rows.groupBy(*CELL).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
                                                     F.min(F.struct("k", "h")).alias("first")), "cells")
            span = F.col("high").cast("double") - F.col("low") + 1
            bits = F.least(F.greatest(F.floor(F.log2(span * per / F.col("n"))), F.lit(0)), F.lit(62)).cast("int")
            crowded = (counted.where((F.col("n") > 4 * per) & (F.col("low") < F.col("high")))
                       .select(*CELL, bits.alias("bits")))
            found = crowded.count()
            if not found:
                break
            crowded = F.broadcast(crowded) if found <= FIRSTS else crowded
            rows = (rows.join(crowded, CELL, "left")
                    .withColumn(digits, F.expr(f"if(bits is null, {digits}, shiftleft(shiftright({value}, bits), bits))")).drop("bits"))
        if value == "k" and counted.where(F.col("n") > 4 * per).isEmpty():
            break
        if value == "k":                                  # crowded cells of one id
            rows = rows.withColumn("h", F.xxhash64("text")).withColumn("part", F.lit(-1 << 63).cast("long"))
    return rows, counted.select(*CELL, "n", "first")


def followed(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id long, text) in their cells: one row per document with
    ``in_range`` 0, and at the end of each cell the first of the next (1)."""
    rows, counted = cells(rows, max(RANGE, -(-rows.count() // FIRSTS)))
    here = F.struct(*CELL)
    line = Window.partitionBy(F.lit(0)).orderBy(*CELL)
    firsts = staged(counted.withColumn("prior", F.coalesce(F.lag(here).over(line), F.max(here).over(Window.partitionBy(F.lit(0)))))
                    .select("given", "first.*", "prior"), "firsts")
    firsts = F.broadcast(firsts) if firsts.count() <= 2 * FIRSTS else firsts
    own = F.struct(here.alias("cell"), F.lit(0).alias("in_range"))
    return (rows.join(firsts, ["given", "k", "h"], "left")
            .withColumn("to", F.explode(F.when(F.col("prior").isNull(), F.array(own))
                                        .otherwise(F.array(own, F.struct(F.col("prior").alias("cell"), F.lit(1).alias("in_range"))))))
            .select("doc_id", "text", "k", "to.cell.*", "to.in_range"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, n_paragraphs, fingerprint; the
    edited text (its last half replaced by as much of the next document's
    beginning) with its fingerprint; numbers of differing digests and likeness
    to the edited text and to the next document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    w = Window.partitionBy(*CELL).orderBy("in_range", "k", F.xxhash64("text"))
    out = (followed(rows).withColumn("next_text", F.lead("text").over(w))
           .withColumn("n_chars", F.char_length("text").cast("long"))
           .withColumn("edited", F.expr("if(in_range = 0, concat(left(text, int(n_chars - n_chars div 2)), "
                                        "left(next_text, int(n_chars div 2))), '')"))
           .withColumn("own", F.expr(paragraphs("text"))).withColumn("other", F.expr(paragraphs("edited")))
           .withColumn("own_cells", F.expr(sketch("own")))
           .withColumn("next", F.lead("own").over(w)).withColumn("next_cells", F.lead("own_cells").over(w))
           .where("in_range = 0")
           .withColumn("edited_cells", F.expr(sketch("other")))
           .withColumn("e0", F.expr(peel(subtract("own_cells", "edited_cells"))))
           .withColumn("n0", F.expr(peel(subtract("own_cells", "next_cells"))))
           .withColumn("differ_edited", F.expr(difference("e0", "own", "other")))
           .withColumn("differ_next", F.expr(difference("n0", "own", "next"))))
    like = lambda b, d: F.expr(f"if(size(own) + size({b}) = 0, 1.0D, "  # noqa: E731
                               f"(size(own) + size({b}) - {d}) / double(size(own) + size({b}) + {d}))")
    return out.select("doc_id", "n_chars", F.size("own").alias("n_paragraphs"), F.expr(text_of_cells("own_cells")).alias("fingerprint"),
                      "edited", F.expr(text_of_cells("edited_cells")).alias("edited_fingerprint"),
                      "differ_edited", "differ_next", like("other", "differ_edited").alias("near_edited"),
                      like("next", "differ_next").alias("near_next"))
