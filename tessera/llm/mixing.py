"""Mixing sources to target weights: hierarchical budgets, token prefixes.

The tree is domain -> language -> source.  A budget of tokens is divided among
the domains by weight, each domain's among its languages, each language's
among its sources.  A node can take at most its capacity (tokens below it
times ``max_epochs``).  What a node cannot take goes to its siblings by weight,
and only what all siblings together cannot take is missing one level up, where
the aunts take it: every level is filled by the level L for which
sum(min(capacity, L * weight)) is the budget, L = max over i of
(budget - capacities before i) / (weights from i), children in order of
capacity / weight.

Each leaf then takes whole epochs of its documents and, of one more epoch, a
prefix of tokens in an order seeded by (seed, epoch, id).  The prefix is found
without sorting a leaf in one task: tokens are summed by (leaf, leading digits
of the order key), the sums are accumulated, and only the digit group in which
the prefix ends is sorted.  The result is one order key per leaf; a document
is in the prefix when its own key is not larger.

Only DataFrame functions are used.  Tokens are runs of non-blanks.  Null
domains, languages and sources are branches of their own; unlisted branches
have weight 1; a branch of weight 0 takes nothing, and what lies below it counts
as no capacity of those above; null and empty texts have
no tokens (they are in a prefix when their key is, and take 0 tokens); rows
that share an id are in or out together; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import meet, staged, unused

LEAF = ["domain", "lang", "source"]
SEED, DIGITS = 17, 3
#: Leaves that are sent to every executor at most (about 10 MB).
BROADCAST_LEAVES = 100_000


def weight_of(key: Column, weights: dict | None) -> Column:
    out = F.lit(1.0)
    for k, w in (weights or {}).items():
        out = F.when(key.eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(out)
    return out


def fill(nodes: DataFrame, parent: list[str], budget: Column) -> DataFrame:
    """``nodes`` (..., weight, capacity) with ``budget``: the parent's budget
    shared out by weight up to each node's capacity."""
    nodes = nodes.where("weight > 0 and capacity > 0")
    over = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    line = over.orderBy(F.col("capacity") / F.col("weight"), *[F.col(k).asc_nulls_first() for k in LEAF if k in nodes.columns])
    before = F.coalesce(F.sum("capacity").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (nodes.withColumn("__of", budget.cast("double"))
            .withColumn("__level", (F.col("__of") - before) / rest)
            .withColumn("__level", F.max("__level").over(over))
            .withColumn("budget", F.greatest(F.lit(0.0), F.least(F.col("capacity").cast("double"),
                                                                 F.col("__level") * F.col("weight"))))
            .drop("__of", "__level"))


def budgets(tokens: DataFrame, total: Column, weights: dict, max_epochs: int) -> DataFrame:
    """(domain, lang, source, n_tokens, budget) of every leaf with a budget.
    ``tokens`` has one row per leaf."""
    # what a branch of weight 0 holds is no capacity of those above it
    live = tokens.withColumn("capacity", F.col("n_tokens") * max_epochs)
    for level in LEAF:
        live = live.where(weight_of(F.col(level), weights.get(level)) > 0)
    weigh = lambda df, level: df.withColumn("weight", weight_of(F.col(level), weights.get(level)))
    held = live.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    tops = weigh(held.groupBy("domain").agg(F.sum("capacity").alias("capacity")), "domain")
    whole = tokens.agg(F.sum("n_tokens").alias("n")).select(total.alias("whole"))
    tops = fill(tops.crossJoin(F.broadcast(whole)), [], F.col("whole"))          # whole: one row
    tops = tops.select(F.col("domain").alias("d"), F.col("budget").alias("above"))
    held = weigh(held, "lang")
    held = fill(held.join(tops, held["domain"].eqNullSafe(tops["d"])).drop("d"), ["domain"], F.col("above"))
    held = held.select(F.col("domain").alias("d"), F.col("lang").alias("l"), F.col("budget").alias("above"))
    leaves = weigh(live, "source")
    leaves = leaves.join(held, leaves["domain"].eqNullSafe(held["d"]) & leaves["lang"].eqNullSafe(held["l"])).drop("d", "l")
    return (fill(leaves, ["domain", "lang"], F.col("above"))
            .select(*LEAF, "n_tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget")))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def token_rows(docs: DataFrame, domain: Column, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), domain.cast("string").alias("domain"),
                       F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit("[^ \\t\\n\\x0B\\f\\r]+")),
                                  F.lit(0)).cast("long").alias("n_tokens"))


def prefixes(rows: DataFrame, total: Column, weights: dict, max_epochs: int, seed: int) -> DataFrame:
    """One row per leaf with a budget: whole ``epochs``, the largest order key
    of the epoch after them that is taken (``last``; '' for none) and the tokens
    taken of that document (``last_tokens``).  ``rows`` come from token_rows."""
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("n_tokens"))
    plan = budgets(leaves, total, weights, max_epochs)
    plan = plan.withColumn("epochs", F.floor(F.col("budget") / F.col("n_tokens")).cast("int"))
    plan = staged(plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("n_tokens")), "leaves")
    p = plan.where("rest > 0").select(*LEAF, "epochs", "rest")
    open_ = (meet(rows, held_small(p), LEAF)
             .select(*LEAF, "doc_id", "n_tokens", "rest", order_key(seed, F.col("epochs"), F.col("doc_id")).alias("key"))
             .withColumn("digits", F.substring("key", 1, DIGITS)))
    sums = open_.groupBy(*LEAF, "digits", "rest").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*LEAF).orderBy("digits")) - F.col("n"))
    edge = sums.where("before < rest and rest <= before + n").select(*LEAF, "digits", "before")
    near = meet(open_, edge, [*LEAF, "digits"])
    inside = Window.partitionBy(*LEAF).orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    last = (near.where("before < rest").groupBy(*LEAF)
            .agg(F.max(F.struct("key", "before")).alias("x"), F.max("rest").alias("r"))
            .select(*LEAF, F.col("x.key").alias("last"), (F.col("r") - F.col("x.before")).alias("last_tokens")))
    return staged(meet(plan, last, LEAF, "left")
                  .select(*LEAF, "budget", "epochs", F.coalesce("last", F.lit("")).alias("last"),
                          F.coalesce("last_tokens", F.lit(0)).alias("last_tokens")), "prefixes")


def held_small(leaves: DataFrame) -> DataFrame:
    """Counted: a table of few leaves is broadcast, a larger one is exchanged."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def mix_sources(docs: DataFrame, domain: Column, total: Column, weights: dict, max_epochs: int = 2, seed: int = SEED,
                id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                source_col: str = "source") -> DataFrame:
    """One row per taken document and epoch: doc_id, domain, lang, source,
    leaf_budget, epoch, n_tokens and taken_tokens (fewer for the document in
    which the leaf's prefix ends).  ``total``: the budget, an expression of the
    number ``n`` of all tokens."""
    rows = staged(token_rows(docs, domain, id_col, text_col, lang_col, source_col), "tokens")
    leaf = prefixes(rows, total, weights, max_epochs, seed)
    out = (meet(rows, held_small(leaf), LEAF)
           .select("doc_id", *LEAF, F.col("budget").alias("leaf_budget"), "n_tokens", "epochs", "last",
                   "last_tokens", F.explode(F.sequence(F.lit(0), F.col("epochs"))).alias("epoch")))
    key = order_key(seed, F.col("epoch"), F.col("doc_id"))
    return (out.withColumn("key", F.when(F.col("epoch") == F.col("epochs"), key))
            .where("epoch < epochs or key <= last")
            .select("doc_id", *LEAF, "leaf_budget", "epoch", "n_tokens",
                    F.when(F.col("key") == F.col("last"), F.least("n_tokens", "last_tokens")).otherwise(F.col("n_tokens"))
                    .alias("taken_tokens")))


def select_mixture(docs: DataFrame, domain: Column, total: Column, weights: dict, seed: int = SEED,
                   id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   source_col: str = "source") -> DataFrame:
    """The taken documents, all columns as they were and each at most once (one
    epoch); the document in which a leaf's prefix ends is kept whole."""
    rows = staged(token_rows(docs, domain, id_col, text_col, lang_col, source_col), "tokens")
    leaf = prefixes(rows, total, weights, 1, seed).select(*[F.col(k).alias(f"__{k}") for k in LEAF], "epochs", "last")
    named = leaf.toDF(*[unused(docs.columns, f"leaf_{k}") for k in [*LEAF, "epochs", "last"]])
    d, g, s, epochs, last = named.columns
    key = order_key(seed, F.lit(0), F.col(id_col))
    met = (domain.cast("string").eqNullSafe(F.col(d)) & F.col(lang_col).cast("string").eqNullSafe(F.col(g))
           & F.col(source_col).cast("string").eqNullSafe(F.col(s)))
    return docs.join(held_small(named), met & ((F.col(epochs) > 0) | (key <= F.col(last))), "left_semi")
