"""Lexicon sentiment over whole texts.

Plan: the package's lexicon is a set and a few arrays of constants.  Words,
capitals, "but" and punctuation are counted in the row; the places of lexicon
words are filtered in the row, and only these few are looked at with the three
words before them.  Nothing is exploded, joined or shuffled, and each row has its
own result, whatever its id.  A caller's lexicon may have any size: its words
go out of the row, meet the table, and the scores of each distinct text come back
to all rows that hold it (by a 128-bit digest of the text).

Valence scores follow VADER (Hutto & Gilbert 2014).  An ALL-CAPS word in
mixed-case text adds +-0.733.  Then, for the words 1, 2 and 3 places before,
in this order and unless that word has a valence itself: a booster adds
+-0.293 (x1, x0.95, x0.9; its capitals add +-0.733 too) with the sign that the
valence has by then, and a negation (listed, or holding "n't") multiplies by
-0.74; "never" before "so" / "this" multiplies by 1.25 instead and "without
doubt" leaves the value.  "least" right before, not after "at" or "very",
multiplies by -0.74.  Words before the first "but" are halved, after it x1.5;
up to four '!' add 0.292 each and 2+ '?' add 0.18 each (0.96 above three);
compound = s / sqrt(s^2 + 15).

Polarity / subjectivity follow the pattern lexicon approach: mean over
lexicon words, a booster right before a word multiplies both values, a
negation among the two previous words multiplies polarity by -0.5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import defaults
from ..functions.numeric import round_half_up
from ..functions.text import truncate_chars, words

PUNCT_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
# at least one upper-case letter and no lower-case letter (Python's str.isupper)
ALL_CAPS = r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"


def checked_broadcast(df: DataFrame, max_rows: int, known_max: int | None = None) -> DataFrame:
    """Broadcast a dictionary side whose row bound the caller has proved
    (``known_max``: a constant, a ``limit``, a count of a superset).  Without a
    proof the planner decides by bytes."""
    return F.broadcast(df) if known_max is not None and known_max <= max_rows else df


def counted(df: DataFrame, text_col: str, max_chars: int | None, *keep: str) -> DataFrame:
    """(keep..., n_excl, n_qm, keys, caps, n_tok, caps_diff, but_at) of each text:
    its words lower-cased, which of them are in capitals, and its counts."""
    t = F.coalesce(F.col(text_col) if max_chars is None else truncate_chars(text_col, max_chars), F.lit(""))
    bare = F.transform(words("t"), lambda raw: F.struct(raw.alias("raw"), F.regexp_replace(raw, PUNCT_EDGES, "").alias("bare")))
    return (df.select(*keep, t.alias("t"))
            .select(*keep, (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).alias("n_excl"),
                    (F.length("t") - F.length(F.replace("t", F.lit("?"), F.lit("")))).alias("n_qm"),
                    # a token whose stripped form is 2 characters or less keeps its punctuation
                    F.transform(bare, lambda w: F.when(F.length(w["bare"]) <= 2, w["raw"]).otherwise(w["bare"])).alias("ws"))
            .select(*keep, "n_excl", "n_qm", F.transform("ws", lambda w: F.lower(w)).alias("keys"),
                    F.transform("ws", lambda w: w.rlike(ALL_CAPS)).alias("caps"))
            .select(*keep, "n_excl", "n_qm", "keys", "caps", F.size("keys").alias("n_tok"),
                    (F.exists("caps", lambda c: c) & F.exists("caps", lambda c: ~c)).alias("caps_diff"),
                    F.nullif(F.array_position("keys", F.lit("but")), F.lit(0)).alias("but_at")))


def token(i: Column) -> Column:
    """The word at place ``i`` of (keys, caps) with the three words before it."""
    before = lambda c, k: F.when(i >= k, F.get(F.col(c), i - k))
    return F.struct(i.alias("pos"), F.get(F.col("keys"), i).alias("key"), F.get(F.col("caps"), i).alias("cap"),
                    *[before("keys", k).alias(f"key{k}") for k in (1, 2, 3)],
                    *[F.coalesce(before("caps", k), F.lit(False)).alias(f"caps{k}") for k in (1, 2, 3)])


def sql_list(values) -> str:
    """SQL literals, parsed at once: a column object for each would take longer
    than the query."""
    def one(v):
        if v is None:
            return "null"
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else repr(v) + "D" * isinstance(v, float)
    return ", ".join(map(one, values))


def places(listed: list[str] | None = None) -> Column:
    """Places of the words that are ``listed``, or of all words."""
    every = "case when n_tok > 0 then sequence(0, n_tok - 1) else cast(array() as array<int>) end"
    return F.expr(every if listed is None else f"filter({every}, i -> get(keys, i) in ({sql_list(listed)}))")


def _entries() -> list[dict]:
    return [dict(zip(defaults.LEXICON_SCHEMA.names, r)) for r in defaults.lexicon_rows()]


def steps() -> list[Callable]:
    """The rules, one after the other: each takes a getter of fields and gives
    new ones.  Fields at the start: those of ``token`` and the lexicon entries of
    the word (valence, polarity, subjectivity) and of the words before it
    (kind, boost, intensity, own: has a valence)."""
    cap = F.when(F.col("caps_diff"), F.lit(defaults.VADER_CAPS)).otherwise(F.lit(0.0))
    sign = lambda v: F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    times = F.lit(defaults.VADER_NEGATE)

    def negated(g, k):
        return F.coalesce((g(f"kind{k}") == "negation") | g(f"key{k}").contains("n't"), F.lit(False))

    def is_(g, k, *ws):
        return F.coalesce(g(f"key{k}").isin(*ws), F.lit(False))

    def factor(g, k):
        if k == 1:
            return F.when(negated(g, 1), times)
        if k == 2:
            return (F.when(is_(g, 2, "never") & is_(g, 1, "so", "this"), F.lit(1.25))
                    .when(is_(g, 2, "without") & is_(g, 1, "doubt"), F.lit(1.0)).when(negated(g, 2), times))
        return (F.when((is_(g, 3, "never") & is_(g, 2, "so", "this")) | is_(g, 1, "so", "this"), F.lit(1.25))
                .when(is_(g, 3, "without") & (is_(g, 2, "doubt") | is_(g, 1, "doubt")), F.lit(1.0)).when(negated(g, 3), times))

    def open_(g, k):
        return g(f"key{k}").isNotNull() & ~F.coalesce(g(f"own{k}"), F.lit(False))

    def boosted(k, decay):
        def step(g):
            added = F.when(open_(g, k) & (g(f"kind{k}") == "booster"),
                           sign(g("v")) * (g(f"boost{k}") + F.when(g(f"caps{k}"), cap).otherwise(F.lit(0.0))) * decay)
            return {"v": (g("v") + F.coalesce(added, F.lit(0.0)))
                    * F.when(open_(g, k), F.coalesce(factor(g, k), F.lit(1.0))).otherwise(F.lit(1.0))}
        return step

    def last(g):
        least = is_(g, 1, "least") & ~F.coalesce(g("own1"), F.lit(False)) & ~is_(g, 2, "at", "very")
        place = g("pos") + 1
        mult = F.when(g("kind1") == "booster", g("intensity1")).otherwise(F.lit(1.0))
        return {"v": g("v") * F.when(least, times).otherwise(F.lit(1.0))
                * F.when(place < F.col("but_at"), F.lit(0.5)).when(place > F.col("but_at"), F.lit(1.5)).otherwise(F.lit(1.0)),
                "p": g("polarity") * mult * F.when(negated(g, 1) | negated(g, 2), F.lit(-0.5)).otherwise(F.lit(1.0)),
                "sj": F.when(g("polarity").isNotNull(), g("subjectivity") * mult)}

    return [lambda g: {"v": F.when(g("valence") != 0, g("valence"))},
            lambda g: {"v": g("v") + F.when(g("cap"), sign(g("v")) * cap).otherwise(F.lit(0.0))},
            boosted(1, 1.0), boosted(2, 0.95), boosted(3, 0.9), last]


FIELDS = ["pos", "key", "cap", "key1", "key2", "key3", "caps1", "caps2", "caps3"]
OF_WORD, OF_BEFORE = ["valence", "polarity", "subjectivity"], ["kind", "boost", "intensity", "own"]
#: Scores of a text without any word of the lexicon: sums, and two means with their counts.
SUMS = "struct<s:double,pos_sum:double,neg_sum:double,hits:bigint,p:double,n_p:bigint,sj:double,n_sj:bigint>"


def _in_row(df: DataFrame) -> DataFrame:
    """``df`` (of ``counted``) with the sums over its words of the package's lexicon."""
    entries = _entries()
    keys = F.expr(f"array({sql_list([e['token'] for e in entries])})")
    scored = [e["token"] for e in entries if e["valence"] is not None or e["polarity"] is not None]

    def column(name):
        if name == "own":
            return F.expr("array(" + ", ".join("true" if e["valence"] is not None else "false" for e in entries) + ")")
        got = [e[name] if name == "kind" or e[name] is None else float(e[name]) for e in entries]
        return F.expr(f"cast(array({sql_list(got)}) as array<{'string' if name == 'kind' else 'double'}>)")

    values = {c: column(c) for c in OF_WORD + OF_BEFORE}
    at = lambda key: F.array_position(keys, key).cast("int") - 1  # noqa: E731  -1: not listed
    hits = F.transform(places(scored), token)
    fields = [*FIELDS]

    def extend(arr, new: Callable):
        def one(x):
            more = new(lambda n: x[n])
            kept = [f for f in fields if f not in more]
            fields[:] = [*kept, *more]
            return F.struct(*[x[f].alias(f) for f in kept], *[e.alias(n) for n, e in more.items()])
        return F.transform(arr, one)

    hits = extend(hits, lambda g: {f"at{k or ''}": at(g(f"key{k or ''}")) for k in range(4)})
    hits = extend(hits, lambda g: {**{c: F.get(values[c], g("at")) for c in OF_WORD},
                                   **{f"{c}{k}": F.get(values[c], g(f"at{k}")) for c in OF_BEFORE for k in (1, 2, 3)}})
    for step in steps():
        hits = extend(hits, step)
    zero = F.expr(f"cast(named_struct('s', 0, 'pos_sum', 0, 'neg_sum', 0, 'hits', 0, 'p', 0, 'n_p', 0, 'sj', 0, 'n_sj', 0) as {SUMS})")
    sums = F.aggregate(hits, zero, lambda a, x: F.struct(
        (a["s"] + F.coalesce(x["v"], F.lit(0.0))).alias("s"),
        (a["pos_sum"] + F.when(x["v"] > 0, x["v"] + 1).otherwise(F.lit(0.0))).alias("pos_sum"),
        (a["neg_sum"] + F.when(x["v"] < 0, x["v"] - 1).otherwise(F.lit(0.0))).alias("neg_sum"),
        (a["hits"] + F.when(x["v"] != 0, F.lit(1)).otherwise(F.lit(0))).alias("hits"),
        (a["p"] + F.coalesce(x["p"], F.lit(0.0))).alias("p"),
        (a["n_p"] + x["p"].isNotNull().cast("int")).alias("n_p"),
        (a["sj"] + F.coalesce(x["sj"], F.lit(0.0))).alias("sj"),
        (a["n_sj"] + x["sj"].isNotNull().cast("int")).alias("n_sj")).cast(SUMS))
    kept = [c for c in df.columns if c not in ("keys", "caps")]
    return df.select(*kept, sums.alias("x")).select(
        *kept, "x.s", "x.pos_sum", "x.neg_sum", (F.col("n_tok") - F.col("x.hits")).alias("neu"),
        (F.col("x.p") / F.nullif("x.n_p", F.lit(0))).alias("p"), (F.col("x.sj") / F.nullif("x.n_sj", F.lit(0))).alias("sj"))


def _by_table(df: DataFrame, key: str, lexicon: DataFrame) -> DataFrame:
    """The same sums by joins with a lexicon of any size; ``key`` tells texts apart."""
    none = "named_struct('pos', -1, 'key', '', 'cap', false, 'key1', null, 'key2', null, 'key3', null, " \
           "'caps1', false, 'caps2', false, 'caps3', false)"
    counts = ["n_excl", "n_qm", "n_tok", "but_at", "caps_diff"]
    toks = df.select(key, *counts, F.transform(places(), token).alias("tokens"))
    toks = toks.select(key, *counts, F.expr(f"inline(concat(array({none}), tokens))"))
    lex = lexicon.withColumnRenamed("token", "key")
    toks = (toks.join(lex.select("key", *OF_WORD), "key", "left")
            .where("pos = -1 or valence is not null or polarity is not null"))
    for k in (1, 2, 3):
        side = lex.select(F.col("key").alias(f"key{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("kind", "boost", "intensity")],
                          F.col("valence").isNotNull().alias(f"own{k}"))
        toks = toks.join(side, f"key{k}", "left")
    for step in steps():
        toks = toks.withColumns(step(F.col))
    return toks.groupBy(key).agg(
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"),
        F.coalesce(F.sum(F.when(F.col("v") > 0, F.col("v") + 1)), F.lit(0.0)).alias("pos_sum"),
        F.coalesce(F.sum(F.when(F.col("v") < 0, F.col("v") - 1)), F.lit(0.0)).alias("neg_sum"),
        (F.max("n_tok") - F.count(F.when(F.col("v") != 0, 1))).alias("neu"), F.max("n_tok").alias("n_tok"),
        F.max("n_excl").alias("n_excl"), F.max("n_qm").alias("n_qm"), F.avg("p").alias("p"), F.avg("sj").alias("sj"))


def text_key(c: Column) -> Column:
    """128-bit digest of a text (null counts as empty)."""
    return F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def with_sentiment(df: DataFrame, text_col: str = "text", max_chars: int | None = None,
                   lexicon: DataFrame | None = None) -> DataFrame:
    """``df`` with polarity, subjectivity, positivity, negativity, neutrality and
    compound of each row's text."""
    names = ["polarity", "subjectivity", "positivity", "negativity", "neutrality", "compound"]
    keep = [c for c in df.columns if c not in names]
    out = [round_half_up(F.greatest(F.least(F.coalesce("p", F.lit(0.0)), F.lit(1.0)), F.lit(-1.0)), 6).alias("polarity"),
           round_half_up(F.greatest(F.least(F.coalesce("sj", F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), 6).alias("subjectivity"), *_vader_finish()]
    whole = df.select(F.struct(*keep).alias("_row"), F.col(text_col).alias("_text"))
    if lexicon is None:
        return _in_row(counted(whole, "_text", max_chars, "_row")).select("_row.*", *out)
    whole = whole.withColumn("_key", text_key(F.col("_text")))
    texts = whole.select("_key", "_text").dropDuplicates(["_key"])
    scores = _by_table(counted(texts, "_text", max_chars, "_key"), "_key", lexicon).select("_key", *out)
    return whole.drop("_text").join(scores, "_key").select("_row.*", *names)


def sentiment_scores(df: DataFrame, id_col: str, text_col: str = "text", max_chars: int | None = None,
                     lexicon: DataFrame | None = None) -> DataFrame:
    """T01 + T02 in one pass: (id, polarity, subjectivity, positivity,
    negativity, neutrality, compound), one row per row of ``df``."""
    return with_sentiment(df.select(F.col(id_col), F.col(text_col).alias("_t")), "_t", max_chars, lexicon).drop("_t")


def valence_scores(df: DataFrame, id_col: str, text_col: str = "text",
                   max_chars: int | None = None,
                   lexicon: DataFrame | None = None) -> DataFrame:
    """(id, positivity, negativity, neutrality, compound)."""
    return sentiment_scores(df, id_col, text_col, max_chars, lexicon).select(
        id_col, "positivity", "negativity", "neutrality", "compound")


def polarity_subjectivity(df: DataFrame, id_col: str, text_col: str = "text",
                          max_chars: int | None = None,
                          lexicon: DataFrame | None = None) -> DataFrame:
    """(id, polarity in [-1, 1], subjectivity in [0, 1])."""
    return sentiment_scores(df, id_col, text_col, max_chars, lexicon).select(
        id_col, "polarity", "subjectivity")


def _vader_finish() -> list[Column]:
    ep = F.least(F.col("n_excl"), F.lit(4)) * defaults.VADER_EXCLAIM
    qm = (F.when(F.col("n_qm") <= 1, F.lit(0.0))
          .when(F.col("n_qm") <= 3, F.col("n_qm") * defaults.VADER_QUESTION)
          .otherwise(F.lit(0.96)))
    punct = ep + qm
    s = F.col("s")
    s2 = F.when(s > 0, s + punct).when(s < 0, s - punct).otherwise(s)
    compound = F.greatest(F.least(s2 / F.sqrt(s2 * s2 + defaults.VADER_ALPHA), F.lit(1.0)), F.lit(-1.0))
    ps, ns = F.col("pos_sum"), F.col("neg_sum")
    ps2 = F.when(ps > F.abs(ns), ps + punct).otherwise(ps)
    ns2 = F.when(ps < F.abs(ns), ns - punct).otherwise(ns)
    total = ps2 + F.abs(ns2) + F.col("neu")
    has = F.col("n_tok") > 0

    def share(x):
        return F.when(has & (total > 0), round_half_up(F.abs(x / total), 3)).otherwise(F.lit(0.0))

    return [share(ps2).alias("positivity"), share(ns2).alias("negativity"),
            share(F.col("neu")).alias("neutrality"),
            F.when(has, round_half_up(compound, 4)).otherwise(F.lit(0.0)).alias("compound")]


def lexicon_matches(df: DataFrame, id_col: str, text_col: str = "text",
                    max_chars: int | None = None,
                    lexicon: DataFrame | None = None) -> DataFrame:
    """(id, key, n) lexicon words found in each text; the texts of rows that
    share an id (or have none) count together."""
    docs = counted(df.select(F.col(id_col), F.col(text_col).alias("_text")), "_text", max_chars, id_col)
    if lexicon is None:
        listed = [r["token"] for r in _entries() if r["kind"] == "word"]
        found = docs.select(id_col, F.explode(F.transform(places(listed), lambda i: F.get(F.col("keys"), i))).alias("key"))
    else:
        side = lexicon.where(F.col("kind") == "word").select(F.col("token").alias("key")).distinct()
        found = docs.select(id_col, F.explode("keys").alias("key")).join(side, "key", "left_semi").select(id_col, "key")
    return found.groupBy(id_col, "key").agg(F.count("*").cast("long").alias("n"))
