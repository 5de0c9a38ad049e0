"""Language identification by fusing evidence in Bayes' rule.

log P(lang | page) = text + markup + suffix + host, up to a constant:

* text: byte-trigram log-likelihoods, divided by ``OVERLAP`` because every byte
  takes part in three trigrams.  The model is counted on about ``train_rows``
  distinct labelled texts (whole), shared out evenly over the languages and
  drawn per language by a 63-bit hash: a language with fewer texts than its
  share trains on all of them, and every language on one text at least.
* markup: P(declared language | lang), a smoothed confusion table.
* suffix: P(address suffix | lang), likewise.
* host: a prior smoothed hierarchically, host -> domain -> all, by
  (n_host,lang + strength * P(lang | domain)) / (n_host + strength); a page's
  own share is taken out of its host's counts.

The tables of the last three are grouped sums of the text-only posteriors over
the whole input.  They hold one row per declared value, suffix, domain and
host, are summed with partial aggregation and joined back; a host with a third
of all pages is met by a join that adaptive execution can split.  Texts are
scored where they are scanned and never shuffled.

An unknown-language class ('und', every trigram equally likely) competes with
the trained ones.  A row is accepted when its language is not 'und' and its
posterior reaches ``least``.  Missing evidence (null declaration, address or
host) leaves its term out; null or letterless texts are 'und' with
posterior 1 and not accepted; rows are treated one by one, ties go to the
first language by name; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import PIECE, slices, utf8
from .tables import ready, staged, without

TRAIN_ROWS, BUCKETS, OVERLAP, STRENGTH, LEAST = 6000, 1 << 16, 3.0, 5.0, 0.5
#: Languages of a model; its table has ``BUCKETS`` 4-byte numbers for each (64 MB at most).
MAX_LANGUAGES = 255
SMOOTH = 0.5

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, off: np.ndarray):
    """Yield (row, hashed trigram) of pieces of the buffer: letters lower-cased,
    other ASCII as blanks, trigrams of blanks or across rows left out."""
    for lo in range(0, len(data), PIECE):
        x = _FOLD[data[lo:lo + PIECE + 2]].astype(np.uint32)
        if len(x) < 3:
            continue
        code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        at = np.arange(lo, lo + len(code))
        row = np.searchsorted(off, at, side="right") - 1
        ok = (at + 3 <= off[row + 1]) & (code != 0x202020)
        yield row[ok], (((code[ok] * np.uint32(0x9E3779B1)) >> np.uint32(8)) & np.uint32(BUCKETS - 1)).astype(np.int64)


def even_share(sizes: list[int], rows: int) -> float:
    """The bound (1 at least) at which the bounded sizes sum to ``rows``."""
    left = rows
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) >= left:
            return max(1.0, left / (len(sizes) - k))
        left -= n
    return float(max(sizes, default=1))


def hash_limit(level: float, n: int) -> int:
    """Of ``n`` 63-bit hashes about ``level`` are up to this one."""
    whole = (1 << 63) - 1
    return whole if n <= level else min(whole, int(level / n * whole))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS,
          max_languages: int = MAX_LANGUAGES):
    """(languages, log-likelihood table [BUCKETS, languages + 1]); the last
    column is 'und'.  About ``train_rows`` rows are used, whatever the input.
    Texts without any label are an error (nothing could be told from 'und'), and
    so are more than ``max_languages`` distinct labels: the column then holds
    something else, and the model's table would grow with it."""
    ready(docs.sparkSession)
    texts = docs.where(F.col(text_col).isNotNull())
    rows = texts.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).withColumn(
        "h", F.shiftrightunsigned(F.xxhash64("lang", "text"), 1))
    found = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).limit(max_languages + 1).collect()  # a row per language
    if len(found) > max_languages:
        raise ValueError(f"{lang_col} holds more than max_languages={max_languages} distinct labels")
    if not found and not texts.isEmpty():
        raise ValueError(f"no row has a text and a label in {lang_col}")
    level = even_share([r["n"] for r in found], train_rows)
    limits = docs.sparkSession.createDataFrame([(r["lang"], max(r["least"], hash_limit(level, r["n"]))) for r in found],
                                               "lang string, most long")
    sample = (rows.join(F.broadcast(limits), "lang").where("h <= most")              # limits: a row per language
              .dropDuplicates(["lang", "h"]).select("lang", "text"))

    def count(batches):
        sums = {}
        for b in slices(batches, 1):
            langs = b.column(0).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs], np.int64)
            data, off = utf8(b.column(1))
            for row, t in trigrams(data, off):
                got = np.bincount(code[row] * BUCKETS + t, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for k, name in enumerate(names):
                    sums[name] = sums.get(name, 0) + got[k]
        for name, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at := np.flatnonzero(c)), pa.string()),
                                              pa.array(at, pa.int64()), pa.array(c[at], pa.int64())], names=["lang", "gram", "n"])

    got = (sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
           .toPandas())                      # at most languages * BUCKETS rows
    langs = sorted(set(got["lang"]))
    table = np.full((BUCKETS, len(langs) + 1), SMOOTH)
    for k, name in enumerate(langs):
        part = got[got["lang"] == name]
        table[part["gram"], k] += part["n"]
    table[:, -1] = 1
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def text_evidence(rows: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """``rows`` (id, text, then evidence columns) with ``text`` replaced by
    ``scores`` (tempered log-likelihoods), their posterior ``p`` and the number
    of trigrams ``n``."""
    held = rows.sparkSession.sparkContext.broadcast(table)
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]

    def score(batches):
        t = held.value
        for b in slices(batches, 1):
            data, off = utf8(b.column(1))
            total, n = np.zeros((b.num_rows, t.shape[1])), np.zeros(b.num_rows, np.int64)
            for row, g in trigrams(data, off):
                if not len(row):
                    continue
                first = np.flatnonzero(np.diff(row, prepend=-1))
                total[row[first]] += np.add.reduceat(t[g], first, axis=0, dtype=np.float64)
                n += np.bincount(row, minlength=b.num_rows)
            rest = [b.column(k) for k in range(b.num_columns) if k != 1]
            total /= OVERLAP
            yield pa.RecordBatch.from_arrays(
                [*rest, _lists(total), _lists(_softmax(total)), pa.array(n, pa.int64())],
                names=[b.schema.names[k] for k in range(b.num_columns) if k != 1] + ["scores", "p", "n"])

    return rows.mapInArrow(score, ", ".join([*types, "scores array<double>", "p array<double>", "n long"]))


def fuse(met: DataFrame, names: list[str], strength: float, least: float) -> DataFrame:
    """The last step, row by row: ``met`` has the scores, the host's sums
    (``own``) with what they are smoothed towards (``up``), the sums of all rows
    and the log-likelihoods of the declaration and the suffix."""
    n = len(names)
    id_type = met.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            col = {k: b.column(i) for i, k in enumerate(b.schema.names)}
            scores, p = _matrix(col["scores"], n)[0], _matrix(col["p"], n)[0]
            (own, there), up, every = _matrix(col["own"], n), _matrix(col["up"], n)[0], _matrix(col["all"], n)[0]
            others = np.maximum(own - p, 0)
            prior = np.where(there[:, None], (others + strength * up) / (others.sum(axis=1, keepdims=True) + strength),
                             every / every.sum(axis=1, keepdims=True))
            posterior = _softmax(scores + np.log(prior) + _matrix(col["declared_log"], n)[0] + _matrix(col["suffix_log"], n)[0])
            read = np.asarray(col["n"]) > 0
            best, text = posterior.argmax(axis=1), p.argmax(axis=1)
            sure = np.where(read, posterior.max(axis=1), 1.0)
            lang = np.where(read, np.array(names)[best], "und")
            yield pa.RecordBatch.from_arrays(
                [col["id"], pa.array(lang), pa.array(sure), pa.array(np.where(read, np.array(names)[text], "und")), col["declared"],
                 col["suffix"], col["host"], col["domain"], pa.array((lang != "und") & (sure >= least))],
                names=["id", "lang", "posterior", "text_lang", "declared", "suffix", "host", "domain", "accepted"])

    return met.mapInArrow(run, f"id {id_type}, lang string, posterior double, text_lang string, declared string, suffix string, "
                               "host string, domain string, accepted boolean")


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _lists(x: np.ndarray) -> pa.Array:
    off = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(x).ravel()))


def _matrix(col, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array column of ``n`` doubles (nulls as zeros), and which are there."""
    there = np.asarray(col.is_valid())
    out = np.zeros((len(col), n))
    out[there] = col.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return out, there


def _sums(n: int) -> list[Column]:
    return [F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(n)]


def identify(rows: DataFrame, langs: list[str], table: np.ndarray, strength: float = STRENGTH,
             least: float = LEAST) -> DataFrame:
    """``rows`` has id, text, declared, suffix, host and domain (any of the
    last four may be null).  One row each: id, lang, posterior, text_lang,
    accepted and the evidence."""
    names = [*langs, "und"]
    n = len(names)
    scored = staged(text_evidence(rows, langs, table), "evidence")
    known = scored.where("n > 0")

    def likelihood(column: str) -> DataFrame:
        """log P(value | lang), one row per value."""
        by = known.where(F.col(column).isNotNull()).groupBy(column).agg(*_sums(n))
        whole = by.agg(*[F.sum(f"s{k}").alias(f"t{k}") for k in range(n)], F.count("*").alias("values"))
        p = [F.log((F.col(f"s{k}") + SMOOTH) / (F.col(f"t{k}") + SMOOTH * F.col("values"))) for k in range(n)]
        return by.crossJoin(F.broadcast(whole)).select(F.col(column), F.array(*p).alias(f"{column}_log"))  # whole: one row

    whole = known.agg(*_sums(n)).select(F.array(*[
        (F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + SMOOTH) for k in range(n)]).alias("all"))
    share = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda u, v: u + v))
    smoothed = lambda own, up: F.transform(
        F.zip_with(own, up, lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
        lambda z: (z["x"] + strength * z["y"]) / (F.aggregate(own, F.lit(0.0), lambda u, v: u + v) + strength))
    arrays = lambda by: by.select(*[c for c in by.columns if c[0] != "s" or not c[1:].isdigit()],
                                  F.array(*[F.col(f"s{k}") for k in range(n)]).alias("own"))
    domains = arrays(known.where("domain is not null").groupBy("domain").agg(*_sums(n)))
    domains = domains.select("domain", F.col("own").alias("domain_own"))
    hosts = arrays(known.where("host is not null").groupBy("host", "domain").agg(*_sums(n)))
    hosts = (hosts.join(domains, "domain", "left").crossJoin(F.broadcast(whole))     # whole: one row
             .withColumn("up", F.when(F.col("domain_own").isNull(), share(F.col("all")))
                         .otherwise(smoothed(F.col("domain_own"), share(F.col("all")))))
             .select(F.col("host").alias("h"), F.col("domain").alias("d"), "own", "up"))
    out = (scored.join(likelihood("declared"), "declared", "left").join(likelihood("suffix"), "suffix", "left")
           .join(hosts, (F.col("host") == F.col("h")) & F.col("domain").eqNullSafe(F.col("d")), "left")
           .crossJoin(F.broadcast(whole)))                                           # whole: one row
    return fuse(out.select("id", "scores", "p", "n", "own", "up", "all", "declared_log", "suffix_log",
                           "declared", "suffix", "host", "domain"), names, strength, least)


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Evidence of raw pages: visible text, the language that the markup
    declares, and suffix, domain (two labels) and host of the address."""
    html = F.col(html_col).cast("string")
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"&[A-Za-z]+;|&#[0-9A-Za-z]+;", " ")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select(F.col(id_col).alias("id"), text.alias("text"), blank(declared).alias("declared"),
                        blank(host).alias("host")).withColumns({
        "suffix": blank(F.regexp_extract("host", r"\.([^.]+)$", 1)),
        "domain": blank(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))}).select(
            "id", "text", "declared", "suffix", "host", "domain")


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                    least: float = LEAST) -> DataFrame:
    """The documents, all columns as they were, that are accepted; a document's
    source stands for its host.  Documents have no markup and no address.  The
    decision is per row: text and source, not the id, say which row it is."""
    langs, table = train(docs, text_col, lang_col)
    text, source = F.col(text_col).cast("string"), F.col(source_col).cast("string")
    key = F.xxhash64(text, source)
    none = F.lit(None).cast("string")
    rows = docs.select(key.alias("id"), text.alias("text"), none.alias("declared"), none.alias("suffix"),
                       source.alias("host"), none.alias("domain"))
    return without(docs, key, identify(rows, langs, table, least=least).where("not accepted").select("id"))
