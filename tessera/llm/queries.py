"""Registered queries of the training-data operators.

Each query applies its operator with production parameters to the whole
table and derives the contract's columns from the operator's outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as _decontaminate
from . import neardup as _neardup
from . import repeats as _repeats
from . import licenses as _licenses
from . import chunks as _chunks
from . import langid as _langid
from . import quality as _quality
from . import mixing as _mixing
from . import sharding as _sharding
from . import fingerprints as _fingerprints
from . import centroids as _centroids
from . import whitening as _whitening
from . import vectordup as _vectordup
from .tables import table


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neardup.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeats.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_segments", F.size("licenses").cast("long").alias("n_matches"),
        F.expr("get(licenses, 0).license").alias("license"), F.expr("get(licenses, 0).dice").alias("dice"),
        F.array_join(F.expr("array_sort(array_distinct(licenses.license))"), ",").alias("licenses"))


def op9_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks.drop_repeated_chunks(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_chunks", "n_repeated", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, likelihoods = _langid.train(table(spark, sf_dir, "documents"))
    found = _langid.identify(_langid.page_rows(table(spark, sf_dir, "pages")), langs, likelihoods)
    return found.withColumnRenamed("id", "page_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 of low quality, 2 good; selected are the good."""
    docs = table(spark, sf_dir, "documents")
    ratings = table(spark, sf_dir, "labels").select("doc_id", F.expr(
        "case when toxic = 1 then 0 when quality = 0 then 1 when quality = 1 then 2 end").alias("grade"))
    return _quality.score(docs, _quality.train(docs, ratings, 3), at_least=2)


#: Domains of the sources by the number in their name, and the target weights.
DOMAINS = ["web", "books", "news", "forum"]
WEIGHTS = {"domain": {"web": 4, "books": 3, "news": 2, "forum": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}


def domain_of(source: str = "source"):
    number = F.regexp_extract(F.col(source).cast("string"), r"(\d+)$", 1)
    return F.when(number != "", F.get(F.array(*map(F.lit, DOMAINS)),
                                      F.pmod(number.cast("decimal(38,0)"), F.lit(len(DOMAINS))).cast("int"))).otherwise(F.lit("other"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, at most two epochs of a source."""
    return _mixing.mix_sources(table(spark, sf_dir, "documents"), domain_of(), F.floor(F.col("n") / 2), WEIGHTS)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharding.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fingerprints.fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))[0]


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    return (_whitening.whiten(table(spark, sf_dir, "embeddings"))
            .select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "explained", "identity_error",
                    F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                    F.get("explained", F.col("at")).alias("explained"), "identity_error"))


def op13_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectordup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op3_decontaminate": op3_decontaminate,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_repeats": op5_repeats,
        "op8_licenses": op8_licenses,
        "op9_chunks": op9_chunks,
        "op2_language": op2_language,
        "op6_quality": op6_quality,
        "op7_mixing": op7_mixing,
        "op10_sharding": op10_sharding,
        "op1_fingerprints": op1_fingerprints,
        "op11_centroids": op11_centroids,
        "op12_whitening": op12_whitening,
        "op13_vector_duplicates": op13_vector_duplicates,
    }


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_sql(text: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), "
            r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


OP3_SQL = f"""WITH b AS (SELECT item_id::VARCHAR AS item, {words_sql('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
bn AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bi AS (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bi),
d AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
dn AS (SELECT doc_id, w, s.n FROM d, (SELECT DISTINCT n FROM bw) AS s WHERE len(w) >= s.n),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dn),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM di),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON bw.win = dw.win AND bw.n = dw.n),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
np AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN np ON np.doc_id = d.doc_id LEFT JOIN ni ON ni.doc_id = d.doc_id"""

OP4_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
  '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
di AS (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS s FROM di),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT x, y FROM shared JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
link AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach AS (SELECT x AS a, x AS b FROM link UNION SELECT reach.a, link.y FROM reach JOIN link ON link.x = reach.b),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(sz.n, 0)::BIGINT AS n_shingles, coalesce(comp.c, d.doc_id)::BIGINT AS component_id,
  coalesce(comp.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sz ON sz.doc_id = d.doc_id LEFT JOIN comp ON comp.doc_id = d.doc_id"""

_TEMPLATES = ", ".join("('" + n + "', '" + t.replace("'", "''") + "')" for n, t in _licenses.TEMPLATES)
_BIGRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
OP8_SQL = f"""WITH tp AS (SELECT name, {words_sql('t')} AS w FROM (VALUES {_TEMPLATES}) AS v(name, t)),
tb AS (SELECT name, {_BIGRAMS} AS tbg FROM tp),
ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
lw AS (SELECT doc_id, line, {words_sql('t')} AS w FROM ln),
many AS (SELECT doc_id FROM lw WHERE len(w) > 0 GROUP BY doc_id HAVING count(*) > 1),
sg AS (SELECT doc_id, line, w FROM lw UNION ALL
  SELECT documents.doc_id, -1, {words_sql('text')} FROM documents JOIN many ON many.doc_id = documents.doc_id),
bg AS (SELECT doc_id, line, {_BIGRAMS} AS bg FROM sg WHERE len(w) > 1),
m AS (SELECT doc_id, line, name, 2.0 * len(list_intersect(bg, tbg)) / (len(bg) + len(tbg)) AS dice FROM bg, tb
  WHERE len(bg) * {2 - _licenses.DICE} >= {_licenses.DICE} * len(tbg) - 1e-9 AND len(bg) * {_licenses.DICE} <= {2 - _licenses.DICE} * len(tbg) + 1e-9),
f AS (SELECT doc_id, count(*) AS n, arg_min(name, (-dice, name, line)) AS license, max(dice) AS dice FROM m
  WHERE dice >= {_licenses.DICE} GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS names FROM
  (SELECT DISTINCT doc_id, name FROM m WHERE dice >= {_licenses.DICE}) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM bg GROUP BY doc_id)
SELECT documents.doc_id, coalesce(c.n, 0)::BIGINT AS n_segments, coalesce(f.n, 0)::BIGINT AS n_matches, f.license,
  f.dice::DOUBLE AS dice, coalesce(a.names, '') AS licenses
FROM documents LEFT JOIN c ON c.doc_id = documents.doc_id LEFT JOIN f ON f.doc_id = documents.doc_id
LEFT JOIN a ON a.doc_id = documents.doc_id"""


def _rounds_sql() -> str:
    """Lloyd rounds in whole numbers: a_r assigns to the centroids c_r, c_(r + 1) moves them."""
    c = _centroids
    out = []
    for r in range(c.ROUNDS + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT rid, min((d, c)) AS best FROM (SELECT k.rid, c{r}.c,
  list_sum(list_transform(list_zip(k.x, c{r}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM k, c{r}) GROUP BY rid)""")
        if r < c.ROUNDS:
            out.append(f"""m{r} AS (SELECT c, i, sum(v) AS s, count(*) AS n FROM (SELECT a{r}.best[2] AS c, unnest(k.x) AS v,
  unnest(range(1, {c.DIMS + 1})) AS i FROM k JOIN a{r} ON a{r}.rid = k.rid) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(g.x, c{r}.x) AS x FROM c{r} LEFT JOIN
  (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM m{r} GROUP BY c) AS g ON g.c = c{r}.c)""")
    return ",\n".join(out)


OP11_SQL = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
  list_transform(embedding, lambda x: floor({_centroids.SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {_centroids.DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {_centroids.DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('{_centroids.SEED}:' || vec_id) AS h, x
  FROM k WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {_centroids.CLUSTERS})),
{_rounds_sql()}
SELECT k.vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
  (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(f.x, ',')) AS centroid_sha256
FROM k JOIN a{_centroids.ROUNDS} AS a ON a.rid = k.rid JOIN c{_centroids.ROUNDS} AS f ON f.c = best[2]"""


def oracle_sql() -> dict[str, str]:
    """SQL where it is quick enough over the whole tables; the others are tested
    against brute-force versions."""
    return {
        "op3_decontaminate": OP3_SQL,
        "op4_near_duplicates": OP4_SQL,
        "op8_licenses": OP8_SQL,
        "op11_centroids": OP11_SQL,
    }
