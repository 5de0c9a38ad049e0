"""DuckDB SQL fragments mirroring the text operators (oracle side).

These restate the operators' rules in SQL from their documented semantics so
that the oracle is computed by a different engine.
"""

from __future__ import annotations

from .. import defaults
from ..functions import html as H
from .common import lit, round6, rx_sub, strip_ws, values, words


# The patterns of the page rules as DuckDB's engine takes them (no possessive
# repetition, no lookahead).
TAG_REST = r"""(?:[^"'>]|"[^"]*"|'[^']*')*>"""
HIDDEN = (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->")
TITLE = rf"(?is)<title\b{TAG_REST}(.*?)</title\s*>"
HEADING = rf"(?is)<h[1-3]\b{TAG_REST}(.*?)</h[1-3]\s*>"
P_OPEN = rf"(?i)<p(?:>|\s{TAG_REST})"
A_TAG = rf"(?is)<a[\s/]{TAG_REST}"
ATTRIBUTE = r"""(?is)([^\s"'>=/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def decode(x: str) -> str:
    named = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in H.ENTITIES.items())
    name = f"regexp_extract(p, {lit(H.RE_ENTITY)}, 1)"
    point = f"CASE WHEN starts_with(lower({name}), '#x') THEN ('0x' || substring({name}, 3))::BIGINT " \
            f"WHEN starts_with({name}, '#') THEN substring({name}, 2)::BIGINT END"
    ch = (f"CASE WHEN starts_with({name}, '#') THEN CASE WHEN ({point}) BETWEEN 1 AND 1114111 AND ({point}) NOT BETWEEN 55296 AND 57343 "
          f"THEN chr(({point})::INTEGER) END ELSE CASE {name} {named} END END")
    piece = f"CASE WHEN i = 1 THEN p WHEN ({ch}) IS NULL THEN '&' || p ELSE ({ch}) || substring(p, length({name}) + 2) END"
    return f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: {piece}), '')"


def text_of(x: str) -> str:
    return strip_ws(decode(rx_sub(x, f"<{TAG_REST}")))


def clean_html(x: str) -> str:
    for hidden in HIDDEN:
        x = rx_sub(x, hidden)
    return x


def links(h: str) -> str:
    """First href of each <a> tag, by its attributes one after another."""
    pairs = f"list_zip(regexp_extract_all(t, {lit(ATTRIBUTE)}, 1), regexp_extract_all(t, {lit(ATTRIBUTE)}, 2))"
    first = f"list_transform(list_filter({pairs}, lambda z: lower(z[1]) = 'href'), lambda z: z[2])[1]"
    found = f"list_transform(regexp_extract_all({h}, {lit(A_TAG)}), lambda t: {first})"
    return f"list_transform(list_filter({found}, lambda q: q IS NOT NULL), lambda q: {decode(rx_sub('q', H.RE_QUOTES))})"


def page_cte(src: str = "pages") -> str:
    """CTE 'pe' with (page_id, url, title, headings, paragraphs, links, text)."""
    paras_html = rx_sub(rx_sub(rx_sub("h", P_OPEN, "</p><p>"), H.RE_BLOCK_CLOSE, "</p>\\1"), H.RE_BLOCK_OPEN, "</p>\\1") + " || '</p>'"
    return f"""pc AS (SELECT page_id, url, {clean_html('html')} AS h FROM {src}),
pe0 AS (SELECT page_id, url,
  CASE WHEN NOT regexp_matches(h, {lit(H.RE_TITLE_TAG)}) THEN {lit(H.NO_TITLE)}
       ELSE nullif({decode(f"regexp_extract(h, {lit(TITLE)}, 1)")}, '') END AS title,
  list_transform(regexp_extract_all(h, {lit(HEADING)}, 1), lambda x: {text_of('x')}) AS headings,
  list_transform(regexp_extract_all({paras_html}, {lit(H.RE_PARAGRAPH)}, 1), lambda x: {text_of('x')}) AS paragraphs,
  {links('h')} AS links
  FROM pc),
pe AS (SELECT *, array_to_string(list_concat(headings, paragraphs), ' ') AS text FROM pe0)"""


def lexicon_values() -> str:
    return values(defaults.lexicon_rows(),
                  ["token", "kind", "valence", "polarity", "subjectivity", "boost", "intensity"], "lx")


# Stated here on their own, not taken from the operator.
EDGE_SIGNS = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
UPPER, LOWER = r"\p{Lu}", r"\p{Ll}"


def sentiment_ctes(src: str, id_col: str, text_expr: str, name: str = "senti") -> str:
    """CTEs ending in ``name``(id, polarity, subjectivity, positivity, negativity,
    neutrality, compound), one row per row of ``src``."""
    d = defaults
    lags = []
    for k in (1, 2, 3):
        lags += [f"lag(kind, {k}) OVER w AS k{k}", f"lag(boost, {k}) OVER w AS b{k}", f"lag(key, {k}) OVER w AS w{k}",
                 f"lag(caps, {k}) OVER w AS c{k}", f"lag(valence, {k}) OVER w AS pv{k}"]
    lags.append("lag(intensity, 1) OVER w AS i1")
    neg = {k: f"coalesce(k{k} = 'negation' OR contains(w{k}, 'n''t'), FALSE)" for k in (1, 2, 3)}
    so = {k: f"coalesce(w{k} IN ('so', 'this'), FALSE)" for k in (1, 2, 3)}
    at = lambda k, w: f"coalesce(w{k} = '{w}', FALSE)"
    cases = {
        1: f"WHEN {neg[1]} THEN {d.VADER_NEGATE}",
        2: f"WHEN {at(2, 'never')} AND {so[1]} THEN 1.25 WHEN {at(2, 'without')} AND {at(1, 'doubt')} THEN 1.0 "
           f"WHEN {neg[2]} THEN {d.VADER_NEGATE}",
        3: f"WHEN ({at(3, 'never')} AND {so[2]}) OR {so[1]} THEN 1.25 "
           f"WHEN {at(3, 'without')} AND ({at(2, 'doubt')} OR {at(1, 'doubt')}) THEN 1.0 WHEN {neg[3]} THEN {d.VADER_NEGATE}"}
    steps = ""
    for k, dec in ((1, 1.0), (2, 0.95), (3, 0.9)):
        open_ = f"w{k} IS NOT NULL AND pv{k} IS NULL"
        steps += f"""
{name}_f{k}a AS (SELECT * REPLACE (x + CASE WHEN x <> 0 AND {open_} AND k{k} = 'booster' THEN
  (CASE WHEN x < 0 THEN -1.0 ELSE 1.0 END) * (b{k} + CASE WHEN c{k} AND cd THEN {d.VADER_CAPS} ELSE 0.0 END) * {dec} ELSE 0.0 END AS x)
  FROM {name}_f{k - 1}),
{name}_f{k} AS (SELECT * REPLACE (x * CASE WHEN NOT ({open_}) THEN 1.0 {cases[k]} ELSE 1.0 END AS x) FROM {name}_f{k}a),"""
    return f"""{name}_d AS (SELECT {id_col} AS id, {text_expr} AS t FROM {src}),
{name}_d2 AS (SELECT id, length(t) - length(replace(t, '!', '')) AS n_excl,
  length(t) - length(replace(t, '?', '')) AS n_qm, {words('t')} AS ws FROM {name}_d),
{name}_tk AS (SELECT id, n_excl, n_qm, unnest(ws) AS raw, generate_subscripts(ws, 1) - 1 AS pos FROM {name}_d2),
{name}_tk2 AS (SELECT *, CASE WHEN length(st) <= 2 THEN raw ELSE st END AS word
  FROM (SELECT *, {rx_sub('raw', EDGE_SIGNS)} AS st FROM {name}_tk)),
{name}_tk3 AS (SELECT *, lower(word) AS key,
  regexp_matches(word, {lit(UPPER)}) AND NOT regexp_matches(word, {lit(LOWER)}) AS caps FROM {name}_tk2),
{name}_j AS (SELECT a.*, lx.kind, lx.valence, lx.polarity, lx.subjectivity, lx.boost, lx.intensity
  FROM {name}_tk3 a LEFT JOIN {lexicon_values()} ON a.key = lx.token),
{name}_w AS (SELECT *, sum(caps::INT) OVER (PARTITION BY id) AS n_caps, count(*) OVER (PARTITION BY id) AS n_tw,
  min(CASE WHEN key = 'but' THEN pos END) OVER (PARTITION BY id) AS but_pos, {", ".join(lags)}
  FROM {name}_j WINDOW w AS (PARTITION BY id ORDER BY pos)),
{name}_v AS (SELECT *, coalesce(valence, 0.0) AS v0, (n_caps > 0 AND n_caps < n_tw) AS cd FROM {name}_w),
{name}_f0 AS (SELECT *, v0 + CASE WHEN v0 > 0 AND caps AND cd THEN {d.VADER_CAPS} WHEN v0 < 0 AND caps AND cd THEN -{d.VADER_CAPS} ELSE 0.0 END AS x
  FROM {name}_v),{steps}
{name}_v3 AS (SELECT *, x * CASE WHEN {at(1, 'least')} AND pv1 IS NULL AND NOT coalesce(w2 IN ('at', 'very'), FALSE) THEN {d.VADER_NEGATE} ELSE 1.0 END AS vn
  FROM {name}_f3),
{name}_v4 AS (SELECT id, raw, n_excl, n_qm,
  CASE WHEN but_pos IS NULL THEN vn WHEN pos < but_pos THEN vn * 0.5 WHEN pos > but_pos THEN vn * 1.5 ELSE vn END AS vf,
  CASE WHEN polarity IS NOT NULL THEN polarity * (CASE WHEN k1 = 'booster' THEN i1 ELSE 1.0 END)
       * (CASE WHEN {neg[1]} OR {neg[2]} THEN -0.5 ELSE 1.0 END) END AS p,
  CASE WHEN polarity IS NOT NULL THEN subjectivity * (CASE WHEN k1 = 'booster' THEN i1 ELSE 1.0 END) END AS sj
  FROM {name}_v3),
{name}_a AS (SELECT id, count(raw) AS n_tok, coalesce(sum(vf), 0.0) AS s,
  coalesce(sum(CASE WHEN vf > 0 THEN vf + 1 END), 0.0) AS pos_sum,
  coalesce(sum(CASE WHEN vf < 0 THEN vf - 1 END), 0.0) AS neg_sum,
  count(CASE WHEN vf = 0 THEN 1 END) AS neu, avg(p) AS p, avg(sj) AS sj FROM {name}_v4 GROUP BY id),
{name}_b AS (SELECT d2.id, coalesce(a.n_tok, 0) AS n_tok, coalesce(a.s, 0.0) AS s, coalesce(a.pos_sum, 0.0) AS pos_sum,
  coalesce(a.neg_sum, 0.0) AS neg_sum, coalesce(a.neu, 0) AS neu, a.p, a.sj,
  least(d2.n_excl, 4) * {d.VADER_EXCLAIM}
   + CASE WHEN d2.n_qm <= 1 THEN 0.0 WHEN d2.n_qm <= 3 THEN d2.n_qm * {d.VADER_QUESTION} ELSE 0.96 END AS punct
  FROM {name}_d2 d2 LEFT JOIN {name}_a a ON d2.id = a.id),
{name}_c AS (SELECT *, CASE WHEN s > 0 THEN s + punct WHEN s < 0 THEN s - punct ELSE s END AS s2,
  CASE WHEN pos_sum > abs(neg_sum) THEN pos_sum + punct ELSE pos_sum END AS ps2,
  CASE WHEN pos_sum < abs(neg_sum) THEN neg_sum - punct ELSE neg_sum END AS ns2 FROM {name}_b),
{name} AS (SELECT id,
  {round6('greatest(least(coalesce(p, 0.0), 1.0), -1.0)')} AS polarity,
  {round6('greatest(least(coalesce(sj, 0.0), 1.0), 0.0)')} AS subjectivity,
  CASE WHEN n_tok > 0 AND ps2 + abs(ns2) + neu > 0 THEN {round6('abs(ps2 / (ps2 + abs(ns2) + neu))', 3)} ELSE 0.0 END AS positivity,
  CASE WHEN n_tok > 0 AND ps2 + abs(ns2) + neu > 0 THEN {round6('abs(ns2 / (ps2 + abs(ns2) + neu))', 3)} ELSE 0.0 END AS negativity,
  CASE WHEN n_tok > 0 AND ps2 + abs(ns2) + neu > 0 THEN {round6('abs(neu / (ps2 + abs(ns2) + neu))', 3)} ELSE 0.0 END AS neutrality,
  CASE WHEN n_tok > 0 THEN {round6(f'greatest(least(s2 / sqrt(s2 * s2 + {d.VADER_ALPHA}), 1.0), -1.0)', 4)} ELSE 0.0 END AS compound
  FROM {name}_c)"""
