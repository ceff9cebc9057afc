"""The library's queries over inputs derived from the test tables, and the SQL that states the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import similarity, text
from citeweave.operators import library, matching, references, review, tokenise
from citeweave.plans import inputs
from citeweave.plans.inputs import duck, surname
from citeweave.sources.storage import stored

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


# --- Inputs in the form that the operators take ---------------------------------------------------------------------


def _library(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.spark(spark, sf, "library")
    names = F.filter(F.array("a1", "a2", "a3"), lambda x: x.isNotNull())
    return rows.select("lib_ord", "item_key", names.alias("authors"), F.array().cast("array<string>").alias("editors"), "title", F.col("item_year").alias("year"))


def _citations(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.spark(spark, sf, "citations")
    return rows.select("cit_id", "doc_id", F.filter(F.array("c1", "c2"), lambda x: x.isNotNull()).alias("authors"), "has_et_al", F.col("cit_year").alias("year"))


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    """The citations with what a review needs of them."""
    shown = F.coalesce(text.display_text(F.col("authors"), F.col("year"), F.col("has_et_al")), F.lit(""))  # known not to be null, so joins add no filter on it
    more = [shown.alias("display"), (F.col("cit_id") % 21 == 0).alias("in_footnote"), (F.col("cit_id") % 40).cast("int").alias("para_idx"), (F.col("cit_id") % 4 * 10).cast("int").alias("char_start"), (F.col("cit_id") % 4 * 10 + 8).cast("int").alias("char_end")]
    return _citations(spark, sf).select("*", *more)


def _resolved(spark: SparkSession, sf: str) -> matching.Resolved:
    """The cascade over these citations, its answers by profile."""
    return matching.resolved(_shown(spark, sf), _library(spark, sf))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).rows()


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    r = _resolved(spark, sf)
    return review.with_overrides(r.rows().select("cit_id", "profile", "outcome", "item_key", "confidence", "in_footnote"), inputs.spark(spark, sf, "overrides"), r.candidates)


def _unmatched(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return review.unmatched(_results(spark, sf).select("cit_id", "outcome", *columns), inputs.spark(spark, sf, "overrides"))


def _r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


# --- SQL shared by the oracles ----------------------------------------------------------------------------------------

_ROW = "list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len({b}) + 1), lambda j: [j::BIGINT])), lambda r, j: list_append(r, CASE WHEN list_transform(string_split({b}, ''), lambda c: unicode(c)::BIGINT)[j[1]] = e[1] THEN acc[j[1]] + 1 ELSE greatest(acc[j[1] + 1], r[len(r)]) END))"


def _lcs(a: str, b: str) -> str:
    row = _ROW.replace("{b}", b)
    return f"list_reduce(list_prepend(list_transform(range(0, len({b}) + 1), lambda z: 0::BIGINT), list_transform(string_split({a}, ''), lambda c: [unicode(c)::BIGINT])), lambda acc, e: {row})[-1]"


def _ratio(a: str, b: str) -> str:
    total = f"(length({a}) + length({b}))"
    return f"(CASE WHEN {total} = 0 OR {a} = {b} THEN 100.0::DOUBLE ELSE (1 - ({total} - 2 * {_lcs(a, b)}) / {total}::DOUBLE) * 100 END)"


#: Scores of all pairs of a citation and an item with one first letter; a pair of names is scored once.
_PAIRS = f"""{duck("library", "citations")},
names AS (SELECT DISTINCT lower(c1) AS a, lower(a1) AS b FROM citations, library WHERE lower(c1[1]) = lower(a1[1])),
s1s AS (SELECT a, b, {_ratio('a', 'b')} / 100 AS s1 FROM names),
seconds AS (SELECT DISTINCT lower(c2) AS a, lower(a2) AS b FROM citations, library WHERE c2 IS NOT NULL AND a2 IS NOT NULL AND (cit_year::INT - item_year::INT) BETWEEN -1 AND 1 AND lower(c1[1]) = lower(a1[1])),
s2s AS (SELECT a, b, {_ratio('a', 'b')} / 100 AS s2 FROM seconds),
pairs AS (SELECT cit_id, doc_id, cit_year::INT AS y, item_year::INT AS iy, lib_ord, item_key, s1, s2, c2, a2
  FROM citations JOIN library ON lower(c1[1]) = lower(a1[1]) AND (NOT has_et_al OR a3 IS NOT NULL) JOIN s1s ON s1s.a = lower(c1) AND s1s.b = lower(a1) LEFT JOIN s2s ON s2s.a = lower(c2) AND s2s.b = lower(a2)),
scored AS (SELECT *, CASE WHEN c2 IS NOT NULL AND a2 IS NOT NULL THEN s1 * 0.7::DOUBLE + s2 * 0.3::DOUBLE WHEN c2 IS NOT NULL THEN s1 * 0.85::DOUBLE ELSE s1 END AS score FROM pairs),
exact AS (SELECT cit_id, lib_ord, item_key, score, row_number() OVER (PARTITION BY cit_id ORDER BY score DESC, lib_ord) AS rank FROM scored WHERE y = iy AND score >= 0.82::DOUBLE),
near0 AS (SELECT cit_id, lib_ord, item_key, score, iy, row_number() OVER (PARTITION BY cit_id, iy ORDER BY score DESC, lib_ord) AS n FROM scored WHERE abs(y - iy) = 1 AND score >= 0.82::DOUBLE),
near AS (SELECT cit_id, lib_ord, item_key, score * 0.8::DOUBLE AS score, iy::VARCHAR AS suggestion_year FROM (SELECT *, row_number() OVER (PARTITION BY cit_id ORDER BY score DESC, iy) AS k FROM near0 WHERE n = 1) WHERE k = 1),
low0 AS (SELECT cit_id, lib_ord, item_key, CASE WHEN y = iy THEN 0 WHEN iy < y THEN 1 ELSE 2 END AS ord, CASE WHEN y = iy THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS own, s1, s2, c2, a2 FROM pairs WHERE abs(y - iy) <= 1),
low1 AS (SELECT *, CASE WHEN c2 IS NOT NULL AND a2 IS NOT NULL THEN s1 * own * 0.7::DOUBLE + s2 * 0.3::DOUBLE * own ELSE s1 * own END AS score FROM low0),
low AS (SELECT cit_id, lib_ord, item_key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY cit_id ORDER BY score DESC, ord, lib_ord) AS rank FROM low1 WHERE score >= 0.6::DOUBLE AND score < 0.82::DOUBLE) WHERE rank <= 5),
guess AS (SELECT cit_id, lib_ord, item_key, s1 * 0.5::DOUBLE AS score FROM (SELECT c.cit_id, l.lib_ord, l.item_key, s1, row_number() OVER (PARTITION BY c.cit_id ORDER BY s1 DESC, l.lib_ord) AS n FROM citations c JOIN s1s ON s1s.a = lower(c.c1) JOIN library l ON lower(l.a1) = s1s.b) WHERE n = 1 AND s1 >= 0.7::DOUBLE)"""

_CASCADE = f"""{_PAIRS},
e AS (SELECT cit_id, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'matched' END AS outcome, max(CASE WHEN rank = 1 THEN item_key END) AS item_key, max(CASE WHEN rank = 1 THEN score END) AS confidence, '' AS suggestion_year, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END AS n_candidates, list(item_key ORDER BY rank) AS keys, list(score ORDER BY rank) AS scores FROM exact GROUP BY cit_id),
n AS (SELECT cit_id, 'suggestion' AS outcome, item_key, score AS confidence, suggestion_year, 0 AS n_candidates, [item_key] AS keys, [score] AS scores FROM near WHERE cit_id NOT IN (SELECT cit_id FROM e)),
l AS (SELECT cit_id, 'ambiguous' AS outcome, max(CASE WHEN rank = 1 THEN item_key END), max(CASE WHEN rank = 1 THEN score END), '', count(*), list(item_key ORDER BY rank), list(score ORDER BY rank) FROM low WHERE cit_id NOT IN (SELECT cit_id FROM e) AND cit_id NOT IN (SELECT cit_id FROM n) GROUP BY cit_id),
g AS (SELECT cit_id, 'last_resort', item_key, score, '', 0, [item_key], [score] FROM guess WHERE cit_id NOT IN (SELECT cit_id FROM e) AND cit_id NOT IN (SELECT cit_id FROM n) AND cit_id NOT IN (SELECT cit_id FROM l)),
steps AS (SELECT * FROM e UNION ALL SELECT * FROM n UNION ALL SELECT * FROM l UNION ALL SELECT * FROM g),
cascade AS (SELECT c.cit_id, coalesce(outcome, 'unmatched') AS outcome, item_key, coalesce(confidence, 0) AS confidence, coalesce(suggestion_year, '') AS suggestion_year, coalesce(n_candidates, 0) AS n_candidates, keys, scores FROM citations c LEFT JOIN steps USING (cit_id)),
results AS (SELECT cit_id, doc_id, CASE WHEN has_et_al THEN concat('(', c1, ' et al., ', cit_year, ')') WHEN c2 IS NULL THEN concat('(', c1, ', ', cit_year, ')') ELSE concat('(', c1, ' & ', c2, ', ', cit_year, ')') END AS display, cit_id % 21 = 0 AS in_footnote, (cit_id % 40)::INT AS para_idx, (cit_id % 4 * 10)::INT AS char_start, (cit_id % 4 * 10 + 8)::INT AS char_end, cascade.* EXCLUDE (cit_id) FROM citations JOIN cascade USING (cit_id)),
{duck("overrides")},
reviewed AS (SELECT r.*, action, pick, coalesce(action = 'unmatch', false) AS undone, CASE WHEN action = 'pick' AND n_candidates > pick THEN pick + 1 END AS chosen FROM results r LEFT JOIN overrides USING (cit_id)),
after AS (SELECT * EXCLUDE (outcome, item_key, confidence), CASE WHEN undone THEN 'unmatched' WHEN chosen IS NOT NULL THEN 'matched' ELSE outcome END AS outcome, CASE WHEN NOT undone THEN coalesce(keys[chosen], item_key) END AS item_key, CASE WHEN undone THEN 0 ELSE coalesce(scores[chosen], confidence) END AS confidence, NOT undone AND coalesce(action = 'accept', false) AND outcome = 'suggestion' AS accepted FROM reviewed)"""

# --- Similarity and scalar functions ----------------------------------------------------------------------------------

_NAME_PAIRS = f"SELECT p_partkey AS k, {surname('p_partkey * 7')} AS a, {surname('p_partkey * 11 + 3')} AS b FROM {{part}}"


def _sql(spark: SparkSession, sf: str, statement: str, *tables: str) -> DataFrame:
    return spark.sql(statement, **{t: spark.read.parquet(f"{sf}/{t}.parquet") for t in tables})


def _plain(statement: str) -> str:
    return statement.replace("{", "").replace("}", "")


@query(f"WITH pairs AS ({_plain(_NAME_PAIRS)}) SELECT k, a, b, round({_ratio('a', 'b')}, 6) AS ratio FROM pairs")
def q_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _NAME_PAIRS, "part").withColumn("ratio", F.round(similarity.indel_ratio(F.col("a"), F.col("b")), 6))


_TITLE_PAIRS = "SELECT x.p_partkey AS k, concat(x.p_name, '-', x.p_brand) AS a, concat(y.p_brand, ' ', y.p_name) AS b FROM {part} x JOIN {part} y ON y.p_partkey = x.p_partkey + 1"
_SORTED = "array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(lower({}), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')), ' ')"


@query(f"WITH pairs AS ({_plain(_TITLE_PAIRS)}), t AS (SELECT k, {_SORTED.format('a')} AS a, {_SORTED.format('b')} AS b FROM pairs) SELECT k, round({_ratio('a', 'b')}, 6) AS ratio FROM t")
def q_token_sort(spark: SparkSession, sf: str) -> DataFrame:
    form = lambda c: similarity.title_form(F.col(c))
    return _sql(spark, sf, _TITLE_PAIRS, "part").select("k", F.round(similarity.token_sort_ratio(form("a"), form("b")), 6).alias("ratio"))


_YEARS = "SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN '2020a' WHEN 1 THEN 'In  Press' WHEN 2 THEN 'n. d.' WHEN 3 THEN 'Forthcoming' WHEN 4 THEN 'accepted' WHEN 5 THEN 'Unpublished' WHEN 6 THEN '19997' WHEN 7 THEN 'c. 1900' ELSE cast(1900 + o_orderkey % 120 AS string) END AS y FROM {orders}"


@query(f"WITH t AS ({_plain(_YEARS)}), w AS (SELECT k, y, regexp_replace(lower(y), '[\\s.]+', '', 'g') AS w FROM t) SELECT k, CASE WHEN regexp_matches(y, '^\\d{{4}}') THEN y[1:4] WHEN w LIKE 'forth%' THEN 'forthcoming' WHEN w LIKE '%press%' OR w LIKE 'inp%' THEN 'inpress' WHEN w LIKE 'accept%' THEN 'accepted' WHEN w LIKE 'unpub%' THEN 'unpublished' ELSE w END AS year FROM w")
def q_norm_year(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _YEARS, "orders").select("k", text.normalize_year(F.col("y")).alias("year"))


_NAMES = f"SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN concat('J. ', {surname('o_orderkey')}, ' & ', {surname('o_orderkey + 5')}) WHEN 1 THEN concat('van der ', {surname('o_orderkey')}, ' et al.') WHEN 2 THEN concat({surname('o_orderkey')}, ', ', {surname('o_orderkey * 3')}, ' and M ', {surname('o_orderkey * 5')}) WHEN 3 THEN concat({surname('o_orderkey')}, '''s') ELSE concat('J.-K. ', {surname('o_orderkey')}, ' m.fl.') END AS raw FROM {{orders}}"
_SPLIT = "list_filter(list_transform(string_split_regex(regexp_replace(raw, '\\s+(?i:et\\.?\\s+al\\.?|m\\.?\\s*fl\\.?)', '', 'g'), '\\s*(?:[,&]|\\band\\b)\\s*'), lambda p: regexp_replace(trim(regexp_replace(p, '^(?:(?:[A-Z]\\.[\\s-]*)|(?:[A-Z]\\s+))+', '')), '''s$', '')), lambda p: p <> '')"


@query(f"WITH t AS ({_plain(_NAMES)}) SELECT k, array_to_string({_SPLIT}, '|') AS authors, len({_SPLIT}) AS n FROM t")
def q_split_authors(spark: SparkSession, sf: str) -> DataFrame:
    a = text.split_authors(F.col("raw"))
    return _sql(spark, sf, _NAMES, "orders").select("k", F.array_join(a, "|").alias("authors"), F.size(a).cast("long").alias("n"))


_PARTS = "('" + "','".join(text.PARTICLES) + "')"


@query(f"WITH t AS ({_plain(_NAMES)}), w AS (SELECT k, list_filter(string_split_regex(raw, '\\s+'), lambda w: w <> '') AS ws FROM t) SELECT k, lower(coalesce(list_filter(ws, lambda w: NOT lower(w) IN {_PARTS} AND NOT regexp_matches(w, '^[A-Z]\\.?$'))[1], ws[1])) AS surname FROM w")
def q_surname_key(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _NAMES, "orders").select("k", text.first_surname_key(F.col("raw")).alias("surname"))


@query(f"WITH t AS ({_plain(_NAMES)}) SELECT k, regexp_replace(raw, '^(?i:(?:{'|'.join(text.PARTICLES)})\\s+)+', '') AS name FROM t")
def q_strip_particles(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _NAMES, "orders").select("k", text.strip_particles(F.col("raw")).alias("name"))


@query(f"WITH t AS ({_plain(_NAMES)}), a AS (SELECT k, {_SPLIT} AS s, k % 7 = 0 AS e FROM t) SELECT k, CASE WHEN len(s) = 0 THEN '(2001)' WHEN NOT e AND len(s) = 1 THEN concat('(', s[1], ', 2001)') WHEN NOT e AND len(s) = 2 THEN concat('(', s[1], ' & ', s[2], ', 2001)') ELSE concat('(', s[1], ' et al., 2001)') END AS display FROM a")
def q_display(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sql(spark, sf, _NAMES, "orders").select("k", text.split_authors(F.col("raw")).alias("s"))
    return rows.select("k", text.display_text(F.col("s"), F.lit("2001"), F.col("k") % 7 == 0).alias("display"))


_LOCATORS = "SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN concat(', p. ', cast(o_orderkey % 500 AS string)) WHEN 1 THEN concat(': ', cast(o_orderkey % 90 AS string), '-', cast(o_orderkey % 90 + 7 AS string)) WHEN 2 THEN concat(', ch. ', cast(o_orderkey % 12 AS string)) WHEN 3 THEN concat(', sec. ', cast(o_orderkey % 12 AS string)) WHEN 4 THEN ' none' ELSE ', pp. 4 - 9' END AS t FROM {orders}"


@query(f"WITH t AS ({_plain(_LOCATORS)}), m AS (SELECT k, trim(regexp_extract(t, '(?:,|\\s*:)\\s*(pp?\\.\\s*|ch\\.\\s*|sec\\.\\s*)?(\\d{{1,4}}(?:\\s*[–\\-]\\s*\\d{{1,4}})?)', 2)) AS value, regexp_extract(t, '(?:,|\\s*:)\\s*(pp?\\.\\s*|ch\\.\\s*|sec\\.\\s*)?(\\d{{1,4}}(?:\\s*[–\\-]\\s*\\d{{1,4}})?)', 1) AS p FROM t) SELECT k, value, CASE WHEN p LIKE 'ch%' THEN 'chapter' WHEN p LIKE 'sec%' THEN 'section' ELSE 'page' END AS label FROM m")
def q_locator(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _LOCATORS, "orders").select("k", text.locator(F.col("t")).alias("l")).select("k", "l.value", "l.label")


_ENTRIES = f"SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN concat({surname('o_orderkey')}, ', A., & ', {surname('o_orderkey + 9')}, '. (19', cast(10 + o_orderkey % 89 AS string), 'b). Title.') WHEN 1 THEN concat({surname('o_orderkey')}, ', B. Title without date') ELSE concat('Group & ', {surname('o_orderkey')}, ', 20', cast(10 + o_orderkey % 15 AS string), '. Title') END AS t FROM {{orders}}"
_ENTRY_CHUNK = "regexp_replace(trim(CASE WHEN y <> '' THEN t[1:instr(t, y) - 1] ELSE t[1:50] END), '[\\s,.()\\[\\]]+$', '')"


@query(f"WITH t AS ({_plain(_ENTRIES)}), y AS (SELECT k, t, regexp_extract(t, '\\b(\\d{{4}}[a-z]?)\\b', 1) AS y FROM t), c AS (SELECT k, y, {_ENTRY_CHUNK} AS raw FROM y) SELECT k, y AS year, array_to_string({_SPLIT}, '|') AS authors FROM c")
def q_ref_entry(spark: SparkSession, sf: str) -> DataFrame:
    return _sql(spark, sf, _ENTRIES, "orders").select("k", text.reference_entry(F.col("t")).alias("r")).select("k", "r.year", F.array_join("r.authors", "|").alias("authors"))


_NUMBERS = "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN concat(cast(o_orderkey % 9 AS string), ', ', cast(o_orderkey % 7 + 3 AS string)) WHEN 1 THEN concat(cast(o_orderkey % 9 AS string), '-', cast(o_orderkey % 9 + 3 AS string)) WHEN 2 THEN CASE WHEN o_orderkey % 800 = 2 THEN '1-10500' ELSE '5-3' END ELSE concat('1, ', cast(o_orderkey % 9 + 2 AS string), '–', cast(o_orderkey % 9 + 4 AS string), ', 40') END AS t FROM {orders}"


@query(f"WITH t AS ({_plain(_NUMBERS)}), p AS (SELECT k, unnest(string_split_regex(t, ',\\s*')) AS p FROM t), r AS (SELECT k, CASE WHEN regexp_matches(p, '[–-]') THEN range(regexp_extract(p, '^(\\d+)', 1)::INT, regexp_extract(p, '(\\d+)$', 1)::INT + 1) ELSE [p::BIGINT] END AS ns FROM p) SELECT k, unnest(ns)::INT AS n FROM r")
def q_numbered_expand(spark: SparkSession, sf: str) -> DataFrame:
    spans = _sql(spark, sf, _NUMBERS, "orders").select("k", F.explode(text.number_spans(F.col("t"))).alias("s"))
    return spans.select("k", F.explode(F.sequence("s.low", "s.high")).alias("n"))


# --- References -------------------------------------------------------------------------------------------------------

_PARTICLE = "(?:(?:" + "|".join(text.PARTICLES) + ")\\s+)*"
_ENTRY = f"'(?is)^{_PARTICLE}([A-Z][A-Za-zÀ-ÿ''\\-]{{1,30}}).*?(?:\\(|\\.\\s*|,\\s*)({text.YEAR})(?:\\)|[.\\s,;])'"
_MARKED = f"""{duck("paragraphs")}, m AS (SELECT *, trim(para_text) AS t, trim(para_text) <> '' AND regexp_matches(trim(para_text), {_ENTRY}) AS is_entry, lower(trim(para_text)) IN {tuple(text.HEADINGS)} AS is_heading FROM paragraphs),
h AS (SELECT doc_id, max(para_idx) AS heading_start FROM (SELECT *, coalesce(sum(is_entry::INT) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING), 0) AS n FROM m) WHERE is_heading AND n >= 3 GROUP BY doc_id),
en AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM m) WHERE is_entry AND para_idx >= n // 2),
isl AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY para_idx) AS island FROM (SELECT *, CASE WHEN para_idx - lag(para_idx) OVER (PARTITION BY doc_id ORDER BY para_idx) <= 4 THEN 0 ELSE 1 END AS new FROM en)),
cl AS (SELECT doc_id, cluster_start, n_entries FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_entries DESC, cluster_start) AS k FROM (SELECT doc_id, island, count(*) AS n_entries, min(para_idx) AS cluster_start FROM isl GROUP BY doc_id, island HAVING count(*) >= 5)) WHERE k = 1),
st AS (SELECT d.doc_id, coalesce(heading_start, cluster_start, n)::BIGINT AS ref_start FROM (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id) d LEFT JOIN h USING (doc_id) LEFT JOIN cl USING (doc_id)),
listed AS (SELECT m.doc_id, para_idx, t FROM m JOIN st USING (doc_id) WHERE para_idx >= ref_start),
nums AS (SELECT doc_id, ref_num, arg_max(txt, para_idx) AS text FROM (SELECT doc_id, para_idx, coalesce(nullif(regexp_extract(t, '^\\s*(?:\\[(\\d+)\\]|(\\d+)\\.)\\s+(.+)$', 1), ''), nullif(regexp_extract(t, '^\\s*(?:\\[(\\d+)\\]|(\\d+)\\.)\\s+(.+)$', 2), ''))::INT AS ref_num, trim(regexp_extract(t, '^\\s*(?:\\[(\\d+)\\]|(\\d+)\\.)\\s+(.+)$', 3)) AS txt FROM listed WHERE regexp_matches(t, '^\\s*(?:\\[(\\d+)\\]|(\\d+)\\.)\\s+(.+)$')) WHERE regexp_matches(txt, '\\b\\d{{4}}\\b') GROUP BY doc_id, ref_num),
ays AS (SELECT doc_id, surname, year, arg_min(t, para_idx) AS text, min(para_idx) AS ord FROM (SELECT doc_id, para_idx, t, lower(regexp_extract(t, {_ENTRY}, 1)) AS surname, regexp_extract(t, {_ENTRY}, 2)[1:4] AS year FROM listed WHERE regexp_matches(t, {_ENTRY})) GROUP BY doc_id, surname, year)"""


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.spark(spark, sf, "paragraphs")


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    return references.sectioned(_paragraphs(spark, sf))


@query(f"WITH {_MARKED} SELECT * FROM h")
def q_ref_heading(spark: SparkSession, sf: str) -> DataFrame:
    return references.heading_start(_paragraphs(spark, sf))


@query(f"WITH {_MARKED} SELECT * FROM cl")
def q_ref_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return references.cluster_start(_paragraphs(spark, sf))


@query(f"WITH {_MARKED} SELECT * FROM st")
def q_ref_start(spark: SparkSession, sf: str) -> DataFrame:
    return references.reference_start(_sections(spark, sf))


@query(f"WITH {_MARKED} SELECT m.doc_id, para_idx, para_text FROM m JOIN st USING (doc_id) WHERE para_idx < ref_start")
def q_body(spark: SparkSession, sf: str) -> DataFrame:
    return references.body(_sections(spark, sf))


@query(f"WITH {_MARKED} SELECT * FROM nums")
def q_ref_map_num(spark: SparkSession, sf: str) -> DataFrame:
    return references.numbered_references(_sections(spark, sf))


@query(f"WITH {_MARKED} SELECT * FROM ays")
def q_ref_map_ay(spark: SparkSession, sf: str) -> DataFrame:
    return references.author_year_references(_sections(spark, sf))


def _document_citations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sections = stored(_sections(spark, sf), "sections")
    numbers, names = references.numbered_references(sections), references.author_year_references(sections)
    return references.with_reference_text(tokenise.citations(references.body(sections), numbers), names), numbers, names


#: The citations in the paragraphs, by their known form: "(Name, year)" and "[n, a-b]".
_CITED = f"""{_MARKED}, bd AS (SELECT m.doc_id, para_idx, para_text AS p FROM m JOIN st USING (doc_id) WHERE para_idx < ref_start),
ay AS (SELECT doc_id, para_idx, 'author-year' AS style, NULL::INT AS ref_num, regexp_extract(p, '\\(([A-Z][a-z_]+), (\\d{{4}})\\)', 1) AS name, regexp_extract(p, '\\(([A-Z][a-z_]+), (\\d{{4}})\\)', 2) AS year, instr(p, '(') - 1 AS char_start FROM bd WHERE regexp_matches(p, '\\(([A-Z][a-z_]+), (\\d{{4}})\\)')),
nb0 AS (SELECT doc_id, para_idx, instr(p, '[') - 1 AS char_start, unnest(string_split_regex(regexp_extract(p, '\\[(\\d+(?:\\s*[,–-]\\s*\\d+)*)\\]', 1), ',\\s*')) AS q FROM bd WHERE regexp_matches(p, '\\[(\\d+(?:\\s*[,–-]\\s*\\d+)*)\\]')),
nb AS (SELECT DISTINCT doc_id, para_idx, 'numbered' AS style, unnest(range(regexp_extract(q, '^(\\d+)', 1)::INT, regexp_extract(q, '(\\d+)$', 1)::INT + 1))::INT AS ref_num, char_start FROM nb0),
ct AS (SELECT ay.doc_id, para_idx, style, ref_num, ay.year, concat('(', name, ', ', ay.year, ')') AS display_text, lower(name) AS surname, char_start::INT AS char_start, coalesce(ays.text, '') AS ref_text FROM ay LEFT JOIN ays ON ays.doc_id = ay.doc_id AND ays.surname = lower(name) AND ays.year = ay.year
  UNION ALL SELECT nb.doc_id, para_idx, style, nb.ref_num, regexp_extract(coalesce(nums.text, ''), '\\b(\\d{{4}}[a-z]?)\\b', 1), concat('[', nb.ref_num, ']'), NULL, char_start::INT, coalesce(nums.text, '') FROM nb LEFT JOIN nums ON nums.doc_id = nb.doc_id AND nums.ref_num = nb.ref_num)"""


@query(f"WITH {_CITED} SELECT doc_id, para_idx, style, ref_num, year, display_text, char_start, ref_text FROM ct")
def q_tokenise_full(spark: SparkSession, sf: str) -> DataFrame:
    c, _, _ = _document_citations(spark, sf)
    return c.select("doc_id", "para_idx", "style", "ref_num", "year", "display_text", "char_start", "ref_text")


@query(f"WITH {_CITED} SELECT nums.doc_id, 0 AS kind, nums.ref_num::BIGINT AS ord, concat('[', nums.ref_num, '] ', nums.text) AS text FROM nums ANTI JOIN ct ON ct.doc_id = nums.doc_id AND ct.ref_num = nums.ref_num UNION ALL SELECT ays.doc_id, 1, ays.ord::BIGINT, ays.text FROM ays ANTI JOIN ct ON ct.doc_id = ays.doc_id AND ct.surname = ays.surname AND ct.year = ays.year AND ct.style = 'author-year'")
def q_uncited(spark: SparkSession, sf: str) -> DataFrame:
    c, numbers, names = _document_citations(spark, sf)
    return references.uncited(c, numbers, names)


# The forms of a citation, one paragraph each, and the citations in it: authors, year, others, prefix, suffix, locator,
# kind and the text before it. S and T stand for surnames, Y for a year.
_FORMS = [
    ("As S (Y) has it.", [("S", "Y", False, "", "", "", "page", "As ")]),
    ("S and T (Y, p. 12) agree.", [("S|T", "Y", False, "", "", "12", "page", "")]),
    ("Seen again (S et al., Y).", [("S", "Y", True, "", "", "", "page", "Seen again ")]),
    ("Held (see S Y, ch. 3; cf. T Y, pp. 4-9, with care).", [("S", "Y", False, "see ", "", "3", "chapter", "Held "), ("T", "Y", False, "cf. ", ", with care", "4-9", "page", "Held ")]),
    ("Often (S m.fl. Y; Ya).", [("S", "Y", True, "", "", "", "page", "Often "), ("S", "Ya", True, "", "", "", "page", "Often ")]),
    ("S argues that it holds (Y, 20; T Y).", [("S", "Y", False, "", "", "20", "page", "S argues that it holds "), ("T", "Y", False, "", "", "", "page", "S argues that it holds ")]),
    ("Edited (S, Ed., Y).", [("S", "Y", False, "", "", "", "page", "Edited ")]),
    ("Known (e.g., S & T Y, sec. 7).", [("S|T", "Y", False, "e.g., ", "", "7", "section", "Known ")]),
    ("An office (Office S (OS) Y) said.", [("Office S OS", "Y", False, "", "", "", "page", "An office ")]),
    ("The S Agency (Y) says.", [("S Agency", "Y", False, "", "", "", "page", "The ")]),
    ("Soon (van der S, in press) and (T, n.d.).", [("van der S", "in press", False, "", "", "", "page", "Soon "), ("T", "n.d.", False, "", "", "", "page", "Soon (van der S, in press) and ")]),
    ("In 1990. T wrote “it holds” (Y; S Y).", [("T", "Y", False, "", "", "", "page", "In 1990. T wrote “it holds” "), ("S", "Y", False, "", "", "", "page", "In 1990. T wrote “it holds” ")]),
    ("By J. S (Y) and M T (Y: 88).", [("S", "Y", False, "", "", "", "page", "By J. "), ("T", "Y", False, "", "", "88", "page", "By J. S (Y) and ")]),
    ("It is S's (Y:10–11) view.", [("S", "Y", False, "", "", "10–11", "page", "It is ")]),
    ("All (S, J. T, & van S Y) of them.", [("S|T|van S", "Y", False, "", "", "", "page", "All ")]),
    ("a bare (Y), (see Y), (the S) and S, Y.", []),
]


def _formed(text_: str) -> str:
    """SQL for a text with S, T and Y replaced."""
    parts = re.split(r"\b([ST])\b(?!')|\b([S])(?='s)|(Y)", text_)
    names = {"S": surname("o_orderkey"), "T": surname("o_orderkey + 5"), "Y": "cast(1950 + o_orderkey % 70 AS string)"}
    quoted = [names.get(x) or "'" + x.replace("'", "''") + "'" for x in parts if x]
    return f"concat({', '.join(quoted)})" if quoted else "''"


_FORM_TEXTS = f"SELECT o_orderkey AS doc_id, 0 AS para_idx, CASE o_orderkey % {len(_FORMS)} {' '.join(f'WHEN {k} THEN {_formed(t)}' for k, (t, _) in enumerate(_FORMS))} END AS para_text FROM {{orders}}"


def _form_rows() -> str:
    rows = []
    for k, (_, cites) in enumerate(_FORMS):
        for names, year, others, prefix, suffix, where, kind, before in cites:
            each = names.split("|")
            shown = f"({each[0]} et al., {year})" if others or len(each) > 2 else f"({' & '.join(each)}, {year})"
            columns = {"authors": names.replace("|", " | "), "year": year, "display_text": shown, "prefix": prefix, "suffix": suffix, "locator": where, "locator_label": kind}
            values = ", ".join(f"{_formed(v)} AS {c}" for c, v in columns.items())
            rows.append(f"SELECT o_orderkey AS doc_id, {values}, {str(others).lower()} AS has_et_al, length({_formed(before)})::INT AS char_start FROM orders WHERE o_orderkey % {len(_FORMS)} = {k}")
    return " UNION ALL ".join(rows)


@query(_form_rows())
def q_tokenise_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every form of a citation by author and year: narrative ones, masks, others, prefixes, locators, leading and bare years, quotations, speakers."""
    rows = tokenise.citations(_sql(spark, sf, _FORM_TEXTS, "orders"))
    return rows.select("doc_id", F.array_join("authors", " | ").alias("authors"), "year", "display_text", "prefix", "suffix", "locator", "locator_label", "has_et_al", "char_start")


_PARENS = "'\\((?:[^()]*\\([^()]*\\))*[^()]*\\)'"


@query(f"WITH {duck('paragraphs')} SELECT doc_id, para_idx, chunk, (instr(para_text, chunk) - 1)::INT AS char_start FROM (SELECT *, regexp_extract(para_text, {_PARENS}) AS chunk FROM paragraphs) WHERE length(chunk) BETWEEN 5 AND 502 AND regexp_matches(chunk, '\\d{{4}}|[Ff]orthcoming|[Ii]n\\s+[Pp]ress|[Aa]ccepted|[Nn]\\.?\\s*[Dd]\\.?|[Uu]npublished')")
def q_paren_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks in parentheses with their offsets, natively: what lies between them has the lengths that place them."""
    pattern = tokenise.PAREN.pattern
    p = _paragraphs(spark, sf).select("doc_id", "para_idx", F.regexp_extract_all("para_text", F.lit(pattern), F.lit(0)).alias("chunks"), F.split("para_text", pattern, -1).alias("between"))
    rows = p.select("doc_id", "para_idx", "between", "chunks", F.posexplode("chunks").alias("i", "chunk"))
    length = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    start = length(F.col("between"), F.col("i") + 1) + length(F.col("chunks"), F.col("i"))
    return rows.where((F.length("chunk") >= 5) & (F.length("chunk") <= 502) & F.col("chunk").rlike(tokenise.HAS_YEAR.pattern)).select("doc_id", "para_idx", "chunk", start.alias("char_start"))


_EMITTED = "SELECT o_custkey AS doc_id, cast(o_orderkey % 5 AS int) AS para_idx, cast(o_orderkey % 3 AS int) AS char_start, cast(o_orderkey % 2 AS string) AS raw_text, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE cast(o_orderkey % 4 AS string) END AS display_text, o_orderkey AS emit_ord, 0 AS num_ord FROM {orders}"


@query(f"WITH t AS ({_plain(_EMITTED)}) SELECT doc_id, para_idx, char_start, raw_text, display_text, emit_ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, para_idx, char_start, CASE WHEN display_text <> '' THEN display_text ELSE raw_text END ORDER BY emit_ord) AS n FROM t) WHERE n = 1")
def q_cit_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return tokenise.first_emitted(_sql(spark, sf, _EMITTED, "orders")).drop("num_ord")


# --- Matching ---------------------------------------------------------------------------------------------------------


@query(f"WITH {_PAIRS} SELECT cit_id, lib_ord, item_key, round(score, 6) AS score, rank::INT AS rank FROM exact")
def q_match_ay(spark: SparkSession, sf: str) -> DataFrame:
    return matching.matches(_citations(spark, sf), _library(spark, sf), 82).select("cit_id", "lib_ord", "item_key", _r6("score"), "rank")


@query(f"WITH {_PAIRS} SELECT cit_id, lib_ord, item_key, round(score, 6) AS score FROM exact WHERE rank = 1")
def q_match_best(spark: SparkSession, sf: str) -> DataFrame:
    return matching.best_matches(_citations(spark, sf), _library(spark, sf), 82).select("cit_id", "lib_ord", "item_key", _r6("score"))


@query(f"WITH {_PAIRS} SELECT cit_id, lib_ord, item_key, round(score, 6) AS score, suggestion_year FROM near")
def q_year_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    return matching.year_tolerance(_citations(spark, sf), _library(spark, sf)).select("cit_id", "lib_ord", "item_key", _r6("score"), "suggestion_year")


@query(f"WITH {_PAIRS} SELECT cit_id, lib_ord, item_key, round(score, 6) AS score, rank::INT AS rank FROM low")
def q_low_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return matching.low_candidates(_citations(spark, sf), _library(spark, sf)).select("cit_id", "lib_ord", "item_key", _r6("score"), "rank")


@query(f"WITH {_PAIRS} SELECT cit_id, lib_ord, item_key, round(score, 6) AS score FROM guess")
def q_year_agnostic(spark: SparkSession, sf: str) -> DataFrame:
    return matching.year_agnostic(_citations(spark, sf), _library(spark, sf)).select("cit_id", "lib_ord", "item_key", _r6("score"))


@query(f"WITH {_MARKED}, {duck('citations')}, np AS (SELECT DISTINCT lower(c1) AS a, surname AS b FROM citations JOIN ays USING (doc_id)), ns AS (SELECT a, b, {_ratio('a', 'b')} / 100 AS s FROM np) SELECT cit_id, text AS bibliography_hint FROM (SELECT cit_id, text, s, row_number() OVER (PARTITION BY cit_id ORDER BY s DESC, ord) AS n FROM citations c JOIN ays USING (doc_id) JOIN ns ON ns.a = lower(c1) AND ns.b = surname) WHERE n = 1 AND s >= 0.7::DOUBLE")
def q_bib_hint(spark: SparkSession, sf: str) -> DataFrame:
    return matching.bibliography_hint(_citations(spark, sf), references.author_year_references(_sections(spark, sf)))


#: Every order asks for the title of a part, with its words in another order; one part in 40 for a text that is near to no title.
_TITLES = "SELECT o_orderkey AS cit_id, CASE WHEN p_partkey % 40 = 7 THEN concat('zz ', substr(p_name, 1, 4), ' qx ', p_brand) ELSE concat(p_type, ' ', p_name, CASE WHEN p_partkey % 2 = 0 THEN ', again' ELSE '' END) END AS raw_text, cast(1995 + o_orderkey % 9 AS string) AS year FROM {orders} JOIN {part} ON p_partkey = o_orderkey % (SELECT count(*) FROM {part})"
_ASKED = f"f AS (SELECT cit_id, year, {_SORTED.format('raw_text')} AS a FROM t), h AS (SELECT lib_ord, item_key, item_year, {_SORTED.format('title')} AS b FROM library), d AS (SELECT a, b FROM (SELECT DISTINCT a FROM f), (SELECT DISTINCT b FROM h) WHERE a LIKE '%qx%' OR 200.0 * least(length(a), length(b)) * 1.15::DOUBLE >= 68 * (length(a) + length(b))), r AS (SELECT a, b, {_ratio('a', 'b')} / 100 AS s FROM d)"
_BY_TITLE = f"WITH {duck('library')}, t AS ({_plain(_TITLES)}), {_ASKED}, fy AS (SELECT DISTINCT a, year FROM f), g AS (SELECT a, year, lib_ord, item_key, CASE WHEN year = item_year THEN least(1.0::DOUBLE, s * 1.15::DOUBLE) ELSE s END AS score FROM fy JOIN r USING (a) JOIN h USING (b)), k AS (SELECT a, year, arg_max(lib_ord, (score, -lib_ord)) AS lib_ord, arg_max(item_key, (score, -lib_ord)) AS item_key, max(score) AS score FROM g GROUP BY a, year), tm AS (SELECT cit_id, CASE WHEN score >= 0.68::DOUBLE THEN lib_ord END AS lib_ord, CASE WHEN score >= 0.68::DOUBLE THEN item_key END AS item_key, coalesce(score, 0) AS score, coalesce(score >= 0.68::DOUBLE, false) AS matched FROM f LEFT JOIN k USING (a, year))"


@query(f"{_BY_TITLE} SELECT cit_id, lib_ord, item_key, round(score, 6) AS score, matched FROM tm")
def q_title_fallback(spark: SparkSession, sf: str) -> DataFrame:
    out = matching.title_match(_sql(spark, sf, _TITLES, "orders", "part"), _library(spark, sf))
    return out.select("cit_id", "lib_ord", "item_key", _r6("score"), "matched")


_NUMBERED = f"SELECT c.cit_id, c.cit_year AS year, t.raw_text FROM citations c JOIN ({_plain(_TITLES)}) t ON t.cit_id = c.cit_id"
_BY_TITLE_TOO = _BY_TITLE.replace(f"WITH {duck('library')}, t AS ({_plain(_TITLES)})", f"t AS ({_NUMBERED})")


@query(f"WITH {_PAIRS}, {_BY_TITLE_TOO}, e AS (SELECT cit_id, lib_ord, item_key, score FROM exact WHERE rank = 1 AND cit_id % 3 <> 0) SELECT cit_id, lib_ord, item_key, round(score, 6) AS score FROM (SELECT * FROM e UNION ALL SELECT cit_id, lib_ord, item_key, score FROM tm WHERE cit_id NOT IN (SELECT cit_id FROM e))")
def q_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered citations end to end: by the authors and year of their reference, which every third one lacks, else by its title."""
    none = F.array().cast("array<string>")
    cites = _citations(spark, sf).withColumn("authors", F.when(F.col("cit_id") % 3 != 0, F.col("authors")).otherwise(none))
    cites = cites.join(_sql(spark, sf, _TITLES, "orders", "part").select("cit_id", "raw_text"), "cit_id")
    return matching.numbered(cites, _library(spark, sf)).select("cit_id", "lib_ord", "item_key", _r6("score"))


_RERANK = f"""tx AS (SELECT cit_id, (SELECT {_SORTED.format("concat('Name, A. ', title, '.')")} FROM library l WHERE l.lib_ord = cit_id % (SELECT count(*) FROM library)) AS ref FROM citations),
ti AS (SELECT x.*, {_SORTED.format('title')} AS b, ref AS a FROM (SELECT e.*, title FROM exact e JOIN library USING (lib_ord)) x JOIN tx USING (cit_id)),
td AS (SELECT DISTINCT a, b FROM ti), tr AS (SELECT a, b, {_ratio('a', 'b')} / 100 AS t FROM td),
tw AS (SELECT *, row_number() OVER w AS n, lead(t) OVER w AS nx FROM ti JOIN tr USING (a, b) WINDOW w AS (PARTITION BY cit_id ORDER BY t DESC, rank)),
mv AS (SELECT cit_id, rank AS up FROM tw WHERE n = 1 AND rank > 1 AND t > 0.3 AND t - coalesce(nx, 0) > 0.10)"""


@query(f"WITH {_PAIRS}, {_RERANK} SELECT cit_id, item_key, (CASE WHEN up IS NULL THEN rank WHEN rank = up THEN 1 WHEN rank < up THEN rank + 1 ELSE rank END)::INT AS rank FROM exact LEFT JOIN mv USING (cit_id)")
def q_rerank(spark: SparkSession, sf: str) -> DataFrame:
    cites, lib = _citations(spark, sf), _library(spark, sf)
    refs = lib.select(F.col("lib_ord").alias("ref"), F.concat(F.lit("Name, A. "), F.col("title"), F.lit(".")).alias("ref_text"))
    total = lib.agg(F.count(F.lit(1)).alias("total"))
    cites = cites.join(F.broadcast(total)).withColumn("ref", F.col("cit_id") % F.col("total"))
    return matching.reranked(cites, refs, lib, 82).select("cit_id", "item_key", F.col("rank").cast("int").alias("rank"))


@query(f"WITH {_CASCADE} SELECT cit_id, outcome, item_key, round(confidence, 6) AS confidence, suggestion_year, n_candidates::INT AS n_candidates FROM cascade")
def q_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf).select("cit_id", "outcome", "item_key", _r6("confidence"), "suggestion_year", "n_candidates")


# --- Review and report ------------------------------------------------------------------------------------------------


@query(f"WITH {_CASCADE} SELECT count(*) FILTER (outcome = 'matched') AS matched, count(*) FILTER (outcome = 'ambiguous') AS ambiguous, count(*) FILTER (outcome = 'suggestion') AS suggestions, count(*) AS total, count(*) FILTER (outcome NOT IN ('matched', 'ambiguous', 'suggestion')) AS unmatched FROM cascade")
def q_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return review.status_counts(_results(spark, sf))


@query(f"WITH {_CASCADE} SELECT cit_id, outcome, item_key, round(confidence, 6) AS confidence, accepted FROM after")
def q_apply_overrides(spark: SparkSession, sf: str) -> DataFrame:
    return _reviewed(spark, sf).select("cit_id", "outcome", "item_key", _r6("confidence"), "accepted")


@query(f"WITH {_CASCADE} SELECT cit_id, item_key FROM after WHERE (outcome = 'matched' OR accepted) AND NOT in_footnote")
def q_writable(spark: SparkSession, sf: str) -> DataFrame:
    return review.writable(_reviewed(spark, sf)).select("cit_id", "item_key")


@query(f"WITH {_CASCADE} SELECT count(*) FILTER (outcome = 'matched' OR accepted) AS replaced FROM after")
def q_effective_count(spark: SparkSession, sf: str) -> DataFrame:
    return review.effective_count(_reviewed(spark, sf))


_UNSETTLED = "SELECT * FROM (SELECT r.*, coalesce(action, '') AS act FROM results r LEFT JOIN overrides USING (cit_id)) WHERE NOT ((outcome = 'matched' AND act <> 'unmatch') OR (outcome = 'suggestion' AND act = 'accept') OR (outcome = 'ambiguous' AND act = 'pick'))"


@query(f"WITH {_CASCADE}, u AS ({_UNSETTLED}) SELECT cit_id, display, outcome FROM u")
def q_unmatched_export(spark: SparkSession, sf: str) -> DataFrame:
    return _unmatched(spark, sf, "display").select("cit_id", "display", "outcome")


@query(f"WITH {_CASCADE}, a AS (SELECT doc_id, display, arg_min(action, cit_id) AS action, arg_min(pick, cit_id) AS pick FROM overrides JOIN results USING (cit_id) GROUP BY doc_id, display) SELECT cit_id, action, pick FROM results JOIN a USING (doc_id, display)")
def q_display_propagate(spark: SparkSession, sf: str) -> DataFrame:
    return review.propagated(inputs.spark(spark, sf, "overrides"), _shown(spark, sf))


@query(f"WITH {_CASCADE} SELECT cit_id, CASE WHEN action = 'unmatch' THEN 'unmatched' WHEN outcome = 'suggestion' AND action = 'accept' THEN 'matched' WHEN outcome = 'ambiguous' AND action = 'pick' THEN 'matched' WHEN outcome IN ('matched', 'ambiguous', 'suggestion') THEN outcome ELSE 'unmatched' END AS tab FROM results LEFT JOIN overrides USING (cit_id)")
def q_ui_tabs(spark: SparkSession, sf: str) -> DataFrame:
    return review.tabs(_results(spark, sf), inputs.spark(spark, sf, "overrides"))


@query(f"WITH {_CASCADE} SELECT cit_id, display, outcome, coalesce(r.item_key, '') AS item_key, round_even(confidence * 100, 0)::INT AS confidence, coalesce(title[1:80], '') AS item_title, coalesce(item_year, '') AS item_year, coalesce(concat_ws('|', a1, a2, a3), '') AS item_authors, CASE WHEN n_candidates > 0 THEN array_to_string(keys[1:5], '|') ELSE '' END AS candidate_keys FROM results r LEFT JOIN library l USING (item_key)")
def q_api_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = review.api_rows(_resolved(spark, sf), _library(spark, sf))
    return rows.select("cit_id", "display", "outcome", "item_key", "confidence", "item_title", "item_year", F.array_join("item_authors", "|").alias("item_authors"), F.array_join(F.transform("candidates", lambda c: c["key"]), "|").alias("candidate_keys"))


def _reported(spark: SparkSession, sf: str) -> DataFrame:
    """What is unmatched, with all that the report says of it."""
    return _unmatched(spark, sf, "doc_id", "display", "in_footnote", "para_idx", "item_key", "suggestion_year").withColumn("ref_text", F.lit(""))


@query(f"WITH {_CASCADE}, u AS ({_UNSETTLED}) SELECT doc_id, cit_id AS ord, concat(display, '  [', CASE WHEN in_footnote THEN 'footnote' ELSE concat('para ', para_idx + 1) END, ']', CASE WHEN outcome = 'suggestion' THEN concat('  [suggestion: ', item_key, ' (', suggestion_year, ')]') ELSE '' END) AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, display ORDER BY cit_id) AS n FROM u) WHERE n = 1")
def q_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return review.report_lines(_reported(spark, sf))


@query(f"WITH {_CASCADE} SELECT r.cit_id, CASE WHEN outcome = 'suggestion' THEN concat('? ', display, ' → [', r.item_key, '] ', concat_ws('; ', a1, a2), ' (', item_year, ') — ', title[1:50], '… (year differs: doc=', cit_year, ', lib=', item_year, ')') WHEN outcome = 'matched' THEN concat('✓ ', display, ' → [', r.item_key, '] ', concat_ws('; ', a1, a2, a3), ' (', item_year, ') — ', title[1:60], '… (', round_even(confidence * 100, 0)::INT, '%)') ELSE concat('✗ ', display, ' — no match found') END AS summary FROM results r JOIN citations c USING (cit_id) LEFT JOIN library l ON l.item_key = r.item_key")
def q_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return review.summaries(_resolved(spark, sf), _library(spark, sf))


@query(f"WITH {_CASCADE}, u AS ({_UNSETTLED}), lines AS (SELECT doc_id, cit_id AS ord, concat(display, '  [', CASE WHEN in_footnote THEN 'footnote' ELSE concat('para ', para_idx + 1) END, ']', CASE WHEN outcome = 'suggestion' THEN concat('  [suggestion: ', item_key, ' (', suggestion_year, ')]') ELSE '' END) AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, display ORDER BY cit_id) AS n FROM u) WHERE n = 1), found AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) SELECT doc_id, 0 AS part, unnest([0, 1, 2])::BIGINT AS ord, unnest([concat('Unmatched citations from: doc', doc_id), concat('Total unmatched: ', n), '']) AS line FROM found UNION ALL SELECT doc_id, 1, ord, concat(line, chr(10)) FROM lines")
def q_report(spark: SparkSession, sf: str) -> DataFrame:
    titles = _citations(spark, sf).select("doc_id").distinct().withColumn("title", F.concat(F.lit("doc"), F.col("doc_id")))
    none = spark.createDataFrame([], "doc_id long, kind int, ord long, text string")
    return review.report(_reported(spark, sf), none, titles)


@query(f"WITH {_CASCADE}, spans AS (SELECT doc_id, para_idx, char_start, char_end, list(cit_id ORDER BY cit_id) AS ids FROM results GROUP BY ALL) SELECT doc_id, para_idx, char_start, char_end, array_to_string(ids, '|') AS cit_ids, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, char_start DESC)::INT AS group_ord FROM spans")
def q_span_groups(spark: SparkSession, sf: str) -> DataFrame:
    return review.span_groups(_shown(spark, sf)).withColumn("cit_ids", F.array_join(F.col("cit_ids").cast("array<string>"), "|"))


@query(f"WITH {_CASCADE} SELECT doc_id, para_idx, char_start, sha256(concat_ws('|', doc_id, para_idx, char_start))[1:8] AS citation_id, count(*) AS n_items FROM results WHERE outcome = 'matched' GROUP BY doc_id, para_idx, char_start")
def q_citation_json(spark: SparkSession, sf: str) -> DataFrame:
    """The payloads of field codes, read back from their JSON."""
    rows = _results(spark, sf).where("outcome = 'matched'")
    item = F.struct(F.col("item_key").alias("id"), F.array(library.item_uri(F.lit("7"), F.col("item_key"))).alias("uris"))
    groups = rows.groupBy("doc_id", "para_idx", "char_start").agg(F.min("display").alias("raw_text"), F.array_sort(F.collect_list(item)).alias("items"))
    shape = "citationID string, citationItems array<struct<id: string, uris: array<string>>>"
    back = review.citation_json(groups).withColumn("j", F.from_json("field_json", shape))
    return back.select("doc_id", "para_idx", "char_start", F.col("j.citationID").alias("citation_id"), F.size("j.citationItems").cast("long").alias("n_items"))


# --- Library ----------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {duck('collections', 'collection_items')}, live AS (SELECT * FROM collections WHERE NOT deleted), up AS (SELECT coll_id, coll_name AS path, parent_id AS nx, 0 AS d FROM live UNION ALL SELECT u.coll_id, concat(l.coll_name, ' / ', u.path), l.parent_id, d + 1 FROM up u JOIN live l ON l.coll_id = u.nx), p AS (SELECT coll_id, arg_max(path, d) AS path FROM up GROUP BY coll_id), c AS (SELECT coll_id, count(*) AS n FROM collection_items WHERE NOT item_deleted GROUP BY coll_id) SELECT live.coll_id, coll_name, parent_id, library_id, path, coalesce(n, 0) AS item_count FROM live JOIN p USING (coll_id) LEFT JOIN c USING (coll_id)")
def q_collections(spark: SparkSession, sf: str) -> DataFrame:
    members = inputs.spark(spark, sf, "collection_items")
    return library.collection_list(inputs.spark(spark, sf, "collections"), members, members.where("item_deleted"))


@query(f"WITH RECURSIVE {duck('collections')}, down AS (SELECT 2::BIGINT AS coll_id UNION ALL SELECT c.coll_id FROM down d JOIN collections c ON c.parent_id = d.coll_id) SELECT DISTINCT coll_id FROM down")
def q_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return library.descendants(inputs.spark(spark, sf, "collections"), 2)


@query(f"WITH RECURSIVE {duck('collections', 'collection_items')}, down AS (SELECT 2::BIGINT AS coll_id UNION ALL SELECT c.coll_id FROM down d JOIN collections c ON c.parent_id = d.coll_id) SELECT DISTINCT item_id FROM collection_items WHERE coll_id IN (SELECT coll_id FROM down)")
def q_collection_items(spark: SparkSession, sf: str) -> DataFrame:
    return library.within_collection(inputs.spark(spark, sf, "collection_items"), inputs.spark(spark, sf, "collections"), 2)


_LAST_FIELDS = f"{duck('fields')}, lf AS (SELECT item_id, field_name, arg_max(field_value, ord) AS v, min(ord) AS ord FROM fields GROUP BY ALL)"


@query(f"WITH {_LAST_FIELDS} SELECT item_id, max(CASE WHEN field_name = 'title' THEN v END) AS title, max(CASE WHEN field_name = 'date' THEN v END) AS date, max(CASE WHEN field_name = 'publisher' THEN v END) AS publisher, count(*) AS n_fields FROM lf GROUP BY item_id".replace("count(*) AS n_fields FROM lf", "count(*)::INT AS n_fields FROM lf"))
def q_fields_pivot(spark: SparkSession, sf: str) -> DataFrame:
    m = library.pivoted(inputs.spark(spark, sf, "fields"))
    return m.select("item_id", F.col("fields")["title"].alias("title"), F.col("fields")["date"].alias("date"), F.col("fields")["publisher"].alias("publisher"), F.size("fields").alias("n_fields"))


@query(f"WITH {_LAST_FIELDS} SELECT item_id, CASE field_name WHEN 'university' THEN 'publisher' ELSE field_name END AS target, arg_min(v, ord) AS value FROM lf WHERE field_name IN ('publisher', 'university') GROUP BY ALL")
def q_fields_renamed(spark: SparkSession, sf: str) -> DataFrame:
    return library.renamed_fields(inputs.spark(spark, sf, "fields"))


_PEOPLE = f"{duck('creators')}, pe AS (SELECT item_id, order_index, coalesce(nullif(last_name, ''), nullif(first_name, '')) AS name, coalesce(creator_role, 'author') AS role FROM creators)"


@query(f"WITH {_PEOPLE} SELECT item_id, coalesce(string_agg(name, '|' ORDER BY order_index) FILTER (role = 'author'), '') AS authors, coalesce(string_agg(name, '|' ORDER BY order_index) FILTER (role = 'editor'), '') AS editors FROM pe WHERE name IS NOT NULL GROUP BY item_id")
def q_creators(spark: SparkSession, sf: str) -> DataFrame:
    return library.creators(inputs.spark(spark, sf, "creators")).select("item_id", F.array_join("authors", "|").alias("authors"), F.array_join("editors", "|").alias("editors"))


_WORKS = "SELECT p_partkey AS item_id, concat('K', cast(p_partkey AS string)) AS item_key, CASE p_partkey % 5 WHEN 0 THEN 'book' WHEN 1 THEN 'journalArticle' WHEN 2 THEN 'note' WHEN 3 THEN 'podcast' ELSE 'strangeKind' END AS type_name, p_partkey % 50 AS date_added FROM {part}"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    members = inputs.spark(spark, sf, "collection_items")
    return library.items(_sql(spark, sf, _WORKS, "part"), inputs.spark(spark, sf, "fields"), inputs.spark(spark, sf, "creators"), members.where("item_deleted"), library.within_collection(members, inputs.spark(spark, sf, "collections"), 2))


_ITEMS = f"""{_LAST_FIELDS}, {_PEOPLE}, {duck('collections', 'collection_items')}, down AS (SELECT 2::BIGINT AS coll_id UNION ALL SELECT c.coll_id FROM down d JOIN collections c ON c.parent_id = d.coll_id), wk AS ({_plain(_WORKS)}),
its AS (SELECT item_id, item_key, CASE type_name WHEN 'book' THEN 'book' WHEN 'journalArticle' THEN 'article-journal' WHEN 'podcast' THEN 'broadcast' ELSE 'document' END AS item_type, coalesce((SELECT v FROM lf WHERE lf.item_id = wk.item_id AND field_name = 'title'), '') AS title, regexp_extract(coalesce((SELECT v FROM lf WHERE lf.item_id = wk.item_id AND field_name = 'date'), ''), '\\b(\\d{{4}})\\b', 1) AS year, coalesce((SELECT string_agg(name, '|' ORDER BY order_index) FROM pe WHERE pe.item_id = wk.item_id AND role = 'author' AND name IS NOT NULL), '') AS authors FROM wk WHERE type_name NOT IN ('attachment', 'note') AND item_id NOT IN (SELECT item_id FROM collection_items WHERE item_deleted) AND item_id IN (SELECT item_id FROM collection_items WHERE coll_id IN (SELECT coll_id FROM down)))"""


@query(f"WITH RECURSIVE {_ITEMS} SELECT * FROM its")
def q_items(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("item_id", "item_key", "item_type", "title", "year", F.array_join("authors", "|").alias("authors"))


@query(f"WITH RECURSIVE {_ITEMS} SELECT item_id, item_type AS type, nullif(title, '') AS title, nullif(split_part(authors, '|', 1), '') AS first_author, nullif(year, '')::INT AS year, coalesce((SELECT arg_min(v, ord) FROM lf WHERE lf.item_id = its.item_id AND field_name IN ('publisher', 'university')), NULL) AS publisher FROM its")
def q_csl_json(spark: SparkSession, sf: str) -> DataFrame:
    """Citation records, read back from their JSON."""
    records = library.citation_records(_items(spark, sf), inputs.spark(spark, sf, "fields"))
    shape = "type string, title string, author array<struct<family: string>>, issued struct<`date-parts`: array<array<int>>>, publisher string"
    j = records.withColumn("j", F.from_json("record", shape))
    return j.select("item_id", "j.type", "j.title", F.get("j.author", 0)["family"].alias("first_author"), F.get(F.get(F.col("j.issued")["date-parts"], 0), 0).alias("year"), "j.publisher")


@query(f"WITH t AS ({_plain(_WORKS)}) SELECT item_id, CASE WHEN item_id % 2 = 0 THEN concat('http://zotero.org/users/', item_id, '/items/', item_key) ELSE concat('http://zotero.org/groups/0/items/', item_key) END AS uri FROM t")
def q_item_uri(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sql(spark, sf, _WORKS, "part")
    return rows.select("item_id", library.item_uri(F.when(F.col("item_id") % 2 == 0, F.col("item_id").cast("string")), F.col("item_key")).alias("uri"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
