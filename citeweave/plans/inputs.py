"""Citations, a library, paragraphs and trees derived from the test tables, in SQL that Spark and DuckDB both read.

{table} stands for a table; spark() fills in DataFrames and duck() names. Surnames are built of three syllables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession



def part(text: str, size: int, index: str) -> str:
    return f"substr('{text}', cast(({index}) * {size} + 1 as int), {size})"


def surname(k: str) -> str:
    """An expression for a surname out of a whole number; 1728 of them."""
    a, b, c = (f"(cast(floor(({k}) / {n}) as int) % 12)" for n in (1, 12, 144))
    first = part("BarDelForGanHolJenKarLinMorNilPetSan", 3, a)
    second = part("abaedoerisilonmautteviynarul", 2, b)
    third = part("bergdalefordholmlundmarkstedthornvikewoodgardnaes", 4, c)
    return f"concat({first}, {second}, {third})"


_LIBRARY = f"""
SELECT p_partkey AS lib_ord, concat('K', cast(p_partkey AS string)) AS item_key, {surname('p_partkey * 7')} AS a1,
  CASE WHEN p_partkey % 3 = 0 THEN {surname('p_partkey * 5 + 1')} END AS a2,
  CASE WHEN p_partkey % 6 = 0 THEN {surname('p_partkey * 3 + 2')} END AS a3,
  concat(p_name, ' ', p_type) AS title, cast(1995 + p_partkey % 7 AS string) AS item_year
FROM {{part}}
"""

_CITATIONS = f"""
SELECT cit_id, o % 37 AS doc_id,
  CASE WHEN o % 17 = 0 THEN concat('Z', substr(name, 2)) WHEN o % 10 = 0 THEN concat(substr(name, 1, 2), 'xq', substr(name, 6)) WHEN o % 5 = 0 THEN concat(substr(name, 1, 2), substr(name, 4)) WHEN o % 7 = 0 THEN concat(name, 's') ELSE name END AS c1,
  CASE WHEN t % 3 = 0 AND o % 2 = 0 THEN {surname('t * 5 + 1')} END AS c2,
  (t % 6 = 0 AND o % 2 = 1) AS has_et_al,
  cast(1995 + t % 7 + CASE WHEN o % 11 = 0 THEN 1 WHEN o % 13 = 0 THEN 9 ELSE 0 END AS string) AS cit_year
FROM (SELECT o_orderkey AS cit_id, cast(o_orderkey AS int) AS o, cast(o_orderkey % 1000 AS int) AS t, {surname('(o_orderkey % 1000) * 7')} AS name FROM {{orders}})
"""

#: Documents of 41 paragraphs: filler, a heading (none in some), entries; some without any list.
_PARAGRAPHS = f"""
SELECT d AS doc_id, i AS para_idx,
  CASE WHEN d % 5 = 4 THEN concat('Plain text number ', cast(i AS string), ' about topic ', cast(d AS string))
       WHEN i = 20 AND d % 5 <> 3 THEN CASE WHEN d % 2 = 0 THEN 'References' ELSE '  Bibliography ' END
       WHEN i = 5 AND d % 5 = 1 THEN 'Literature'
       WHEN i > 20 AND i % 7 = 3 THEN ''
       WHEN i > 20 AND i % 5 = 2 THEN concat('[', cast(i - 20 AS string), '] ', {surname('d * 31 + i * 11')}, ', A. Study of topic ', cast(d AS string), ', 19', cast(50 + i AS string), '.')
       WHEN i > 20 THEN concat({surname('d * 31 + i * 11')}, ', B. (20', cast(i % 25 + 10 AS string), '). Work on topic ', cast(d AS string), '.')
       WHEN i % 6 = 1 THEN concat('As shown (', {surname('d * 31 + (i + 20) * 11')}, ', 20', cast((i + 20) % 25 + 10 AS string), ') and [', cast(i AS string), '].')
       WHEN i % 6 = 2 THEN concat('Results [', cast(i AS string), ', ', cast(i + 2 AS string), '-', cast(i + 4 AS string), '] hold (see topic ', cast(d AS string), ').')
       ELSE concat('Plain text number ', cast(i AS string), ' about topic ', cast(d AS string)) END AS para_text
FROM (SELECT cast(floor(o_orderkey / 41) AS bigint) AS d, cast(o_orderkey % 41 AS int) AS i FROM {{orders}})
"""

#: regions, nations and suppliers as a tree of collections; ids 1.., 101.., 1001..; a few are deleted.
_COLLECTIONS = """
SELECT cast(r_regionkey + 1 AS bigint) AS coll_id, r_name AS coll_name, cast(NULL AS bigint) AS parent_id, 1 AS library_id, false AS deleted FROM {region}
UNION ALL SELECT cast(n_nationkey + 101 AS bigint), n_name, cast(n_regionkey + 1 AS bigint), 1, n_nationkey % 9 = 8 FROM {nation}
UNION ALL SELECT cast(s_suppkey + 1000 AS bigint), s_name, cast(s_nationkey + 101 AS bigint), 1, s_suppkey % 10 = 9 FROM {supplier}
"""

_COLLECTION_ITEMS = "SELECT cast(1001 + p_partkey % 10 AS bigint) AS coll_id, cast(p_partkey AS bigint) AS item_id, p_partkey % 29 = 3 AS item_deleted FROM {part}"

#: Items' fields, one row each, in order; some items lack some, some fields repeat, and the last holds.
_FIELDS = """
SELECT item_id, field_name, field_value, ord FROM (
  SELECT p_partkey AS item_id, 'title' AS field_name, p_name AS field_value, 1 AS ord FROM {part}
  UNION ALL SELECT p_partkey, 'publisher', CASE WHEN p_partkey % 2 = 0 THEN p_type END, 2 FROM {part}
  UNION ALL SELECT p_partkey, 'university', CASE WHEN p_partkey % 3 = 0 THEN p_brand END, 3 FROM {part}
  UNION ALL SELECT p_partkey, 'date', concat('May ', cast(1990 + p_partkey % 30 AS string)), 4 FROM {part}
  UNION ALL SELECT p_partkey, 'date', CASE WHEN p_partkey % 5 = 0 THEN concat(cast(1991 + p_partkey % 30 AS string), '-05-01') END, 5 FROM {part}
  UNION ALL SELECT p_partkey, 'unknownField', CASE WHEN p_partkey % 7 = 0 THEN p_brand END, 6 FROM {part})
WHERE field_value IS NOT NULL
"""

_CREATORS = " UNION ALL ".join(
    f"""SELECT p_partkey AS item_id, {k} AS order_index, CASE WHEN (p_partkey + {k}) % 11 = 0 THEN '' ELSE {surname(f'p_partkey * 13 + {k}')} END AS last_name,
  CASE WHEN (p_partkey + {k}) % 22 = 0 THEN '' ELSE 'F{k}' END AS first_name,
  CASE WHEN (p_partkey + {k}) % 5 = 0 THEN 'editor' WHEN (p_partkey + {k}) % 7 = 0 THEN 'translator' WHEN (p_partkey + {k}) % 13 = 0 THEN cast(NULL AS string) ELSE 'author' END AS creator_role
FROM {{part}}"""
    for k in range(4)
)

#: What a reviewer did: accepted suggestions, a candidate picked, matches taken back.
_OVERRIDES = "SELECT o_orderkey AS cit_id, CASE o_orderkey % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'pick' WHEN 2 THEN 'unmatch' ELSE 'none' END AS action, cast(o_orderkey % 4 AS int) AS pick FROM {orders}"

INPUTS = {"library": _LIBRARY, "citations": _CITATIONS, "paragraphs": _PARAGRAPHS, "collections": _COLLECTIONS, "collection_items": _COLLECTION_ITEMS, "fields": _FIELDS, "creators": _CREATORS, "overrides": _OVERRIDES}


def spark(session: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = INPUTS[name]
    tables = set(re.findall(r"\{(\w+)\}", text))
    return session.sql(text, **{t: session.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def duck(*names: str) -> str:
    """WITH clauses (without the word) that define the inputs."""
    return ", ".join(f"{n} AS ({re.sub(r'{(.*?)}', r'\1', INPUTS[n]).strip()})" for n in names)
