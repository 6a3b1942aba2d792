"""Queries over names inside texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import names as N
from cairn.registry import query
from cairn.sources.tables import read

_PLAIN = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_NAMES = f"""b AS (SELECT string_split({_PLAIN.format('text')}, ' ') AS w FROM benchmark),
n AS (SELECT DISTINCT array_to_string(w[i:i + k - 1], ' ') AS name FROM (SELECT w, unnest([1, 3, 5, 2]) AS i, unnest([1, 2, 3, 4]) AS k FROM b) WHERE length(array_to_string(w[i:i + k - 1], ' ')) >= 3),
x AS (SELECT name, string_split(name, ' ') AS nw FROM n),
d AS (SELECT doc_id, string_split({_PLAIN.format('text')}, ' ') AS w FROM documents),
e AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
c AS (SELECT doc_id, name, (length(array_to_string(w[:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END)::INT AS s FROM e JOIN x ON x.nw[1] = w[i] AND w[i:i + len(nw) - 1] = nw)"""


def phrases(spark, sf_dir):
    """Names of one to four words out of the benchmark's items."""
    words = read(spark, sf_dir, "benchmark", "text").select(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " ").alias("w"))
    cut = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in ((1, 1), (3, 2), (5, 3), (2, 4))))
    rows = words.select(F.explode(F.transform(cut, lambda c: F.array_join(F.slice("w", c["i"], c["k"]), " "))).alias("name"))
    return N.normalized(rows.distinct())


@query("name_places", f"WITH {_NAMES} SELECT doc_id, s AS start, s + length(name)::INT AS stop, name FROM c")
def name_places(spark, sf_dir):
    found = N.mentions(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", phrases(spark, sf_dir), every=True)
    return found.select("doc_id", "start", F.col("end").alias("stop"), "name")


@query("name_mentions", f"""WITH {_NAMES},
l AS (SELECT doc_id, list({{'s': s, 'e': s + length(name)::INT, 'n': name}} ORDER BY length(name) DESC, name, s) AS cs FROM c GROUP BY 1),
r AS (SELECT doc_id, list_reduce(list_transform(cs, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.n = x[1].n OR (x[1].e > y.s AND x[1].s < y.e))) > 0 THEN a ELSE list_concat(a, x) END) AS kept FROM l)
SELECT doc_id, k.s AS start, k.e AS stop, k.n AS name FROM (SELECT doc_id, unnest(kept) AS k FROM r)""")
def name_mentions(spark, sf_dir):
    found = N.mentions(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", phrases(spark, sf_dir))
    return found.select("doc_id", "start", F.col("end").alias("stop"), "name")


@query("only_names", f"WITH {_NAMES} SELECT doc_id, min(name) AS name FROM c GROUP BY 1 HAVING count(DISTINCT name) = 1")
def only_names(spark, sf_dir):
    return N.only_name(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", phrases(spark, sf_dir))
