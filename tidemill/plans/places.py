"""Queries of places and titles: written out in many spellings, and read again by patterns of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators import search, trends
from tidemill.plans.catalog import pick
from tidemill.plans.registry import query, r6, t

_SETTINGS = ["{}", "{}, Karnataka", "India - {}", "Remote - {} (Hybrid)", "London; {}", "{}, Pakistan", "{}ville", "x{}", "{} / Berlin", "[{}] US", " {} ", "{}, o'fallon-WEST", "NY, {}", "{},"]
_PLACES = [*text.INDIA, "new york", "Remote", "sf bay area", "NYC", "UK", "Indiana", "austin, tx", "Worldwide", "bengaluru", "Anywhere", "emea"]
#: A place in a setting, in small letters, capitals or as it is; now and then none.
_PLACE = f"CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 43 = 0 THEN '  ' WHEN c_custkey % 3 = 0 THEN upper({{0}}) ELSE {{0}} END"
_RAW = _PLACE.format("replace(" + pick(_SETTINGS, "c_custkey") + ", '{}', " + pick(_PLACES, "c_custkey") + ")")


def placed(spark, d):
    return t(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("remote"), F.expr(_RAW).alias("place"))


def _word(words: list[str]) -> str:
    """A pattern of whole words without looking around them."""
    return "(?i)(^|[^\\p{L}\\p{N}_])(" + "|".join(w.replace("'", "''") for w in words) + ")($|[^\\p{L}\\p{N}_])"


_WITH = f"p AS (SELECT c_custkey, c_acctbal < 0 AS remote, {_RAW} AS place FROM customer)"


@query("p1_is_india", f"WITH {_WITH} SELECT c_custkey, place IS NOT NULL AND NOT regexp_matches(coalesce(place, ''), '{_word(text.NOT_INDIA)}') AND regexp_matches(coalesce(place, ''), '{_word(text.INDIA)}') AS india FROM p")
def _(spark, d):
    return placed(spark, d).select("c_custkey", text.is_india(F.col("place")).alias("india"))


_REMOTE = _word(["remote", "work\\s+from\\s+home", "wfh", "anywhere", "distributed", "telecommute"])
_HINTS = ["Remote", "remotely", "work  from home", "WFH ok", "on site", "Distributed team", "redistributed", "anywhere,", "telecommute", None, "", "home work"]


@query("p3_remote", f"WITH {_WITH}, h AS (SELECT *, {pick(_HINTS, 'c_custkey // 7')} AS hint FROM p) SELECT c_custkey, regexp_matches(coalesce(place, ''), '{_REMOTE}') OR regexp_matches(coalesce(hint, ''), '{_REMOTE}') AS remote FROM h")
def _(spark, d):
    hint = F.expr(pick(_HINTS, "c_custkey div 7"))
    return placed(spark, d).select("c_custkey", text.is_remote(F.col("place"), hint).alias("remote"))


def _cities(place: str) -> str:
    """SQL list of the cities that a place names, by their first spelling."""
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(coalesce({place}, ''), '{_word(list(c))}') THEN '{c[0].title()}' END" for c in text.CITIES) + "], lambda x: x IS NOT NULL)"


@query("t15_cities", f"WITH {_WITH} SELECT c_custkey, array_to_string({_cities('place')}, ';') AS cities FROM p")
def _(spark, d):
    return placed(spark, d).select("c_custkey", F.array_join(text.cities_in(F.col("place")), ";").alias("cities"))


_ASKING = ("data engineer in Bangalore", "ML role, new delhi or pune", "remote python work", "analyst Mumbai", "Goa or Kochi")


@query("p4_in_query_city", " UNION ALL ".join(f"SELECT c_custkey, {n} AS query_id FROM ({f'WITH {_WITH} SELECT * FROM p'}) WHERE regexp_matches(coalesce(place, ''), '{_word(list(c))}')" for n, q in enumerate(_ASKING) if (c := text.query_city(q))))
def _(spark, d):
    rows, out = placed(spark, d), None
    for n, asked in enumerate(_ASKING):
        if city := text.query_city(asked):
            part = rows.where(text.matches(F.col("place"), text.any_word(city))).select("c_custkey", F.lit(n).alias("query_id"))
            out = part if out is None else out.unionByName(part)
    return out


@query("p11_filtered_hits", f"WITH {_WITH} SELECT o_orderkey AS query_id, c_custkey FROM orders JOIN p ON o_custkey = c_custkey WHERE remote AND list_contains({_cities('place')}, 'Pune')")
def _(spark, d):
    rows = placed(spark, d).select("c_custkey", text.cities_in(F.col("place")).alias("cities"), F.col("remote").alias("is_remote"))
    hits = t(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("c_custkey"))
    return search.filtered(hits, rows, "c_custkey", "Pune", remote_only=True)


@query("p11_city_facets", f"WITH {_WITH} SELECT DISTINCT unnest({_cities('place')}) AS city FROM p")
def _(spark, d):
    spelled = placed(spark, d).select("place").distinct()  # each spelling is read once
    return search.facets(spelled.select(text.cities_in(F.col("place")).alias("cities")))


@query("a10_city_demand", f"""WITH {_WITH}, c AS (SELECT remote, unnest(CASE WHEN len({_cities('place')}) > 0 THEN {_cities('place')} ELSE ['City not stated'] END) AS city FROM p)
  SELECT city, count(*) AS postings, round(avg(CAST(remote AS INT)), 6) AS remote_share FROM c GROUP BY city""")
def _(spark, d):
    rows = placed(spark, d).select(text.cities_in(F.col("place")).alias("cities"), "remote")
    return r6(trends.demand(rows, "cities", "remote"))


_ALIASES = "CASE lower(x) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.LOCATION_ALIASES.items()) + " ELSE x END"
#: Words go twice over, for two of them may share the blank between them.
_NOISE = "(?i)\\b(remote|hybrid|on-?site|worldwide|anywhere)\\b"


@query("t3_normalise_location", f"""WITH {_WITH}, n AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(place, '{_NOISE}', ' ', 'g'), '[(){{}}\\[\\]]', ' ', 'g'), '\\s*[/|,]\\s*', ', ', 'g'), '\\s+', ' ', 'g'), ' ,-') AS x FROM p)
  SELECT c_custkey, CASE WHEN x <> '' THEN {_ALIASES} END AS place FROM n""")
def _(spark, d):
    return placed(spark, d).select("c_custkey", text.normalise_location(F.col("place")).alias("place"))


_TITLED = "array_to_string(list_transform(regexp_extract_all(l, '\\p{L}+|[^\\p{L}]+'), lambda r: upper(r[1]) || lower(r[2:])), '')"


@query("t13_region", f"""WITH {_WITH}, l AS (SELECT c_custkey, trim(regexp_extract(trim(coalesce(place, '')), '[^,]+$')) AS l FROM p)
  SELECT c_custkey, CASE WHEN l = '' THEN 'unknown' WHEN regexp_matches(l, '^\\p{{L}}{{1,3}}$') THEN upper(l) ELSE {_TITLED} END AS region FROM l""")
def _(spark, d):
    return placed(spark, d).select("c_custkey", text.region(F.col("place")).alias("region"))


_LEVELS = ["", "Senior ", "jr. ", "Staff ", "Entry-level ", "Graduate ", "Head of ", "internal ", "Sr ", "Internship: ", "leading ", "Lead junior ", "principal ", "entry level "]
_ROLES = ["Data Engineer", "ML Ops lead", "GenAI Scientist", "account executive, AI", "Data Centre Tech", "Maintenance", "BI analyst", "Product Manager, data", "Email marketer", "quant developer", "LLM researcher", "data entry clerk", "Python", "Sales analytics", "HTML author", "machine learning consultant", "Deep Learning"]
_TITLE = f"CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE {pick(_LEVELS, 'p_partkey')} || {pick(_ROLES, 'p_partkey')} || ' ' || p_name END"
_TITLES = f"x AS (SELECT p_partkey, {_TITLE} AS title FROM part)"


@query("t14_seniority", f"WITH {_TITLES} SELECT p_partkey, CASE WHEN regexp_matches(coalesce(title, ''), '{_word(text.JUNIOR)}') THEN 'junior' WHEN regexp_matches(coalesce(title, ''), '{_word(text.SENIOR)}') THEN 'senior' ELSE 'mid' END AS seniority FROM x")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", text.seniority(F.expr(_TITLE)).alias("seniority"))


@query("p2_target_role", f"WITH {_TITLES} SELECT p_partkey, NOT regexp_matches(coalesce(title, ''), '{_word(text.OTHER_ROLES)}') AND regexp_matches(coalesce(title, ''), '{_word(text.ROLE_TERMS)}') AS target FROM x")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", text.is_target_role(F.expr(_TITLE)).alias("target"))
