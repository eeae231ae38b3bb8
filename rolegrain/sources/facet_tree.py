"""Nested facets of a board's listing, of any depth, by a recursive query over its JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrain.functions.places import surely_irish

COUNTRY, PLACES = "locationCountry", "locations"
#: More ids than this, or longer ones, are no request that a board takes.
MOST_IDS = 128
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

# Each step goes from a facet to those among its values that are facets themselves. `path` holds the places on the way as
# negative numbers, so that of two facets the one that stands first in a walk from the end to the start is larger.
WALK = """WITH RECURSIVE tree AS (
 SELECT source, f.value AS facet, array(-f.pos) AS path FROM {boards}, LATERAL variant_explode_outer(facets) f
 UNION ALL
 SELECT t.source, v.value, concat(t.path, array(-v.pos)) FROM tree t, LATERAL variant_explode_outer(t.facet:values) v
  WHERE v.value:facetParameter IS NOT NULL)
SELECT source, path, try_variant_get(facet, '$.facetParameter', 'string') AS parameter, facet FROM tree
 WHERE facet IS NOT NULL AND try_variant_get(facet, '$.facetParameter', 'string') IN ('locationCountry', 'locations')"""


def facets(boards: DataFrame) -> DataFrame:
    """(source, path, parameter, values) of the country and place facets of boards (source, body), wherever they are
    nested; values are (id, descriptor), with a null id for one that is no text or too long. A body that is no JSON has
    none. The recursion ends at Spark's limit of 100 levels, with an error."""
    parsed = boards.select("source", F.try_parse_json("body").alias("_body")).select("source", F.expr("_body:facets").alias("facets"))
    if parsed.sparkSession.conf.get(ROW_LIMIT) == "1000000":  # Spark's own limit is for runaway queries; this one ends with the nesting
        parsed.sparkSession.conf.set(ROW_LIMIT, "-1")
    found = parsed.sparkSession.sql(WALK, boards=parsed.filter("facets IS NOT NULL AND NOT is_variant_null(facets)"))
    each = found.select("source", "path", "parameter", F.expr("try_cast(facet:values AS array<variant>)").alias("_values")).filter(F.size("_values") > 0)
    of_text = "CASE WHEN schema_of_variant(v:id) = 'STRING' AND length(v:id::string) <= 128 THEN v:id::string END"
    return each.select("source", "path", "parameter", F.expr(f"transform(_values, v -> struct({of_text} AS id, coalesce(try_variant_get(v, '$.descriptor', 'string'), '') AS descriptor))").alias("values"))


def irish_facets(boards: DataFrame) -> DataFrame:
    """(source, parameter, ids, only_irish): the Irish ids by which a board can be asked, those of its country facet if it
    has some, else of its place facet (both null for none), and whether all values of its country facet, or where it
    has none of its place facet, are Irish. Of facets of one kind the one that is first in the listing counts; more than
    MOST_IDS ids are an error. Sources with neither ids nor that proof have no row."""
    each = facets(boards)
    ids = F.transform(F.filter("values", lambda v: v["id"].isNotNull() & surely_irish(v["descriptor"])), lambda v: v["id"])
    too_many = F.raise_error(F.concat(F.lit("too many Irish facets: "), "source")).cast("array<string>")
    judged = each.select("source", "path", "parameter", F.when(F.size(ids) <= MOST_IDS, ids).otherwise(too_many).alias("ids"), F.forall("values", lambda v: surely_irish(v["descriptor"])).alias("only"))
    of = lambda kind, value, if_: F.max_by(F.when((F.col("parameter") == kind) & if_, value), F.when((F.col("parameter") == kind) & if_, F.col("path")))
    some = F.size("ids") > 0
    whole = judged.groupBy("source").agg(*[of(k, F.col("ids"), some).alias(f"ids_{k}") for k in (COUNTRY, PLACES)], *[of(k, F.col("only"), F.lit(True)).alias(f"only_{k}") for k in (COUNTRY, PLACES)])
    has_country = F.col(f"ids_{COUNTRY}").isNotNull()
    parameter = F.when(has_country, COUNTRY).when(F.col(f"ids_{PLACES}").isNotNull(), PLACES)
    out = whole.select("source", parameter.alias("parameter"), F.coalesce(f"ids_{COUNTRY}", f"ids_{PLACES}").alias("ids"), F.coalesce(f"only_{COUNTRY}", f"only_{PLACES}", F.lit(False)).alias("only_irish"))
    return out.filter("ids IS NOT NULL OR only_irish")
