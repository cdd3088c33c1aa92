"""The rules that results with items and citations obey, as counts and as checks inside the plan.

results: call, status (ok, partial, empty, not_found), returned, has_more, next_cursor. items: call, citation_ref (from 0).
citations: call, source_type, uri, scope. Each rule is counted for each call from aggregates of the three tables, joined by
call, so calls with many items are summed where they stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sources whose citations need an address.
NEED_URI = ("confluence", "gitlab", "jira", "opensearch_dashboards", "knowledge")

RULES = (
    "ok and partial need a citation", "empty and not_found have no items and no citations", "has_more needs a cursor", "a citation_ref names a citation",
    "returned is the number of items", "a citation of a wiki, code, a dashboard or knowledge needs an address", "partial without items needs a citation of its scope",
)


def violations(results: DataFrame, items: DataFrame, citations: DataFrame) -> DataFrame:
    """call and rule1 to rule7: how often each rule is broken."""
    refs = items.groupBy(F.col("call").alias("i_call")).agg(F.count(F.lit(1)).alias("items"))
    cited = citations.groupBy(F.col("call").alias("c_call")).agg(F.count(F.lit(1)).alias("citations"), F.count_if(F.col("source_type").isin(*NEED_URI) & (F.coalesce(F.trim("uri"), F.lit("")) == "")).alias("no_uri"), F.count_if(F.col("scope").isNotNull()).alias("scopes"))
    # refs beyond the citations are counted item by item, with only the citations' number at hand
    counted = items.join(cited.select("c_call", "citations"), F.col("call") == F.col("c_call"), "left")
    bad = counted.groupBy(F.col("call").alias("b_call")).agg(F.count_if(F.col("citation_ref").isNull() | (F.col("citation_ref") < 0) | (F.col("citation_ref") >= F.coalesce("citations", F.lit(0)))).alias("bad_refs"))
    all_ = results.join(refs, F.col("call") == F.col("i_call"), "left").join(cited, F.col("call") == F.col("c_call"), "left").join(bad, F.col("call") == F.col("b_call"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    answered, nothing = F.col("status").isin("ok", "partial"), F.col("status").isin("empty", "not_found")
    rules = [
        answered & (zero("citations") == 0), nothing & (zero("items") + zero("citations") > 0), F.coalesce(F.col("has_more"), F.lit(False)) & (F.coalesce("next_cursor", F.lit("")) == ""), zero("bad_refs"),
        ~F.col("returned").eqNullSafe(zero("items")), zero("no_uri"), (F.col("status") == "partial") & (zero("items") == 0) & (zero("scopes") == 0),
    ]
    return all_.select("call", *[F.coalesce(r.cast("long"), F.lit(0).cast("long")).alias(f"rule{i}") for i, r in enumerate(rules, 1)])


def enforced(results: DataFrame, items: DataFrame, citations: DataFrame) -> DataFrame:
    """The results; reading one that breaks a rule fails the job and names the call and the rule. No second job looks first."""
    found = violations(results, items, citations).withColumnRenamed("call", "v_call")
    told = F.lit(None).cast("string")
    for i in range(len(RULES), 0, -1):
        told = F.when(F.col(f"rule{i}") > 0, F.lit(RULES[i - 1])).otherwise(told)
    both = results.join(found, F.col("call").eqNullSafe(F.col("v_call")), "left")
    fine = F.when(told.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("call "), F.coalesce(F.col("call").cast("string"), F.lit("null")), F.lit(": "), told)).cast("boolean"))
    return both.filter(fine).select(*results.columns)
