"""Read-only SQL: one query that reads tables of the session may run, and nothing else.

Spark's own parser says what a text is, so words inside names or quotes do not count.  What
a query may consist of is a closed list: plan nodes, names, Spark's own expressions, and the
groups of its functions that work on their arguments alone.  Commands of any kind, strings
that are run as statements, scripts, Java calls, the session's own functions, names computed
at run time, streams and paths as tables are none of these.
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

NAME = re.compile(r"^[a-zA-Z0-9_-]+$")
#: Plan nodes of Spark's parser of which a query may consist; everything else is refused.
PLANS = frozenset(
    "Project Filter UnresolvedHaving Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect Join LateralJoin AsOfJoin SubqueryAlias UnresolvedSubqueryColumnAliases "
    "UnresolvedWith UnresolvedRelation UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedTableValuedFunction Generate WithWindowDefinition Pivot UnresolvedPivot Unpivot Sample UnresolvedHint RepartitionByExpression PipeOperator".split()
)
#: Names of the parser that stand for columns, stars, functions and arguments; IDENTIFIER() is none of them.
NAMES = frozenset("UnresolvedAttribute UnresolvedStar UnresolvedFunction UnresolvedAlias UnresolvedExtractValue UnresolvedOrdinal UnresolvedGenerator UnresolvedStarExceptOrReplace NamedParameter PosParameter UnresolvedTableAlias".split())
#: Expressions of Spark itself, which the parser writes for operators, casts, literals and subqueries.
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions"
#: Groups of Spark's own functions that work on their arguments alone, and single ones of other groups.
GROUPS = frozenset(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs operator_funcs predicate_funcs sketch_funcs "
    "st_funcs string_funcs struct_funcs table_funcs url_funcs variant_funcs window_funcs xml_funcs".split()
)
FUNCTIONS = frozenset("typeof equal_null bitmap_bit_position bitmap_bucket_number bitmap_count range".split())


def _all(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _is_plan(spark: SparkSession, node) -> bool:
    return spark._jvm.py4j.reflection.TypeUtil.isInstanceOf(spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"), node)


def _known_function(spark: SparkSession, name: str) -> bool:
    if name in FUNCTIONS:
        return True
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    if spark._jsparkSession.sessionState().catalog().isTemporaryFunction(catalyst.FunctionIdentifier(name)):
        return False
    for registry in (catalyst.analysis.FunctionRegistry.builtin(), catalyst.analysis.TableFunctionRegistry.builtin()):
        found = registry.lookupFunction(catalyst.FunctionIdentifier(name))
        if found.isDefined():
            return found.get().getGroup() in GROUPS
    return False


def _faults(spark: SparkSession, node) -> str | None:
    """What in a parsed plan or expression is no part of a query that reads tables."""
    kind = node.getClass().getSimpleName().rstrip("$")
    is_plan = _is_plan(spark, node)
    if is_plan and kind not in PLANS:
        return kind
    if not is_plan and kind not in NAMES and not node.getClass().getName().startswith(EXPRESSIONS):
        return kind
    if kind == "UnresolvedRelation":
        parts = _all(node.multipartIdentifier())
        if node.isStreaming() or len(parts) > 1 and not spark.catalog.databaseExists(".".join(parts[:-1])):
            return ".".join(parts)
    if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction", "UnresolvedGenerator"):
        # a generator has an identifier, the others the parts of a name
        parts = [node.name().funcName()] if kind == "UnresolvedGenerator" else _all(node.nameParts() if kind == "UnresolvedFunction" else node.name())
        if len(parts) > 1 or not _known_function(spark, parts[0].lower()):
            return ".".join(parts)
    inner = _all(node.children()) + _all(node.innerChildren())
    if is_plan:
        inner += _all(node.expressions())
    elif _has_plan(spark, node):
        inner.append(node.plan())
    for child in inner:
        if (found := _faults(spark, child)) is not None:
            return found
    return None


def _has_plan(spark: SparkSession, node) -> bool:
    """Whether an expression holds a plan of its own: subqueries and tables as arguments do."""
    kind = "org.apache.spark.sql.catalyst.expressions."
    classes = ("PlanExpression", "FunctionTableSubqueryArgumentExpression")
    return any(spark._jvm.py4j.reflection.TypeUtil.isInstanceOf(spark._jvm.java.lang.Class.forName(kind + c), node) for c in classes)


def refusal(spark: SparkSession, text: str) -> str | None:
    """Why a text may not run; None where it may."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except PySparkException as error:
        return str(error).splitlines()[0]
    found = _faults(spark, plan)
    return None if found is None else f"{found} is not allowed"


def reads_only(text: str, spark: SparkSession | None = None) -> bool:
    """Whether the text is one query that only reads tables."""
    return refusal(spark or SparkSession.builder.getOrCreate(), text) is None


def run_sql(spark: SparkSession, text: str, args: dict | list | None = None) -> DataFrame:
    if (why := refusal(spark, text)) is not None:
        raise ValueError(f"only one reading query may run: {why}")
    return spark.sql(text, args=args) if args else spark.sql(text)


def checked_name(spark: SparkSession, name: str) -> str:
    """The name of a table that exists."""
    if not NAME.match(name) or not spark.catalog.tableExists(name):
        raise ValueError(f"no table {name!r}")
    return name
