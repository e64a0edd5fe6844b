"""Only plain queries pass: the parsed plan of a statement is walked against a list of query nodes."""

from __future__ import annotations

from py4j.java_gateway import is_instance_of
from pyspark.sql import SparkSession

from pellucid.errors import CheckError

#: Classes of logical plans that read and nothing else.
QUERY_NODES = frozenset(
    "Project Filter Aggregate Join Sort Limit GlobalLimit LocalLimit Offset Tail Union Intersect Except Distinct Deduplicate SubqueryAlias UnresolvedRelation UnresolvedWith CTERelationDef CTERelationRef WithCTE "
    "UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedHaving Window WithWindowDefinition Generate LateralJoin UnresolvedSubqueryColumnAliases View Sample Range UnresolvedTableValuedFunction "
    "Pivot Unpivot UnresolvedPivot Expand BaseGroupingSets Repartition RebalancePartitions RepartitionByExpression UnresolvedHint UnresolvedCTERelation UnionLoop UnionLoopRef AsOfJoin ParameterizedQuery NameParameterizedQuery UnresolvedTVFAliases UnresolvedOrdinal".split()
)
FORBIDDEN_FUNCTIONS = frozenset(("reflect", "java_method", "try_reflect"))


def require_read_only(spark: SparkSession, query: str) -> None:
    """Raises spark.write_rejected for anything but a query, wherever in the statement it stands."""
    why = _why_not(spark, query)
    if why:
        raise CheckError("spark.write_rejected", why)


def _why_not(spark: SparkSession, query: str) -> str | None:
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:
        raise CheckError("engine.invalid_check", f"the query does not parse: {str(e).splitlines()[0]}") from None
    return _Walk(spark.sparkContext._gateway).plan(plan)


class _Walk:
    """Visits every plan and expression of a parsed statement, subqueries included."""

    def __init__(self, gateway):
        self.gateway = gateway

    def _is(self, thing, name: str) -> bool:
        return is_instance_of(self.gateway, thing, f"org.apache.spark.sql.catalyst.{name}")

    def plan(self, plan) -> str | None:
        own = plan.getClass().getSimpleName().rstrip("$")
        if own not in QUERY_NODES:
            return f"{own} is not a query"
        for e in _items(plan.expressions()):
            if why := self.expression(e):
                return why
        for child in (*_items(plan.children()), *_items(plan.innerChildren())):
            if self._is(child, "plans.logical.LogicalPlan") and (why := self.plan(child)):
                return why
        return None

    def expression(self, e) -> str | None:
        if e.getClass().getSimpleName() == "UnresolvedFunction":
            called = e.nameParts().mkString(".").lower()
            if called.rpartition(".")[2] in FORBIDDEN_FUNCTIONS:
                return f"{called} may run any code"
        if self._is(e, "expressions.PlanExpression") and (why := self.plan(e.plan())):
            return why
        for child in _items(e.children()):
            if why := self.expression(child):
                return why
        return None


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]
