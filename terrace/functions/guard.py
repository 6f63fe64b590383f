"""What user expressions and user SQL may contain, decided on the parsed plan before anything runs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

#: Groups of built-in functions that only compute on their arguments. Those that reach the JVM, the session, files or keys are in others.
GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs",
    "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs",
    "string_funcs", "struct_funcs", "url_funcs", "window_funcs",
}
#: Steps of a query that read given tables, or none. Scripts, table functions, commands and the like are not among them.
STEPS = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation",
    "Offset", "OneRowRelation", "Pivot", "Project", "Sample", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedInlineTable",
    "UnresolvedOrdinal", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "Unpivot", "WithWindowDefinition",
}


class Refused(ValueError):
    """The text uses something beyond computing on the given columns and tables."""


def check_expression(spark: SparkSession, text: str) -> str:
    """``text`` again, if it is an expression of columns, literals and plain built-in functions."""
    _walk(spark, expressions=[_parser(spark).parseExpression(text)], tables=None)
    return text


def check_query(spark: SparkSession, sql: str, tables: Iterable[str]) -> str:
    """``sql`` again, if it is a query that reads nothing but ``tables`` by plain built-in functions."""
    _walk(spark, plans=[_parser(spark).parsePlan(sql)], tables={t.lower() for t in tables})
    return sql


def _parser(spark: SparkSession):
    return spark._jsparkSession.sessionState().sqlParser()


def _each(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _walk(spark: SparkSession, expressions: Iterable = (), plans: Iterable = (), tables: set[str] | None = None) -> None:
    """Visit all nodes. ``tables`` are the names that a query may read; None stands for no query at all."""
    given = tables or set()
    open_expressions, open_plans = [(e, given) for e in expressions], [(p, given) for p in plans]
    while open_expressions or open_plans:
        if open_expressions:
            node, scope = open_expressions.pop()
            kind = _kind(node)
            if kind == "UnresolvedFunction":
                _check_function(spark, list(_each(node.nameParts())))
            elif kind == "UnresolvedGenerator":
                _check_function(spark, [node.name().unquotedString()])
            elif kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery"):
                if tables is None:
                    raise Refused("an expression must not read tables")
                open_plans.append((node.plan(), scope))
            open_expressions += [(x, scope) for x in _each(node.children())]
            continue
        plan, known = open_plans.pop()
        kind = _kind(plan)
        if kind not in STEPS:
            raise Refused(f"{kind} is not allowed in a query")
        if kind == "UnresolvedRelation":
            name = list(_each(plan.multipartIdentifier()))
            if len(name) != 1 or name[0].lower() not in known:
                raise Refused(f"table {'.'.join(name)} is not given")
        if kind == "UnresolvedWith":
            for pair in _each(plan.cteRelations()):
                open_plans.append((pair._2(), known))
                known = known | {pair._1().lower()}
        open_expressions += [(x, known) for x in _each(plan.expressions())]
        open_plans += [(x, known) for x in _each(plan.children())]


def _check_function(spark: SparkSession, parts: list[str]) -> None:
    name = ".".join(parts)
    if len(parts) == 1:
        info = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(
            spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
        if info.isDefined() and info.get().getSource() == "built-in" and info.get().getGroup() in GROUPS:
            return
    raise Refused(f"function {name} is not allowed")
