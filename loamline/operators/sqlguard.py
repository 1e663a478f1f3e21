"""Read-only SQL of an untrusted author, checked on Spark's parsed plan and run over the caller's views alone.

What is not on an allowlist of plan nodes, expressions and functions is refused. Relations must be the caller's views or common table
expressions in scope. The checked DataFrame runs in a child session that holds those views and nothing else.
"""

from __future__ import annotations

import re
import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

NODES = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Distinct SubqueryAlias UnresolvedRelation UnresolvedWith Union Intersect Except WithWindowDefinition UnresolvedHaving "
    "Offset OneRowRelation UnresolvedSubqueryColumnAliases LateralJoin UnresolvedInlineTable".split()
)
FUNCTIONS = frozenset(
    "count sum avg min max stddev variance median percentile count_if bool_and bool_or any_value first last round bround floor ceil ceiling abs sqrt power mod greatest least sign exp ln log "
    "lower upper trim ltrim rtrim length substring substr concat concat_ws replace split_part left right lpad rpad instr position regexp_replace regexp_extract coalesce nullif nvl ifnull if "
    "date_trunc date_add date_sub datediff months_between add_months year month day hour quarter extract to_date to_timestamp date_format make_date make_interval last_day current_date current_timestamp now "
    "row_number rank dense_rank percent_rank ntile lag lead first_value last_value cast string_agg listagg array_agg collect_list date int bigint double decimal string timestamp boolean like ilike isnull isnotnull not and or age date_bin".split()
)
#: Expressions by class name that the parser makes; any other is refused.
EXPRESSIONS = frozenset(
    "UnresolvedAttribute UnresolvedStar UnresolvedFunction UnresolvedAlias Alias Literal Cast And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In InSubquery "
    "Exists ScalarSubquery ListQuery IsNull IsNotNull IsTrue IsFalse Like ILike RLike LikeAll LikeAny Between Add Subtract Multiply Divide Remainder IntegralDivide UnaryMinus UnaryPositive CaseWhen SortOrder "
    "UnresolvedOrdinal WindowExpression UnresolvedWindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame UnboundedPreceding UnboundedFollowing CurrentRow WindowSpecReference UnresolvedExtractValue "
    "CurrentDate CurrentTimestamp GroupingSets Cube Rollup StringTrim Substring Coalesce".split()
)


#: The schema's name before a view; strings, quoted names and comments are matched first and stay as they are.
_QUALIFIER = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/)|\banalytics\s*\.\s*""", re.S | re.I)


#: Date functions that callers know and Spark lacks: the span between two times, and the start of the bin of a width, counted from an origin, that a time lies in.
DATE_FUNCTIONS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION age(a TIMESTAMP, b TIMESTAMP) RETURNS INTERVAL DAY TO SECOND RETURN a - b",
    """CREATE OR REPLACE TEMPORARY FUNCTION date_bin(width INTERVAL DAY TO SECOND, at TIMESTAMP, origin TIMESTAMP) RETURNS TIMESTAMP
    RETURN origin + width * floor((unix_micros(at) - unix_micros(origin)) / (extract(DAY FROM width) * 86400000000 + extract(HOUR FROM width) * 3600000000 + extract(MINUTE FROM width) * 60000000 + extract(SECOND FROM width) * 1000000))""",
)


class Rejected(ValueError):
    pass


def _seq(x) -> list:
    return [x.apply(i) for i in range(x.length())]


def _name(x) -> str:
    return x.getClass().getSimpleName().rstrip("$").removesuffix("$")


def _walk(spark: SparkSession, plan, views: set[str], ctes: frozenset[str], used: set[str]) -> None:
    kind = _name(plan)
    if kind not in NODES:
        raise Rejected(f"{kind} is not allowed")
    if kind == "UnresolvedRelation":
        parts = [str(p) for p in _seq(plan.multipartIdentifier())]
        if len(parts) == 1 and parts[0].lower() in ctes:
            return
        if len(parts) > 2 or (len(parts) == 2 and parts[0].lower() != "analytics") or parts[-1].lower() not in views:
            raise Rejected(f"unknown view {'.'.join(parts)}")
        used.add(parts[-1].lower())
        return
    if kind == "UnresolvedWith":
        scope = ctes
        for pair in _seq(plan.cteRelations()):
            alias = str(pair._1())
            _walk(spark, pair._2(), views, scope, used)
            scope = scope | {alias.lower()}
        _walk(spark, plan.child(), views, scope, used)
        return
    for e in _seq(plan.expressions().toIndexedSeq()):
        _expression(spark, e, views, ctes, used)
    for child in _seq(plan.children().toIndexedSeq()):
        _walk(spark, child, views, ctes, used)


def _expression(spark: SparkSession, e, views: set[str], ctes: frozenset[str], used: set[str]) -> None:
    kind = _name(e)
    if kind not in EXPRESSIONS:
        raise Rejected(f"{kind} is not allowed")
    if kind == "UnresolvedFunction":
        parts = [str(p).lower() for p in _seq(e.nameParts())]
        if len(parts) != 1 or parts[0] not in FUNCTIONS:
            raise Rejected(f"function {'.'.join(parts)} is not allowed")
    if kind in ("Exists", "ScalarSubquery", "ListQuery"):
        _walk(spark, e.plan(), views, ctes, used)
    if kind == "InSubquery":
        _expression(spark, e.query(), views, ctes, used)
    for child in _seq(e.children().toIndexedSeq()):
        _expression(spark, child, views, ctes, used)


def validate(spark: SparkSession, sql: str, views: list[str]) -> set[str]:
    """The views that a statement reads; raises ``Rejected`` if it isn't a plain query over them."""
    if not sql.strip():
        raise Rejected("empty statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Rejected(f"not a query: {str(e).splitlines()[0][:200]}") from e
    used: set[str] = set()
    _walk(spark, plan, {v.lower() for v in views}, frozenset(), used)
    if not used:
        raise Rejected("no view is read")
    return used


#: Rows that one side of a join without a key may have, if its plan bounds them; bytes that a statement may read by the plan's estimate.
FEW_ROWS, MAX_READ = 1000, 2**40


def check_cost(df: DataFrame, max_read: int = MAX_READ, few_rows: int = FEW_ROWS) -> int:
    """The bytes that a statement reads, by its optimized plan's statistics; raises ``Rejected`` before anything runs if these are too many, or if it pairs all rows of two sides
    of which neither is bound to a few."""
    jvm, read = df.sparkSession._jvm, 0
    keys = jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        children = _seq(node.children().toIndexedSeq())
        if not children:
            read += int(node.stats().sizeInBytes())
        elif node.nodeName() == "Join" and keys.unapply(node).isEmpty():
            bound = [int(c.maxRows().get()) if c.maxRows().isDefined() else None for c in children]
            if not any(n is not None and n <= few_rows for n in bound):
                raise Rejected("a join has no equal columns and would pair all rows; join on a key")
        todo += children
    if read > max_read:
        raise Rejected(f"it would read about {read:,} bytes, more than {max_read:,}; ask for less")
    return read


@dataclass
class Result:
    columns: list[str]
    rows: list[tuple]
    truncated: bool


class Caller:
    """A caller's session: only the views whose groups they share, filtered."""

    def __init__(self, spark: SparkSession, views: dict[str, tuple[DataFrame, list[str] | None]], groups: list[str], max_rows: int = 200, timeout_s: float = 5.0, max_read: int = MAX_READ):
        self.session, self.max_rows, self.timeout_s, self.max_read = spark.newSession(), max_rows, timeout_s, max_read
        for statement in DATE_FUNCTIONS:
            self.session.sql(statement)
        self.views = [name for name, (_, need) in views.items() if groups and (need is None or set(need) & set(groups))]
        for name in self.views:
            df = views[name][0]
            DataFrame(self._moved(df), self.session).createOrReplaceTempView(name)

    def _moved(self, df: DataFrame):
        return self.session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.session._jsparkSession, df._jdf.queryExecution().analyzed())

    def query(self, sql: str) -> DataFrame:
        """A checked statement as a DataFrame of at most the cap's rows."""
        return self._checked(sql).limit(self.max_rows)

    def describe(self) -> str:
        """The caller's views and their columns in words, as a model is told of them."""
        return "\n".join(f"{v}({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in self.session.table(v).schema)})" for v in self.views)

    def _checked(self, sql: str) -> DataFrame:
        validate(self.session, sql, self.views)
        plain = _QUALIFIER.sub(lambda m: m[1] or "", sql)
        validate(self.session, plain, self.views)
        df = self.session.sql(plain)
        check_cost(df, self.max_read)
        return df

    def run(self, sql: str) -> Result:
        """Runs a checked statement, with one row more than the cap to tell whether rows are left; stops at the timeout."""
        df = self._checked(sql)
        sc, tag = self.session.sparkContext, f"caller-{id(self)}"
        sc.addJobTag(tag)
        timer = threading.Timer(self.timeout_s, lambda: sc.cancelJobsWithTag(tag))
        timer.start()
        try:
            rows = df.limit(self.max_rows + 1).collect()
        finally:
            timer.cancel()
            sc.removeJobTag(tag)
        return Result(df.columns, [tuple(r) for r in rows[: self.max_rows]], len(rows) > self.max_rows)
