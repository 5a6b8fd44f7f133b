"""Governed SQL: one read-only statement over listed tables, capped and masked."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import StatementError
from millrace.functions.masking import mask_frame


class Rejected(StatementError, ValueError):
    """A statement that may not run, and why."""


@dataclass
class Access:
    """What may be read: tables, and for each the kinds of its columns of personal data; rows a result may have."""

    tables: set[str]
    masked: dict[str, dict[str, str]] = field(default_factory=dict)
    max_rows: int = 5000


def fenced_sql(answer: str) -> str:
    """The statement in an answer: of its first fenced block, or the whole of it."""
    block = re.search(r"```(?:sql)?\s*\n(.*?)```", answer, re.S | re.I)
    return (block[1] if block else answer).strip().rstrip(";").strip()


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Names of the tables that a statement mentions, by Spark's own parser; anything but one plain query is rejected."""
    if not re.match(r"(?is)^\s*(/\*.*?\*/\s*|--[^\n]*\n\s*)*select\b", sql):
        raise Rejected("only a statement that begins with SELECT may run")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:  # the parser's own exception, in the JVM or wrapped
        raise Rejected(f"not a single valid statement: {str(error).splitlines()[0][:200]}") from None
    names, waiting = set(), [plan]
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if re.search(r"Command|Insert|Delete|Update|Merge|Drop|Create|Replace|Alter|Truncate|With$", kind):
            raise Rejected(f"{kind} may not run")
        if kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            names.add(".".join(parts.apply(i) for i in range(parts.length())))
        if kind == "UnresolvedTableValuedFunction":
            raise Rejected("table functions may not run")
        waiting += [node.children().apply(i) for i in range(node.children().length())]
        inner = node.innerChildren()
        waiting += [c for i in range(inner.length()) if hasattr(c := inner.apply(i), "innerChildren") and c.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans.logical")]
        waiting += _subqueries(node)
    return names


def _subqueries(node) -> list:
    """Plans of the subqueries in a node's expressions."""
    found, waiting = [], [node.expressions().apply(i) for i in range(node.expressions().length())]
    while waiting:
        e = waiting.pop()
        if e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            found.append(e.plan())
        waiting += [e.children().apply(i) for i in range(e.children().length())]
    return found


def guarded(spark: SparkSession, sql: str, access: Access, args: dict | None = None) -> DataFrame:
    """The statement's rows, `max_rows` at most, with personal data masked.

    Tables are checked in the whole plan, commas and subqueries included; a path or another catalog is no listed
    table. A statement that doesn't analyse is rejected with Spark's reason. Masks are applied to columns by the
    listed kinds and by name; if that fails the query fails.
    """
    sql = fenced_sql(sql)
    used = relations(spark, sql)
    if not used:
        raise Rejected("a statement needs a FROM")
    allowed = {t.lower() for t in access.tables}
    if forbidden := {t for t in used if t.lower() not in allowed}:
        raise Rejected(f"not listed: {', '.join(sorted(forbidden))}")
    try:
        df = spark.sql(sql, args=args)
    except PySparkException as error:
        raise Rejected(str(error).splitlines()[0]) from None
    kinds = {c: k for t in used for c, k in access.masked.get(t.lower(), {}).items() if c in df.columns}
    return mask_frame(df.limit(access.max_rows), kinds)


def schema_text(spark: SparkSession, tables: list[str], descriptions: dict[str, str] | None = None, most: int = 8000) -> str:
    """The columns of temporary views or tables as Markdown for a prompt, `most` characters at most."""
    parts = []
    for name in sorted(tables):
        fields = spark.table(name).schema.fields
        rows = "\n".join(f"- {f.name} ({f.dataType.simpleString()})" + (f": {d}" if (d := (descriptions or {}).get(f"{name}.{f.name}")) else "") for f in fields)
        parts.append(f"## {name}\n{rows}")
    return "\n\n".join(parts)[:most]


@dataclass(frozen=True)
class Review:
    """What becomes of a statement before it runs: `ok`; `corrected`, with the statement to run instead; or `rejected`, with a proposal where there is one."""

    verdict: str
    reason: str = ""
    proposal: str = ""


#: Names that differ in so many letters at most are proposed for each other.
NEAR = 3
COMPARISONS = ("EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "In", "InSet")
TRUNCATIONS = ("TruncDate", "TruncTimestamp")
DAYS = ("date", "timestamp", "timestamp_ntz")


def nearest_name(spark: SparkSession, name: str, names: set[str], most: int = NEAR) -> str | None:
    """Of `names` the one that takes the fewest changes of letters to become `name`, `most` at most; of equals the first in order. Spark counts the changes."""
    if not names:
        return None
    known = spark.createDataFrame([(n,) for n in sorted(names)], "n string")
    changes = known.select("n", F.levenshtein(F.lower("n"), F.lit(name.lower())).alias("d")).where(F.col("d") <= most)
    found = changes.orderBy("d", "n").first()
    return found.n if found else None


def _elsewhere(name: str, names: set[str]) -> str | None:
    """The listed table of the same last name, if only one has it: the right schema for a wrong one."""
    own = [n for n in sorted(names) if n.rsplit(".", 1)[-1].lower() == name.rsplit(".", 1)[-1].lower()]
    return own[0] if len(own) == 1 else None


def _nodes(plan) -> list:
    """All expressions of a plan, those of its subqueries too."""
    plans, found = [plan], []
    while plans:
        node = plans.pop()
        waiting = [node.expressions().apply(i) for i in range(node.expressions().length())]
        while waiting:
            e = waiting.pop()
            found.append(e)
            if hasattr(e, "plan") and e.getClass().getSimpleName() in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                plans.append(e.plan())
            waiting += [e.children().apply(i) for i in range(e.children().length())]
        plans += [node.children().apply(i) for i in range(node.children().length())]
    return found


def _cast_from(e) -> tuple[str, str] | None:
    """(type before, type after) of a conversion that the analyzer or the statement put around a value."""
    return (e.child().dataType().simpleString(), e.dataType().simpleString()) if e.getClass().getSimpleName() == "Cast" else None


def type_faults(df: DataFrame) -> list[str]:
    """What Spark's resolved plan converts that a writer hardly meant: dates cut from numbers, days compared with numbers or with texts that are no days."""
    faults = []
    for e in _nodes(df._jdf.queryExecution().analyzed()):
        kind = e.getClass().getSimpleName()
        sides = [e.children().apply(i) for i in range(e.children().length())]
        if kind in TRUNCATIONS:
            faults += [f"a date is cut from a {c[0]}: {e.sql()}" for s in sides if (c := _cast_from(s)) and c[0] not in (*DAYS, "string")]
        if kind in COMPARISONS:
            for s in sides:
                before, after = _cast_from(s) or ("", "")
                if after in DAYS and before == "string" and s.child().foldable() and _unreadable(df.sparkSession, s.child().sql(), after):
                    faults.append(f"a {after} is compared with a text that is none: {e.sql()}")
                elif before in DAYS and after not in DAYS or after in DAYS and before not in ("", "string", *DAYS):
                    faults.append(f"{before} and {after} are compared: {e.sql()}")
    return faults


def _unreadable(spark: SparkSession, literal: str, kind: str) -> bool:
    return spark.sql(f"SELECT try_cast({literal} AS {kind}) IS NULL AS none").first().none


def review(spark: SparkSession, sql: str, access: Access) -> Review:
    """Judges a statement by the catalog and by types, without running it.

    A table under a wrong schema is put right, if one listed table has its name; for another unknown table or column the listed one of the nearest name is proposed.
    """
    sql = fenced_sql(sql)
    try:
        used = relations(spark, sql)
    except Rejected as error:
        return Review("rejected", str(error))
    listed, corrected = {t.lower() for t in access.tables}, sql
    for name in sorted(t for t in used if t.lower() not in listed):
        if right := _elsewhere(name, access.tables):
            corrected = re.sub(rf"(?i)(?<![\w.]){re.escape(name)}(?![\w.])", right, corrected)
            continue
        return Review("rejected", f"no table {name}", nearest_name(spark, name, access.tables) or "")
    try:
        df = spark.sql(corrected)
    except PySparkException as error:
        condition = error.getCondition() or ""
        missing = (error.getMessageParameters() or {}).get("objectName", "").strip("`") if condition.startswith("UNRESOLVED_COLUMN") else ""
        columns = {c for t in access.tables for c in spark.table(t).columns}
        return Review("rejected", condition, (missing and nearest_name(spark, missing, columns)) or "")
    if faults := type_faults(df):
        return Review("rejected", faults[0])
    return Review("corrected", "", corrected) if corrected != sql else Review("ok")
