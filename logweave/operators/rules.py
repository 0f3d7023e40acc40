"""Replication rules and per-event decisions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.scan import BLOCK_SPAN, Scan, block_of, counted_scan
from logweave.operators.small import join_small

# lower-cased database to expressions, or a table of them (schema_name, table_regexes) as parse_rule_rows gives it
Rules = Mapping[str, Sequence[str]] | DataFrame

RULE_COLUMNS = ("__database", "__pattern")
RULE_SEPARATOR = "@"
BEGIN = "BEGIN"

# marks of single events
FILE_EVENT, COMMIT, BEGIN_QUERY, WANTED_QUERY, OTHER_QUERY, WANTED_TABLE, OTHER_TABLE, ROW_LIKE = range(8)


def parse_rules(rules: Iterable[str]) -> dict[str, list[str]]:
    """Group ``database@tableRegex`` settings by lower-cased database."""
    grouped: dict[str, list[str]] = {}
    for rule in rules:
        parts = rule.split(RULE_SEPARATOR)
        if len(parts) != 2:
            raise ValueError(f"rule {rule!r} is not database{RULE_SEPARATOR}tableRegex")
        grouped.setdefault(parts[0].lower(), []).append(parts[1])
    return grouped


def parse_rule_rows(df: DataFrame, rule: str = "rule") -> DataFrame:
    """The same for rules kept in a table: (schema_name, table_regexes); a malformed rule fails the query."""
    parts = F.split(F.col(rule), RULE_SEPARATOR, -1)
    checked = F.when(F.size(parts) == 2, parts).otherwise(
        F.raise_error(F.concat(F.lit("malformed rule: "), F.col(rule))).cast("array<string>")
    )
    return (
        df.select(checked.alias("parts"))
        .select(F.lower(F.col("parts")[0]).alias("schema_name"), F.col("parts")[1].alias("table_regex"))
        .groupBy("schema_name")
        .agg(F.sort_array(F.collect_set("table_regex")).alias("table_regexes"))
    )


def schema_matches(rules: Mapping[str, Sequence[str]], schema: Column) -> Column:
    """Configured database? The table part of a rule is not looked at."""
    return F.coalesce(F.lower(schema).isin(sorted(rules)), F.lit(False))


def table_matches(rules: Mapping[str, Sequence[str]], schema: Column, table: Column) -> Column:
    """Configured database and any of its expressions found anywhere in the lower-cased table name."""
    matched = F.lit(False)
    for database in sorted(rules):
        any_of = "|".join(f"(?:{regex})" for regex in rules[database])
        matched = matched | ((F.lower(schema) == database) & F.lower(table).rlike(any_of))
    return F.coalesce(matched, F.lit(False))


def decisions(df: DataFrame, rules: Rules) -> tuple[DataFrame, Column, Column]:
    """``df`` with what it takes, and whether its row's schema and table are wanted.

    Rules given as a table meet the rows by their lower-cased schema, once: the plan is the same for one database and for any number,
    and a row is matched against its own database's expressions only. The columns that this adds are :data:`RULE_COLUMNS`.
    """
    if isinstance(rules, Mapping):
        schema = F.col("schema_name")
        return df, schema_matches(rules, schema), table_matches(rules, schema, F.col("table_name"))
    database, pattern = RULE_COLUMNS
    any_of = F.concat_ws("|", F.transform("table_regexes", lambda regex: F.concat(F.lit("(?:"), regex, F.lit(")"))))
    table = rules.select(F.col("schema_name").alias(database), any_of.alias(pattern))
    met = join_small(df.withColumn(database, F.lower("schema_name")), table, [database])
    known = F.col(pattern).isNotNull()
    return met, known, F.coalesce(known & F.rlike(F.lower("table_name"), F.col(pattern)), F.lit(False))


def is_begin(query: Column) -> Column:
    return F.coalesce(F.upper(query) == BEGIN, F.lit(False))


def filter_schema(df: DataFrame, rules: Rules) -> DataFrame:
    """Statement events of configured databases."""
    met, wanted, _ = decisions(df.where(F.col("kind") == "QUERY"), rules)
    return met.where(wanted).drop(*RULE_COLUMNS)


def filter_tables(df: DataFrame, rules: Rules) -> DataFrame:
    """Table-map events of configured tables."""
    met, _, wanted = decisions(df.where(F.col("kind") == "TABLE_MAP"), rules)
    return met.where(wanted).drop(*RULE_COLUMNS)


def classify(df: DataFrame, rules: Rules) -> DataFrame:
    """Add ``mark``: all that routing needs to know about one event by itself. Everything that reads the
    event's names and text happens here, before any shuffle."""
    met, wanted_schema, wanted_table = decisions(df, rules)
    kind = F.col("kind")
    mark = (
        F.when(kind.isin("ROTATE", "FORMAT"), FILE_EVENT)
        .when(kind == "XID", COMMIT)
        .when(
            kind == "QUERY",
            F.when(is_begin(F.col("query")), BEGIN_QUERY)
            .when(wanted_schema, WANTED_QUERY)
            .otherwise(OTHER_QUERY),
        )
        .when(
            kind == "TABLE_MAP",
            F.when(wanted_table, WANTED_TABLE).otherwise(OTHER_TABLE),
        )
        .otherwise(ROW_LIKE)
    )
    return met.withColumn("mark", mark.cast("tinyint")).drop(*RULE_COLUMNS)


def route_events(
    df: DataFrame,
    rules: Rules,
    scope: Sequence[str] = ("source_id",),
    span: int = BLOCK_SPAN,
) -> DataFrame:
    """Decide every event's fate in its source's order: see :func:`route_marked`."""
    return route_marked(classify(df, rules), scope, span)


def route_marked(df: DataFrame, scope: Sequence[str], span: int) -> DataFrame:
    """Adds ``epoch`` (commits before the event), ``in_tx`` and ``keep`` (state the event meets) and
    ``action``: tx, commit, standalone or drop. All three states are running values over the source's
    order - "latest value before me" with commits as resets - so no task ever needs a whole
    transaction or a whole source.
    """
    return counted_routes(df, scope, span)[0]


def counted_routes(df: DataFrame, scope: Sequence[str], span: int) -> tuple[DataFrame, int]:
    """:func:`route_marked` and the number of events."""
    mark = F.col("mark")
    commit = mark == COMMIT
    scanned, events = counted_scan(
        df.withColumn("block", block_of(F.col("log_pos"), span)),
        scope,
        [["log_file", "block"]],
        ["log_pos"],
        [
            Scan("epoch", commit.cast("bigint")),
            Scan("keep", F.when(mark.isin(COMMIT, OTHER_TABLE), False).when(mark == WANTED_TABLE, True), "last", default=False),
            Scan("in_tx", F.when(commit, False).when(mark.isin(BEGIN_QUERY, WANTED_TABLE), True), "last", default=False),
        ],
    )
    in_tx, keep = F.col("in_tx"), F.col("keep")
    action = (
        F.when(commit, "commit")
        .when(mark.isin(BEGIN_QUERY, WANTED_TABLE), "tx")
        .when(mark == WANTED_QUERY, F.when(in_tx, "tx").otherwise("standalone"))
        .when(mark == OTHER_QUERY, F.when(in_tx, "tx").otherwise("drop"))
        .when(mark == ROW_LIKE, F.when(~in_tx, "standalone").when(keep, "tx").otherwise("drop"))
        .otherwise("drop")
    )
    return scanned.withColumn("action", action), events
