"""Column lineage of single-level queries: name resolution and star expansion, a row at a time.

All rules are array expressions over the facts of a statement and the columns of its tables, so the
only joins are those that fetch these columns.  Of a table's columns only the names that a statement
mentions travel with it, unless it has a star.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.workspace import materialise

#: Codes and texts of what the analysis reports.
PARSE_ERROR = "SQL_PARSE_ERROR"
UNSUPPORTED = "UNSUPPORTED_COMPLEX_QUERY"
STAR_NEEDS_METADATA = "SELECT_STAR_METADATA_REQUIRED"
METADATA_MISSING = "METADATA_MISSING"
UNKNOWN_ALIAS = "UNKNOWN_TABLE_ALIAS"
UNKNOWN_COLUMN = "UNKNOWN_COLUMN"
AMBIGUOUS = "AMBIGUOUS_COLUMN"
TEXTS = {
    "cte": "CTE lineage is not supported in C04.",
    "subquery": "Subquery lineage is not supported in C04.",
    "no_table": "C04 requires at least one physical source table.",
    "expression": "C04 only supports direct column projections, not complex expressions.",
    "alias": "Table alias {} cannot be resolved from the FROM/JOIN tables.",
    "star_alias": "Table qualifier {0} in {0}.* cannot be resolved.",
    "column": "Column {} not found in table {} metadata.",
    "nowhere": "Column {} not found in metadata for any source table: {}.",
    "unqualified": "Column {} is not qualified. Metadata missing for: {}. Cannot determine ownership. Qualify with table alias.",
    "several": "Column {} exists in multiple tables: {}. Qualify with table alias.",
    "table_missing": "No metadata for table {}.",
    "tables_missing": "No metadata for table(s): {}. Import metadata to enable SELECT * expansion.",
    "star_missing": "SELECT * expansion requires metadata for all source tables.",
    "star": "SELECT * requires table metadata. Import metadata or qualify columns explicitly.",
}

LINEAGE = "array<struct<source_table:string,source_column:string,output_column:string>>"
DIAGNOSTICS = "array<struct<code:string,level:string,message:string>>"
NAMES = "array<string>"


def message(key: str, *parts: Column) -> Column:
    """The text of ``key`` with its places filled."""
    text = TEXTS[key]
    if "{0}" in text:
        return F.concat(*[x for k, piece in enumerate(text.split("{0}")) for x in ([parts[0]] if k else []) + [F.lit(piece)]])
    pieces = text.split("{}")
    return F.concat(*[x for k, piece in enumerate(pieces) for x in ([parts[k - 1]] if k else []) + [F.lit(piece)]])


def diagnostic(code: str, text: Column, level: str = "warning") -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), text.alias("message"))


def none(kind: str) -> Column:
    return F.array().cast(kind)


def attach_metadata(facts: DataFrame, columns_by_name: DataFrame) -> DataFrame:
    """Add ``meta``: per distinct table of a statement that has columns its name and the columns that matter.

    Only statements that will be resolved look tables up; a table of several parts never matches.
    Facts are written once, since look-up and result both read them and parsing is the dear part.
    """
    facts = materialise(facts, "facts")
    resolvable = F.col("parse_ok") & F.col("include_graph") & ~F.col("sniffs_cte") & ~F.col("has_with") & ~F.col("has_subquery")
    wanted = F.array_distinct(F.transform(F.filter("items", lambda i: i["kind"] == "column"), lambda i: i["column_name"]))
    stars = F.exists("items", lambda i: i["kind"] == "star")
    refs = facts.where(resolvable).select("sql_id", "sql", wanted.alias("wanted"), stars.alias("stars"), F.explode(F.array_distinct(F.transform("tables", lambda t: t["full_name"]))).alias("table_name"))
    key = F.xxhash64("sql")  # one id may come with several texts
    refs = refs.select("sql_id", key.alias("sql_key"), "wanted", "stars", "table_name")
    found = refs.join(columns_by_name, "table_name").select(
        "sql_id", "sql_key", F.struct("table_name", F.when(F.col("stars"), F.col("columns")).otherwise(F.array_intersect("columns", "wanted")).alias("columns")).alias("m")
    )
    meta = found.groupBy("sql_id", "sql_key").agg(F.collect_list("m").alias("meta"))
    out = facts.withColumn("sql_key", key).join(meta, ["sql_id", "sql_key"], "left").drop("sql_key")
    return out.withColumn("meta", F.coalesce("meta", none("array<struct<table_name:string,columns:array<string>>>")))


def _columns_of(table: Column) -> Column:
    """The known columns of a table; null where the catalog has none."""
    return F.get(F.filter("meta", lambda m: m["table_name"] == table), 0)["columns"]


def _joined(names: Column) -> Column:
    return F.array_join(names, ", ")


def _lineage(table: Column, column: Column, output: Column) -> Column:
    return F.struct(table.alias("source_table"), column.alias("source_column"), output.alias("output_column"))


def _outcome(lineages: Column, diagnostics: Column, features: Column | None = None) -> Column:
    return F.struct(lineages.cast(LINEAGE).alias("lineages"), diagnostics.cast(DIAGNOSTICS).alias("diagnostics"), (none(NAMES) if features is None else features).alias("features"))


def _refused(code: str, text: Column) -> Column:
    return _outcome(none(LINEAGE), F.array(diagnostic(code, text)))


def _owner(item: Column) -> Column:
    """The table that a qualifier names: the last of its alias, else, for columns, a table of that full name."""
    q = item["qualifier"]
    by_alias = F.try_element_at(F.filter("tables", lambda t: t["alias"] == q), F.lit(-1))["full_name"]
    by_name = F.when((item["kind"] == "column") & F.exists("tables", lambda t: t["full_name"] == q), q)
    only = F.when((item["kind"] == "column") & (F.size("tables") == 1), F.get("tables", 0)["full_name"])
    return F.when(q != "", F.coalesce(by_alias, by_name)).otherwise(only)


def _column_outcome(item: Column, owner: Column) -> Column:
    name = item["column_name"]
    output = F.when(item["alias"] != "", item["alias"]).otherwise(name)
    known = _columns_of(owner)
    missing = F.filter("tables", lambda t: _columns_of(t["full_name"]).isNull())
    holders = F.filter("tables", lambda t: F.array_contains(_columns_of(t["full_name"]), name))
    names = lambda tables: _joined(F.transform(tables, lambda t: t["full_name"]))
    return (
        F.when(owner.isNotNull() & known.isNotNull() & ~F.array_contains(known, name), _refused(UNKNOWN_COLUMN, message("column", name, owner)))
        .when(owner.isNotNull(), _outcome(F.array(_lineage(owner, name, output)), none(DIAGNOSTICS)))
        .when(item["qualifier"] != "", _refused(UNKNOWN_ALIAS, message("alias", item["qualifier"])))
        .when(F.size(missing) > 0, _refused(AMBIGUOUS, message("unqualified", name, names(missing))))
        .when(F.size(holders) == 1, _outcome(F.array(_lineage(holders[0]["full_name"], name, output)), none(DIAGNOSTICS)))
        .when(F.size(holders) > 1, _refused(AMBIGUOUS, message("several", name, names(holders))))
        .otherwise(_refused(UNKNOWN_COLUMN, message("nowhere", name, names(F.col("tables")))))
    )


def _star_outcome(item: Column, owner: Column) -> Column:
    expand = lambda table: F.transform(_columns_of(table), lambda c: _lineage(table, c, c))
    names = F.array_distinct(F.transform("tables", lambda t: t["full_name"]))
    known = F.filter(names, lambda n: _columns_of(n).isNotNull())
    missing = F.filter(names, lambda n: _columns_of(n).isNull())
    lacking = F.size(missing) > 0
    nothing = lacking & (F.size(known) == 0)
    first = F.when(lacking, F.array(diagnostic(METADATA_MISSING, message("tables_missing", _joined(missing))))).otherwise(none(DIAGNOSTICS))
    second = F.when(nothing, F.array(diagnostic(STAR_NEEDS_METADATA, message("star_missing")))).otherwise(none(DIAGNOSTICS))
    tags = F.concat(F.when(lacking, F.array(F.lit("metadata_missing"))).otherwise(none(NAMES)), F.when(nothing, F.array(F.lit("select_star"))).otherwise(none(NAMES)))
    return (
        F.when((item["qualifier"] != "") & owner.isNull(), _refused(UNKNOWN_ALIAS, message("star_alias", item["qualifier"])))
        .when((item["qualifier"] != "") & _columns_of(owner).isNull(), _refused(METADATA_MISSING, message("table_missing", owner)))
        .when(item["qualifier"] != "", _outcome(expand(owner), none(DIAGNOSTICS)))
        .otherwise(_outcome(F.flatten(F.transform(known, expand)), F.concat(first.cast(DIAGNOSTICS), second.cast(DIAGNOSTICS)), tags))
    )


def resolve(facts: DataFrame, has_metadata: bool = True) -> DataFrame:
    """Add ``resolved``: status, lineages, diagnostics and features of the select list.

    ``facts`` has ``meta`` (see :func:`attach_metadata`).  Stars come before other items; each item gives
    lineage or a diagnostic.  WITH, subqueries and queries without a table are refused whole, as are
    stars when ``has_metadata`` is false.  Matching is exact, letter case included; columns that are
    used elsewhere than in the select list give no lineage.  Star tables follow the FROM clause.
    """
    stars = F.filter("items", lambda i: i["kind"] == "star")
    others = F.filter("items", lambda i: i["kind"] != "star")
    owned = lambda items: F.transform(items, lambda i: F.struct(i.alias("i"), _owner(i).alias("owner")))
    facts = facts.withColumns({"_stars": owned(stars), "_others": owned(others)})
    done_stars = F.transform("_stars", lambda x: _star_outcome(x["i"], x["owner"]))
    done_others = F.transform("_others", lambda x: F.when(x["i"]["kind"] == "column", _column_outcome(x["i"], x["owner"])).otherwise(_refused(UNSUPPORTED, message("expression"))))
    facts = facts.withColumn("_done", F.concat(done_stars, done_others))
    refused = lambda code, key, tag: F.struct(none(LINEAGE).alias("lineages"), F.array(diagnostic(code, message(key))).cast(DIAGNOSTICS).alias("diagnostics"), F.array(F.lit(tag)).alias("features"))
    gate = (
        F.when(F.col("has_with"), refused(UNSUPPORTED, "cte", "cte"))
        .when(F.col("has_subquery"), refused(UNSUPPORTED, "subquery", "subquery"))
        .when(F.lit(not has_metadata) & (F.size("_stars") > 0), refused(STAR_NEEDS_METADATA, "star", "select_star"))
        .when(F.size("tables") == 0, refused(UNSUPPORTED, "no_table", "missing_source_table"))
    )
    gathered = lambda part: F.flatten(F.transform("_done", lambda d: d[part])).alias(part)
    rest = F.struct(gathered("lineages"), gathered("diagnostics"), gathered("features"))
    facts = facts.withColumn("resolved", F.coalesce(gate, rest))
    clean = F.size("resolved.diagnostics") == 0
    status = F.when(clean, "success").otherwise("partial")
    return facts.withColumn("resolved", F.col("resolved").withField("status", status).withField("confidence_level", F.when(clean, "high").otherwise("unknown"))).drop("_stars", "_others", "_done")


def column_lineage(resolved: DataFrame) -> DataFrame:
    """``sql_id, ord, source_table, source_column, output_column`` of every lineage found."""
    rows = resolved.select("sql_id", F.posexplode("resolved.lineages").alias("ord", "l"))
    return rows.select("sql_id", "ord", "l.*")
