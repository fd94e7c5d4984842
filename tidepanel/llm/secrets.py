"""Secret scans over an incremental ledger of blobs.

Every historical version of a file is addressed by the SHA-256 of its content. The ledger, a
Parquet table, has a row for each (blob, rule, rule version) that was ever scanned, with the
spans found. A scan looks only at pairs that the ledger lacks and adds them; findings then join
back to every path that holds the blob. All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.session import shared_path

LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if `group` has at least `least` characters.

    A text with such a match also has one of `hint`, which is quick to look for.
    """

    name: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str


#: fixed values: the three kinds of secrets, in the order in which ties are listed
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, r"[A-Za-z0-9+/_.=-]{12,}"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 16, r"[0-9a-f]{16,}"),
)


def rule_spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) in code points of the rule's matches, leftmost and not overlapping.

    The pieces between matches and the matches themselves follow each other, so that running
    lengths give positions; matches whose group is too short take part in that and are dropped.
    """
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    rows = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(state: Column, row: Column) -> Column:
        first = state["at"] + F.length(row["gap"])
        last = first + F.coalesce(F.length(row["hit"]), F.lit(0))
        found = F.when(F.length(row["value"]) >= rule.least, F.concat(state["found"], F.array(F.struct(first.alias("start"), last.alias("end"))))).otherwise(state["found"])
        return F.struct(last.alias("at"), found.alias("found"))

    spans = F.aggregate(rows, start, step, lambda state: state["found"])
    return F.when(text.rlike(rule.hint), spans).otherwise(none)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path; one that isn't there yet is empty."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Scan the (blob, rule version) pairs that the ledger lacks and append them; returns (path, blob).

    Each distinct blob is scanned once, through the version with the smallest path that holds it.
    Null content is an empty blob; a null path is a path of its own. Other columns are left aside.
    """
    spark = versions.sparkSession
    rows = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(content_col).cast("string"), F.lit("")).alias("content"))
    rows = rows.withColumn("blob", F.sha2("content", 256))
    paths = rows.select("path", "blob")
    known = read_ledger(spark, ledger)
    names = [F.lit(f"{r.name}/{r.version}") for r in rules]
    done = known.groupBy("blob").agg(F.collect_set(F.concat_ws("/", "rule", F.col("version").cast("string"))).alias("done"))
    unseen = paths.groupBy("blob").agg(F.min("path").alias("path")).join(done, "blob", "left")
    unseen = unseen.withColumn("todo", F.array_except(F.array(*names), F.coalesce("done", F.array().cast("array<string>")))).where(F.size("todo") > 0).select(F.col("blob").alias("new_blob"), F.col("path").alias("rep"), "todo")
    holds = F.col("path").eqNullSafe(F.col("rep")) & (F.col("blob") == F.col("new_blob"))
    texts = rows.join(unseen.hint("shuffle_hash"), holds).select("blob", "content", "todo")
    found = texts.select("blob", F.explode(F.array(*[F.when(F.array_contains("todo", f"{r.name}/{r.version}"), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), rule_spans(F.col("content"), r).alias("spans"))) for r in rules])).alias("x"))
    found.where("x is not null").select("blob", "x.*").write.mode("append").parquet(ledger)
    return paths


def findings(paths: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, one array of spans for each rule) for every row of paths, from the ledger."""
    known = read_ledger(paths.sparkSession, ledger).where(F.size("spans") > 0)
    wanted = reduce(lambda a, b: a | b, [(F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules])
    each = known.where(wanted).groupBy("blob").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("spans"))).alias(r.name) for r in rules])
    none = F.array().cast("array<struct<start:int,end:int>>")
    return paths.join(each, "blob", "left").select("path", "blob", *[F.coalesce(r.name, none).alias(r.name) for r in rules])


def _tagged(rank: int, rule: Rule) -> Column:
    return F.transform(F.col(rule.name), lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(rule.name).alias("kind")))


def span_list(rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of all spans by start, then kind as listed, joined by commas."""
    tagged = F.concat(*[_tagged(k, r) for k, r in enumerate(rules)])
    return F.array_join(F.transform(F.array_sort(tagged), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def document_secrets(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs.

    Null and empty texts have no spans. Repeated rows give repeated rows; an empty table gives an
    empty result. Texts of any length are scanned whole; ids keep their types; columns of docs beside the
    two are left aside, whatever their names. Without a ledger a new one is begun in the shared folder.
    """
    ledger = ledger or shared_path(docs.sparkSession, "secret-ledger")
    paths = scan_versions(docs, ledger, path_col=id_col, content_col=text_col)
    found = findings(paths, ledger).withColumn("spans", span_list())
    counts = [F.size(r.name).cast("long").alias(f"n_{r.name}") for r in RULES]
    return found.select(F.col("path").alias(id_col), *counts, F.sha2("spans", 256).alias("base_sha256"), "spans")
