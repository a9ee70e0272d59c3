"""Secret scans of every historical version, through a ledger of content-addressed blobs.

A blob is a text under its SHA-256. The ledger has the rule versions that each blob was scanned for; only pairs of
blob and rule version that are not in it are scanned, once per blob however many paths hold it, and the findings are
joined back to all paths. The ledger is asked by blob ids, before any text moves: a scan with nothing new moves none,
one with few new blobs only theirs. Secrets leave as their SHA-256 only.

* null text: no blob. Null doc_id: its findings have a null doc_id. Repeated rows give each finding once.
* an empty text is a blob without findings. An empty table gives an empty result; other columns are not read by scan().
* a scan that dies between its two writes leaves findings without their ledger rows: the next scans those blobs again
  and the findings, equal to the old ones, count once.
* a private key is a match from its BEGIN line through its END line, or to the end of a text that has none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import Scratch, table


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: In the syntax that Java's and RE2's expressions share.
RULES = (
    Rule("aws_access_key", 1, "AKIA[0-9A-Z]{16}"),
    Rule("assigned_token", 1, "(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi_?[Kk]ey|API_?KEY)[ \t]*[=:][ \t]*[\"']?[0-9A-Za-z_/+-]{16,}"),
    Rule("password", 1, "(?:[Pp]assword|PASSWORD|[Pp]asswd)[ \t]*[=:][ \t]*[\"']?[^ \t\r\n\"']{8,}"),
    Rule("private_key", 2, "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?s:.)*?-----END [A-Z ]*PRIVATE KEY-----|(?s:.)*)"),
    Rule("github_token", 1, "gh[pousr]_[0-9A-Za-z]{36}"),
    Rule("slack_token", 1, "xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("google_key", 1, "AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", 1, "eyJ[0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]{8,}"),
)
#: New blobs (some 150 bytes each) up to which their ids are broadcast, so that only their texts move; with more, all texts do.
BROADCAST_BLOBS = 100_000
FINDINGS = "blob_id string, rule string, rule_version int, secret_sha256 string, occurrences long"
_MATCHES = "array<struct<rule:string,rule_version:int,secret_sha256:string>>"
LEDGER = "blob_id string, rules array<string>"


def blob_id(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _read(spark: SparkSession, path: str | None, schema: str) -> DataFrame | None:
    if path is None:
        return None
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _matches(rule: Rule) -> Column:
    one = lambda m: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("rule_version"), F.sha2(m.cast("binary"), 256).alias("secret_sha256"))
    return F.transform(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)), one)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """FINDINGS of (blob_id, text, todo): todo has the keys of the rules to scan for."""
    found = F.concat(*[F.when(F.array_contains("todo", r.key), _matches(r)).otherwise(F.array().cast(_MATCHES)) for r in rules])
    return blobs.select("blob_id", F.explode(found).alias("f")).groupBy("blob_id", "f.rule", "f.rule_version", "f.secret_sha256").agg(F.count("*").alias("occurrences"))


def scan(spark: SparkSession, versions: DataFrame, *, rules: tuple[Rule, ...] = RULES, ledger: str | None = None, broadcast_blobs: int = BROADCAST_BLOBS, scratch: Scratch | None = None) -> DataFrame:
    """FINDINGS of the blobs of versions (of which it reads the column text), new ones and those of earlier scans.

    ledger: a folder that keeps the scans' findings and the ledger; without one, nothing counts as seen.
    """
    scratch = scratch or Scratch(spark)
    keys = F.array(*[F.lit(r.key) for r in rules])
    texts = versions.select(F.col("text").cast("string")).filter("text is not null").select(blob_id(F.col("text")).alias("blob_id"), "text")
    once = lambda df: df.repartition("blob_id").dropDuplicates(["blob_id"])
    if ledger is None:
        return scan_blobs(once(texts).withColumn("todo", keys), rules)
    ids = scratch.keep(texts.select("blob_id").distinct(), "ids")
    seen, old = _read(spark, f"{ledger}/seen", LEDGER), _read(spark, f"{ledger}/findings", FINDINGS)
    todo = ids.withColumn("todo", keys)
    if seen is not None:
        had = seen.join(ids, "blob_id", "left_semi").groupBy("blob_id").agg(F.flatten(F.collect_list("rules")).alias("had"))
        todo = ids.join(had, "blob_id", "left").select("blob_id", F.array_except(keys, F.coalesce("had", F.array().cast("array<string>"))).alias("todo")).filter(F.size("todo") > 0)
    todo = scratch.keep(todo, "todo")
    many = todo.count()
    if many:
        blobs = once(texts.join(F.broadcast(todo), "blob_id")) if many <= broadcast_blobs else once(texts).join(todo, "blob_id")
        new = scratch.keep(scan_blobs(blobs, rules), "new")
        new.write.mode("append").parquet(f"{ledger}/findings")
        todo.select("blob_id", F.col("todo").alias("rules")).write.mode("append").parquet(f"{ledger}/seen")
        if old is None:
            return new
    elif old is None:
        return spark.createDataFrame([], FINDINGS)
    wanted = F.broadcast(spark.createDataFrame([(r.name, r.version) for r in rules], "rule string, rule_version int"))  # a row per rule
    known = spark.read.schema(FINDINGS).parquet(f"{ledger}/findings").join(wanted, ["rule", "rule_version"]).join(ids, "blob_id", "left_semi")
    return known.select("blob_id", "rule", "rule_version", "secret_sha256", "occurrences").distinct()


def findings_by_path(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """(doc_id, blob_id, rule, rule_version, secret_sha256, occurrences) for every path of a blob with findings."""
    paths = docs.filter("text is not null").select(F.col("doc_id").cast("long"), blob_id(F.col("text").cast("string")).alias("blob_id")).distinct()
    return paths.join(scan(spark, docs, **options), "blob_id").select("doc_id", "blob_id", "rule", "rule_version", "secret_sha256", "occurrences")


def redacted(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules' matches in the original text replaced; those that overlap go as one, under the name of the rule that starts first."""
    patterns = [(r.name, re.compile(r.pattern)) for r in rules]

    def one(value: str) -> str:
        spans = sorted((m.start(), -m.end(), k) for k, (_, p) in enumerate(patterns) for m in p.finditer(value))
        out, at, end = [], 0, 0
        for start, stop, k in spans:
            if start >= end:
                out += [value[at:start], f"[{patterns[k][0]}]"]
            at = end = max(end, -stop)
        return "".join([*out, value[at:]])

    def run(values: pd.Series) -> pd.Series:
        return values.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def redact(spark: SparkSession, docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, ledger: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """The documents, with each secret replaced by its rule's name in the texts that have findings, and n_chars to match."""
    scratch = scratch or Scratch(spark)
    found = scratch.keep(scan(spark, docs, rules=rules, ledger=ledger, scratch=scratch).select("blob_id").distinct(), "blobs")
    mark = next(c for c in (f"__blob{k}" for k in range(len(docs.columns) + 1)) if c not in docs.columns)
    hit = docs.withColumn(mark, blob_id(F.col("text").cast("string"))).join(found.select(F.col("blob_id").alias(mark), F.lit(True).alias(f"{mark}_hit")), mark, "left")
    hit = hit.withColumn(mark, F.when(F.col(f"{mark}_hit"), redacted(F.when(F.col(f"{mark}_hit"), F.col("text")), rules)).otherwise(F.col("text")))
    changed = {"text": F.col(mark)} | ({"n_chars": F.when(F.col(f"{mark}_hit"), F.length(mark).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return hit.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans through one ledger: the first fills it, the second, of the same versions, finds nothing new and answers from it."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    ledger = f"{scratch.base}/ledger"
    scan(spark, docs, ledger=ledger, scratch=scratch)
    return findings_by_path(spark, docs, ledger=ledger, scratch=scratch)


def _sql(pattern: str) -> str:
    return "e'" + pattern.replace("\\", "\\\\").replace("'", "\\'").replace("\t", "\\t").replace("\r", "\\r").replace("\n", "\\n") + "'"


ORACLE = "with f as (" + " union all ".join(f"select doc_id, text, '{r.name}' as rule, {r.version} as rule_version, unnest(regexp_extract_all(text, {_sql(r.pattern)})) as m from documents" for r in RULES)
ORACLE += """), d as (select distinct doc_id, text, rule, rule_version, m from f), n as (select text, rule, rule_version, m, doc_id, count(*) as k from f group by all),
c as (select text, rule, rule_version, m, doc_id, k, (select count(*) from documents x where x.doc_id is not distinct from n.doc_id and x.text = n.text) as copies from n)
select doc_id, sha256(text) as blob_id, rule, cast(rule_version as integer) as rule_version, sha256(m) as secret_sha256, cast(k / copies as bigint) as occurrences from c
"""
