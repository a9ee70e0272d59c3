"""Quality rules whose cutoffs keep the false rejection of good documents below a stated risk, per language.

For each rule and stratum (language) cutoffs of a fixed grid are tested from the most lenient on, on the labelled
documents of quality 1: a cutoff is certified while the exact binomial (Clopper-Pearson) upper bound on the share of
good documents that it rejects is at most RISK divided by the number of rules, and the first that fails ends the
sequence (fixed-sequence testing, which needs no correction inside it). The bounds hold together with confidence
1 - DELTA by Bonferroni's correction over rules and strata. The tightest certified cutoff is used; where none is
certified, as with too few labels, the rule rejects nothing.

* null, empty or blank text: rejected as "empty". Null lang: the stratum "". Null doc_id: judged like any other.
* labels that are null or of unknown documents don't count; a doc_id with several labels is good if any says so.
* repeated rows give repeated rows in the result; in the calibration equal rows (doc_id, lang, text) of a labelled document count once.
* an empty table gives an empty result; without labels only "empty" rejects. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_RE, Scratch, table, words

RISK, DELTA = 0.02, 0.05


@dataclass(frozen=True)
class Rule:
    """Rejects where the feature is above the cutoff, or below it; grid goes from lenient to tight."""

    name: str
    above: bool
    grid: tuple[float, ...]


RULES = (
    Rule("few_words", False, tuple(float(k) for k in range(1, 65))),
    Rule("symbols", True, tuple(k / 100 for k in range(60, 0, -1))),
    Rule("capitals", True, tuple(k / 100 for k in range(100, 1, -2))),
    Rule("digits", True, tuple(k / 100 for k in range(60, 0, -1))),
    Rule("long_words", True, tuple(float(k) for k in range(60, 3, -1))),
    Rule("few_distinct", False, tuple(k / 100 for k in range(1, 80))),
    Rule("repeated_lines", True, tuple(k / 50 for k in range(50, 0, -1))),
)


def features() -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    length, n = F.greatest(F.length(text), F.lit(1)), words(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)) / length
    tokens = F.filter(F.split(F.lower(text), "[ \t\r\n]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    distinct = lambda a: F.size(F.array_distinct(a)) / F.greatest(F.size(a), F.lit(1))
    return {
        "few_words": n.cast("double"),
        "symbols": count("[#$%&*|~<>{}^=@!]"),
        "capitals": count("[A-Z]"),
        "digits": count("[0-9]"),
        "long_words": length / F.greatest(n, F.lit(1)),
        "few_distinct": distinct(tokens),
        "repeated_lines": 1 - distinct(lines),
    }


def allowed(n: int, risk: float, delta: float) -> int:
    """The most rejections among n good documents whose upper bound is within the risk: P(Binomial(n, risk) <= k) <= delta. -1 if not even 0."""
    total, k = 0.0, -1
    while k < n:
        i = k + 1
        total += exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(risk) + (n - i) * log(1 - risk))
        if total > delta:
            return k
        k = i
    return k


def position(rule: Rule, value: Column) -> Column:
    """Place of the most lenient cutoff that rejects, from 1 on (every later one does too); the grid's length and 1 if none does."""
    spared = lambda c: value <= c if rule.above else value >= c
    return F.size(F.filter(F.array(*[F.lit(c) for c in rule.grid]), spared)) + 1


def placed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, stratum, blank, at): at has position() of each rule. The only step that reads texts."""
    values = features()
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum")
    blank = ~F.coalesce("text", F.lit("")).rlike(WORD_RE)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang"), F.col("text").cast("string"))
    rows = rows.select("doc_id", stratum, blank.alias("blank"), F.xxhash64("text").alias("text"), *[values[r.name].alias(r.name) for r in RULES])
    rows = scratch.keep(rows, "features")  # else the features would be computed anew for each cutoff
    return scratch.keep(rows.select("doc_id", "stratum", "blank", "text", F.array(*[position(r, F.col(r.name)).cast("int") for r in RULES]).alias("at")), "placed")


def cutoffs(rows: DataFrame, labels: DataFrame, *, risk: float = RISK, delta: float = DELTA) -> dict[str, dict[str, int]]:
    """{stratum: {rule: place in its grid, from 1 on}} of the certified cutoffs. rows are of placed()."""
    good = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).filter("quality > 0").select("doc_id")
    known = rows.filter("not blank").join(good, "doc_id").distinct()
    counts = known.select("stratum", F.posexplode("at").alias("rule", "at")).groupBy("stratum", "rule", "at").count().collect()  # strata x rules x grid rows
    own: dict[tuple[str, int], dict[int, int]] = {}
    for r in counts:
        own.setdefault((r.stratum, r.rule), {})[r["at"]] = r["count"]
    strata = sorted({s for s, _ in own})
    out: dict[str, dict[str, int]] = {s: {} for s in strata}
    for s in strata:
        for k, rule in enumerate(RULES):
            most, rejected = allowed(sum(own[s, k].values()), risk / len(RULES), delta / (len(RULES) * len(strata))), 0
            for i in range(1, len(rule.grid) + 1):
                rejected += own[s, k].get(i, 0)
                if rejected > most:
                    break
                out[s][rule.name] = i
    return out


def judge(spark: SparkSession, rows: DataFrame, chosen: dict[str, dict[str, int]]) -> DataFrame:
    """(doc_id, stratum, failed, keep), one row per document; failed has the names of the rules that reject it. The cutoffs are a table, so the plan doesn't grow with the strata."""
    cuts = spark.createDataFrame([(s, [own.get(r.name, 0) for r in RULES]) for s, own in chosen.items()], "stratum string, cut array<int>")
    at, cut = F.col("at"), F.coalesce("cut", F.array_repeat(F.lit(0), len(RULES)))
    names = [F.when(F.get(at, F.lit(k)) <= F.get(cut, F.lit(k)), F.lit(r.name)) for k, r in enumerate(RULES)]
    failed = F.array_join(F.filter(F.array(F.when(F.col("blank"), F.lit("empty")), *names), lambda x: x.isNotNull()), ",")
    return rows.join(cuts, "stratum", "left").select("doc_id", "stratum", failed.alias("failed")).withColumn("keep", F.col("failed") == "")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(table(spark, sf_dir, "documents"), Scratch(spark))
    return judge(spark, rows, cutoffs(rows, table(spark, sf_dir, "labels")))


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}')) / greatest(length(t), 1)"


_WORDS = "regexp_extract_all({}, '[^ \t\r\n]+')"
_FEATURES = {
    "few_words": f"len({_WORDS.format('t')})::double",
    "symbols": _count("[#$%&*|~<>{}^=@!]"),
    "capitals": _count("[A-Z]"),
    "digits": _count("[0-9]"),
    "long_words": f"greatest(length(t), 1) / greatest(len({_WORDS.format('t')}), 1)",
    "few_distinct": f"len(list_distinct({_WORDS.format('lower(t)')})) / greatest(len({_WORDS.format('lower(t)')}), 1)",
    "repeated_lines": "1 - len(list_distinct(lines)) / greatest(len(lines), 1)",
}
_GRID = ", ".join(f"({k}, '{r.name}', {str(r.above).lower()}, {i}, {c!r}::double)" for k, r in enumerate(RULES) for i, c in enumerate(r.grid, 1))

def oracle(risk: float = RISK, delta: float = DELTA) -> str:
    return f"""
with grid(rule, name, above, place, cut) as (values {_GRID}),
d as (select row_number() over () as id, doc_id, coalesce(lang, '') as stratum, text, coalesce(text, '') as t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') as lines from documents),
f as (select id, doc_id, stratum, text, len({_WORDS.format("t")}) = 0 as blank, {", ".join(f"{sql} as {name}" for name, sql in _FEATURES.items())} from d),
v as (unpivot (select id, doc_id, stratum, text, blank, {", ".join(r.name for r in RULES)} from f) on {", ".join(r.name for r in RULES)} into name name value x),
p as (select id, doc_id, stratum, text, blank, rule, name, 1 + count(*) filter (case when above then x <= cut else x >= cut end) as spot from v join grid using (name) group by all),
good as (select doc_id from labels where doc_id is not null group by doc_id having max(quality) > 0),
known as (select distinct stratum, rule, doc_id, text, spot from p semi join good using (doc_id) where not blank),
size as (select stratum, rule, count(*) as n, (select count(distinct stratum) from known) as strata from known group by stratum, rule),
term as (select stratum, rule, n, strata, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({risk} / {len(RULES)}) + (n - k) * ln(1 - {risk} / {len(RULES)})) as q from (select *, unnest(range(n)) as k from size)),
total as (select *, sum(q) over (partition by stratum, rule order by k) as below from term),
most as (select stratum, rule, coalesce(max(k) filter (below <= {delta} / ({len(RULES)} * strata)), -1) as most from total group by stratum, rule),
tried as (select stratum, rule, place, (select count(*) from known k where k.stratum = most.stratum and k.rule = most.rule and k.spot <= place) <= most as fine from most join grid using (rule)),
chosen as (select stratum, rule, coalesce(min(place) filter (not fine) - 1, max(place)) as cut from tried group by stratum, rule),
bad as (select id, string_agg(name, ',' order by rule) as failed from p join chosen using (stratum, rule) where spot <= cut group by id)
select doc_id, stratum, concat_ws(',', case when blank then 'empty' end, failed) as failed, not blank and failed is null as keep from f left join bad using (id)
"""


ORACLE = oracle()
