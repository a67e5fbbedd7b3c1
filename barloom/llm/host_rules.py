"""Host-level quality rules, in DataFrame operations only.

Each document gets its counts and fails or passes each of RULES. Failures are added up by rule and host (here: source), each
host's failure rate is shrunk towards all hosts' by a beta prior whose two parameters are fitted for that rule to the hosts
themselves (method of moments), and hosts of which a rule's shrunk rate reaches the limit are rejected with all their
documents. A document that fails the base rule goes by itself; one that fails another rule only speaks against its host.

Texts are read once; only counts are written, grouped and joined. The grouping is summed before it is shuffled, so a hot
host is one row a task, and the join back is an equi-join that Spark splits where a host is hot.

Defined cases: null text has no word and fails the base rule only; an empty text likewise; rows whose host is null form one
host of their own; repeated rows are each judged; an empty table gives an empty result; further columns are ignored.
Repeated windows are found by sorting: by hash, then by the words themselves, so that texts of any length are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import materialize, pick

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
HOST_LIMIT = 0.5

#: What speaks against a document, by name: few or repeated words, words of odd length, many symbols, repeated lines.
RULES = {
    "base": "n_words < 50 or 100 * n_repeat_words > 50 * n_words",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 12 * n_words)",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}


def with_repeat_words(df: DataFrame, words: str, name: str) -> DataFrame:
    """Adds how many words stand in a window of three words that the array column `words` has twice or more.

    Each step is a column of its own that the next one names more than once, so that Spark computes it once.
    """
    n, none = F.size(words), F.array().cast("array<long>")
    h = F.when(n < 4, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    df = df.withColumn("_h", h)
    # sort_array needs no comparing function: equal windows come together and keep their places
    keys = F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))))
    none_kept = F.array().cast("array<struct<h:bigint,a:string,b:string,c:string,i:int>>")
    df = df.withColumn("_k", F.when(F.size(F.array_distinct("_h")) == F.size("_h"), none_kept).otherwise(keys))

    def same(i, x):
        other = F.get("_k", i)
        return (other["h"] == x["h"]) & (other["a"] == x["a"]) & (other["b"] == x["b"]) & (other["c"] == x["c"])

    again = F.filter("_k", lambda x, i: ((i > 0) & same(i - 1, x)) | ((i < F.size("_k") - 1) & same(i + 1, x)))
    df = df.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"])))
    steps = F.transform("_p", lambda p, i: F.when(i == F.size("_p") - 1, F.lit(3)).otherwise(F.least(F.lit(3), F.get("_p", i + 1) - p)))
    return df.withColumn(name, F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)).drop("_h", "_k", "_p")


def counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, and a `<rule>_failed` for each of RULES."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE}]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    df = pick(docs, "doc_id", "text", host).select("doc_id", F.col(f"`{host}`").alias("host"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    df = with_repeat_words(df, "words", "n_repeat_words").select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    return df.withColumns({f"{rule}_failed": F.expr(test) for rule, test in RULES.items()})


def prior(n: float, failed: float, hosts: int, squares: float, spread: float) -> tuple[float, float]:
    """The beta prior's mean and strength, from sums over hosts: documents, failures, hosts, documents squared, and documents times rate squared.

    Moments weigh hosts by their documents. Where hosts differ no more than chance makes them, the prior gets the weight of a
    million documents, so every host has the common rate.
    """
    mean = failed / n if n else 0.0
    if hosts < 2 or not 0 < mean < 1:
        return mean, 1e6
    # between-host variance of the rate, less what binomial chance puts into it
    between = (spread / n - mean * mean - mean * (1 - mean) * (hosts - 1) / n) / max(1 - squares / (n * n), 1e-9)
    return mean, min(1e6, max(1e-3, mean * (1 - mean) / between - 1)) if between > 1e-12 else 1e6


def host_verdicts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, and for each rule <rule>_rate (shrunk); host_rejected, where one of the rates reaches the limit. One row of sums reaches the driver."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(F.col(f"{r}_failed").cast("long")).alias(r) for r in RULES])
    n = F.col("n_docs").cast("double")
    t = hosts.agg(F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(n * n).alias("nn"), *[x for r in RULES for x in (F.sum(r).alias(f"{r}_f"), F.sum(F.col(r) * F.col(r) / n).alias(f"{r}_s"))]).first()
    rates = {}
    for r in RULES:
        mean, strength = prior(t["n"] or 0.0, t[f"{r}_f"] or 0, t["k"], t["nn"] or 0.0, t[f"{r}_s"] or 0.0)
        rates[f"{r}_rate"] = (F.col(r) + mean * strength) / (n + strength)
    return hosts.select("host", "n_docs", *[c.alias(k) for k, c in rates.items()]).withColumn("host_rejected", F.greatest(*rates) >= limit)


def host_rules(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The counts of each document with kept: false where the document fails the base rule or its host is rejected."""
    judged = materialize(counts(docs, host), "host-counts")
    rejected = host_verdicts(judged, limit).where("host_rejected").select(F.col("host").alias("_host"), F.lit(True).alias("_out"))
    out = judged.join(rejected, F.col("host").eqNullSafe(F.col("_host")), "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", *[f"{r}_failed" for r in RULES],
        (~F.col("base_failed") & F.col("_out").isNull()).alias("kept"),
    )


_SUMS = ", ".join(f"sum({r}_failed::int)::double as {r}" for r in RULES)
_MOMENTS = ", ".join(f"sum({r}) / sum(n) as {r}_m, sum({r} * {r} / n) / sum(n) as {r}_s" for r in RULES)
_STRENGTHS = ", ".join(f"""case when k > 1 and {r}_m > 0 and {r}_m < 1 and ({r}_s - {r}_m * {r}_m - {r}_m * (1 - {r}_m) * (k - 1) / n) / greatest(1 - nn / (n * n), 1e-9) > 1e-12
    then least(1e6, greatest(1e-3, {r}_m * (1 - {r}_m) / (({r}_s - {r}_m * {r}_m - {r}_m * (1 - {r}_m) * (k - 1) / n) / greatest(1 - nn / (n * n), 1e-9)) - 1)) else 1e6 end as {r}_w""" for r in RULES)  # fmt: skip
_OUT = " or ".join(f"(h.{r} + {r}_m * {r}_w) / (h.n + {r}_w) >= {HOST_LIMIT}" for r in RULES)
_FAILED = ", ".join(f"({test}) as {r}_failed" for r, test in RULES.items())
HOST_RULES_SQL = rf"""
with w as (
  select doc_id, source, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
g as (
  select *, list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2]) as tri from w),
p as (
  select doc_id, source, text, ws, ls, row_number() over () as r, tri from g),
t as (select r, unnest(tri) as x, generate_subscripts(tri, 1) as i from p where len(ws) > 2),
d as (select r, i from (select r, i, count(*) over (partition by r, x) as c from t) where c > 1),
c as (select r, count(distinct i + k) as n from d, (values (0), (1), (2)) v(k) group by r),
b as (
  select doc_id, source, len(ws)::bigint as n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols,
         len(ls)::bigint as n_lines,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(c.n, 0)::bigint as n_repeat_words
  from p left join c using (r)),
f as (select *, {_FAILED} from b),
h as (select source, count(*)::double as n, {_SUMS} from f group by source),
m as (select sum(n) as n, count(*) as k, sum(n * n) as nn, {_MOMENTS} from h),
s as (select *, {_STRENGTHS} from m),
o as (select source, {_OUT} as host_out from h, s)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, {", ".join(f"{r}_failed" for r in RULES)}, not base_failed and not host_out as kept
from f join o on f.source is not distinct from o.source
"""
