"""Secret scans in DataFrame operations only: fixed patterns, and two character Markov models compared by likelihood ratio.

Labelled samples, random strings and ordinary identifiers, are cut into pairs of neighbouring characters and counted by
Spark; the smoothed log ratio of the two models' transition probabilities is a table of fixed size (characters fall into
CLASSES), in thousandths so that sums are exact. A candidate is a run of 16 or more letters, digits and +/_- with a digit and
a letter; it is reported as `markov` where its mean log ratio reaches LIMIT, unless it overlaps a span of the fixed patterns.

Positions are code points: what lies between matches is split off by the same pattern, and lengths add up. The columns
depend on one row only, so nothing is shuffled.

Defined cases: null text counts as empty; an empty text has no span and the digest of the empty string; repeated rows and
null ids are kept as they are; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import back, free_names, pick

# The three kinds of the contract. Only assign can fail after it has matched, so only it is checked later:
# a run of hex digits or of an access key that is too short holds no longer one.
_WORDS = "password passwd secret token api_?key".split()
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
ASSIGN = rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "markov")

#: Characters of candidates; each is its own class. 0 is the start.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CLASSES = len(ALPHABET) + 1
LIMIT = 300  # thousandths of a natural logarithm for each character

_PARTS = (
    "get set add load save read write parse build make find list next last first user name file path line text data item key value index count size "
    "time date start stop state status config option param handler manager service client server request response session token stream buffer cache "
    "queue table column row page view model field type class method test error event message number version update delete create insert select filter "
    "sort group join merge split format string integer double float array object list map node tree graph edge point image video audio report summary"
).split()


def samples(n: int = 3000) -> list[tuple[str, int]]:
    """(string, label): random strings (1) in hex, base64 and base36 letters, and ordinary identifiers (0), made by rule."""
    out = []
    for k in range(n):
        raw = hashlib.sha512(f"sample {k}".encode()).digest()
        size = 20 + k % 24
        lower = "abcdefghijklmnopqrstuvwxyz0123456789"
        coded = (raw.hex(), base64.b64encode(raw).decode().rstrip("="), "".join(lower[x % 36] for x in raw))[k % 3]
        out.append((coded[:size], 1))
        a, b, c, d = (_PARTS[x % len(_PARTS)] for x in raw[:4])
        number = str(raw[5] % 100) if raw[4] % 2 else str(2000 + raw[5] % 30)
        joined = (f"{a}_{b}_{c}_{number}", f"{a}{b.title()}{c.title()}{number}", f"{a}-{b}-{c}-{number}", f"{a}/{b}/{c}{d}{number}", f"{a.upper()}_{b.upper()}_{number}", f"{a}{b}{c}{d}{number}")[raw[6] % 6]
        out.append((joined, 0))
    return out


def train(labelled: DataFrame) -> list[int]:
    """The table of log ratios, in thousandths, of CLASSES rows and columns, from (token, label) rows.

    Counts are made by Spark; at most 2 * CLASSES ** 2 rows of them reach the driver.
    """
    chars = F.split(F.col("token"), "")
    pairs = labelled.select("label", chars.alias("c")).select("label", F.posexplode(F.filter("c", lambda x: x != "")).alias("at", "y"), "c")
    pairs = pairs.select("label", F.when(F.col("at") == 0, "").otherwise(F.get(F.filter("c", lambda x: x != ""), F.col("at") - 1)).alias("x"), "y")
    return table({(r["label"], r["x"], r["y"]): r["n"] for r in pairs.groupBy("label", "x", "y").agg(F.count("*").alias("n")).collect()})


def table(found: dict[tuple[int, str, str], int], smooth: float = 0.5) -> list[int]:
    where = {"": 0} | {c: k + 1 for k, c in enumerate(ALPHABET)}
    n = [[[smooth] * CLASSES for _ in range(CLASSES)] for _ in range(2)]
    for (label, x, y), k in found.items():
        if x in where and y in where:
            n[label][where[x]][where[y]] += k
    sums = [[sum(row) for row in m] for m in n]
    return [round(1000 * math.log(n[1][i][j] / sums[1][i] / (n[0][i][j] / sums[0][i]))) for i in range(CLASSES) for j in range(CLASSES)]


def default_model(spark: SparkSession) -> list[int]:
    return train(spark.createDataFrame(samples(), "token string, label int"))


def let(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, start: Column, add) -> Column:
    """start and add(... add(start, v1) ..., vk) for each k: one element more than values has.

    A fold that appends copies what it has at each step. So values are folded in pieces of about the square root of their
    number, and the pieces' results are folded apart: n ** 1.5 copies at most.
    """
    kind = "array<int>"
    appended = lambda got, x: F.concat(got, F.array(add(F.element_at(got, -1), x)))

    def both(v: Column) -> Column:
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(v)))).cast("int")
        pieces = let(size, lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / c).cast("int")), lambda k: F.slice(v, k * c + 1, c)))
        whole = lambda p: F.aggregate(F.slice(p, 2, F.size(p)), F.element_at(p, 1), add)
        return let(pieces, lambda p: let(F.aggregate(F.transform(p, whole), F.array(start).cast(kind), appended), lambda heads: F.concat(
            F.array(start).cast(kind),
            F.flatten(F.transform(p, lambda piece, k: F.slice(F.aggregate(piece, F.array(F.get(heads, k)).cast(kind), appended), F.lit(2), F.size(piece)))),
        )))

    return let(values, lambda v: F.when(F.size(v) > 0, both(v)).otherwise(F.array(start).cast(kind)))


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<s, k, e, v>> of the pattern's matches: start, kind, end, text."""
    empty = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"))

    def made(z: Column) -> Column:
        # a match ends where the gaps and the matches so far end
        ends = running(F.transform(z, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["v"]), F.lit(0))), F.lit(0), lambda a, x: a + x)
        with_ends = F.arrays_zip(z.alias("z"), F.slice(ends, F.lit(2), F.size(z)).alias("e"))
        found = F.filter(with_ends, lambda x: x["z"]["v"].isNotNull())
        return F.transform(found, lambda x: F.struct((x["e"] - F.length(x["z"]["v"])).alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), x["z"]["v"].alias("v")))

    return F.when(text.rlike(pattern), let(zipped, made)).otherwise(empty)


def apart(runs: Column, base: Column) -> Column:
    """The runs that overlap no span of base. In order of base starts and run ends, the largest base end so far says it."""
    event = lambda x, at, turn: F.struct(at.alias("at"), F.lit(turn).alias("turn"), x.alias("x"))
    events = F.sort_array(F.concat(F.transform(runs, lambda x: event(x, x["e"], 0)), F.transform(base, lambda x: event(x, x["s"], 1))))

    def free(v: Column) -> Column:
        far = running(F.transform(v, lambda x: F.when(x["turn"] == 1, x["x"]["e"]).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
        both = F.arrays_zip(v.alias("v"), F.slice(far, F.lit(2), F.size(v)).alias("far"))
        return F.transform(F.filter(both, lambda x: (x["v"]["turn"] == 0) & (x["far"] <= x["v"]["x"]["s"])), lambda x: x["v"]["x"])

    return F.when((F.size(runs) > 0) & (F.size(base) > 0), let(events, free)).otherwise(runs)


def likelihood_ratio(token: Column, model: list[int]) -> Column:
    """The summed log ratio of a token's characters, in thousandths."""
    ratios = F.from_json(F.lit(json.dumps(model)), "array<int>")
    where = lambda c: F.instr(F.lit(ALPHABET), c)
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    codes = F.transform(chars, where)
    return F.aggregate(
        codes,
        F.struct(F.lit(0).alias("before"), F.lit(0).cast("long").alias("sum")),
        lambda a, c: F.struct(c.alias("before"), (a["sum"] + F.get(ratios, a["before"] * CLASSES + c)).alias("sum")),
    )["sum"]


def with_spans(docs: DataFrame, model: list[int], keep: list[str], limit: int = LIMIT) -> tuple[DataFrame, str, str]:
    """The columns keep of docs and two of (s, k, e, v), sorted by start and kind: the base spans and all. Then these two's names."""
    own = pick(docs, *dict.fromkeys([*keep, "text"]))
    t, assign, access, hexes, run, base, spans = free_names(own, "_t", "_assign", "_access", "_hex", "_run", "base", "spans")
    src = own.withColumn(t, F.coalesce(F.col("text"), F.lit("")))
    text = F.col(t)
    src = src.withColumns({assign: spans_of(text, ASSIGN, 0), access: spans_of(text, ACCESS, 1), hexes: spans_of(text, HEX, 2), run: spans_of(text, CANDIDATE, 3)})
    src = src.withColumn(assign, F.filter(assign, lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 2)) >= 6))
    src = src.withColumn(base, F.sort_array(F.concat(assign, access, hexes)))
    src = src.withColumn(run, F.filter(run, lambda x: x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]")))
    src = src.withColumn(run, apart(F.col(run), F.col(base)))
    markov = F.filter(run, lambda x: likelihood_ratio(x["v"], model) >= limit * F.length(x["v"]))
    src = src.withColumn(spans, F.sort_array(F.concat(base, F.when(F.size(run) > 0, markov).otherwise(F.col(run)))))
    return src.select(*back(keep), base, spans), base, spans


def listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secrets(docs: DataFrame, model: list[int] | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov: one row for each document."""
    found, base, spans = with_spans(docs, model or default_model(docs.sparkSession), ["doc_id"], limit)
    number = lambda c, k: F.size(F.filter(c, lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[number(base, k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(listed(F.col(base)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col(spans)).alias("spans"),
        number(spans, 3).alias("n_markov"),
    )


CUT = 4096


def without(text: Column, spans: Column, mark: str) -> Column:
    """text with each run of overlapping spans replaced by mark. Long texts are cut into blocks first, as a substring is found by counting from the front."""
    far = running(F.transform(spans, lambda x: x["e"]), F.lit(0), lambda a, x: F.greatest(a, x))
    ends = F.concat(F.transform(spans, lambda x: x["s"]), F.array(F.length(text)))
    gaps = F.filter(F.arrays_zip(far.alias("a"), ends.alias("b")), lambda g: g["b"] >= g["a"])

    def cut(blocks: Column) -> Column:
        part = lambda g, j: F.substr(F.get(blocks, j), F.greatest(g["a"] - j * CUT, F.lit(0)) + 1, F.least(g["b"] - j * CUT, F.lit(CUT)) - F.greatest(g["a"] - j * CUT, F.lit(0)))
        of = lambda g: F.array_join(F.transform(F.sequence(F.floor(g["a"] / CUT).cast("int"), F.floor((g["b"] - 1) / CUT).cast("int")), lambda j: part(g, j)), "")
        return F.transform(gaps, lambda g: F.when(g["b"] > g["a"], of(g)).otherwise(""))

    return F.array_join(let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), cut), mark)


def redact(docs: DataFrame, model: list[int] | None = None, mark: str = "[SECRET]", limit: int = LIMIT) -> DataFrame:
    """docs with every span, overlapping ones together, replaced by mark; n_chars, if there, follows. Null texts stay null."""
    names = docs.columns
    found, _, spans = with_spans(docs, model or default_model(docs.sparkSession), names, limit)
    hit = F.size(spans) > 0
    out = found.withColumn("text", F.when(hit, without(F.col("text"), F.col(spans), mark)).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*back(names))


def secrets_sql() -> str:
    """The same for DuckDB: patterns by its own regular expressions, the models trained here in plain Python."""
    found = Counter()
    for token, label in samples():
        for x, y in zip(["", *token], token, strict=False):
            found[label, x, y] += 1
    ratios = table(found)

    def spans(pattern: str, kind: int, extra: str = "true") -> str:
        return f"""(select r, {kind} as k, s, s + length(v) as e, v from (
            select r, v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint as s
            from (select r, m, g, unnest(m) as v, generate_subscripts(m, 1) as i from (
                select r, regexp_extract_all(t, '{pattern}', 0) as m, string_split_regex(t, '{pattern}') as g from d) where len(m) > 0)) where {extra})"""

    q = ASSIGN.replace("'", "''")
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
base as (select * from {spans(q, 0, f"length(regexp_extract(v, '{q}', 2)) >= 6")} union all select * from {spans(ACCESS, 1)} union all select * from {spans(HEX, 2)}),
ratios as (select {ratios} as w),
runs as (select * from {spans(CANDIDATE, 3, "regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')")} c where not exists (select 1 from base b where b.r = c.r and b.s < c.e and c.s < b.e)),
markov as (select r, k, s, e, v from (select runs.*, list_sum(list_transform(range(1, length(v) + 1), lambda i:
      w[(case when i = 1 then 0 else instr('{ALPHABET}', substring(v, i - 1, 1)) end) * {CLASSES} + instr('{ALPHABET}', substring(v, i, 1)) + 1])) as total from runs, ratios) where total >= {LIMIT} * length(v)),
named as (select *, ['assign', 'access', 'hex', 'markov'][k + 1] || ':' || s || ':' || e as x from (select * from base union all select * from markov)),
grouped as (select r, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, count(*) filter (k = 3) as n_markov,
      string_agg(x, ',' order by s, k) filter (k < 3) as base, string_agg(x, ',' order by s, k) as spans from named group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_markov, 0)::bigint as n_markov
from d left join grouped using (r)
"""
