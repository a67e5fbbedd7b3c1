"""URL filters: a host list decides what it covers, association rules mined from labelled URLs decide the rest.

A URL gives one token for each of its places (scheme, labels of the host from the right, first folder, rest of the path, names
of parameters, fragment), with runs of digits written as #. Nothing of a URL is left out, and no URL has more than PLACES tokens,
so it is in at most 2 ** PLACES - 1 combinations. Spark's FP-growth counts the combinations of tokens and verdict over all labelled URLs;
equal URLs count once. Those with enough support and confidence, and more of their verdict than URLs have in general, are rules. Their
number is at most (2 ** PLACES - 1) / min_support whatever the table holds, which bounds what is sent to the executors.

Rules are ranked by confidence, then support, then fewer tokens, then text. The inverted index posts each rule under its rarest token;
a URL looks its tokens up, checks the rules posted there, and takes the first in rank. Without one it is allowed.

Labelled are the pages that the host list covers, with its verdict, and of the others those that have a label. What the list alone would teach
is too wide, as it names only some hosts (all it says of a top domain may be what to block there); labels of other pages correct that.

Defined cases: a null url, or one without ://, has an empty host and path, no tokens, and is allowed; a rule with a path fits no url with
an empty path; long urls are taken whole; repeated pages are judged row by row; no labelled URL, or an empty table, gives no mined rules;
further columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Pieces, free_names, materialize, pick, with_columns

#: (verdict, host, path)
HOST_LIST = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
VERDICTS = ("allow", "block")
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.9
PLACES = 9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
CACHE = 100_000  # verdicts of token sets that a task remembers


def part(url: Column, k: int) -> Column:
    """1: scheme, 2: host, 3: path, 4: query, 5: fragment; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(part(url, 2), UPPER, LOWER)


def by_list(host: Column, path: Column, rules=HOST_LIST) -> tuple[Column, Column]:
    """The longest rule of the host list that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """At most PLACES distinct tokens, in the order of their text; empty for what is no url."""
    labels = F.reverse(F.split(host_of(url), r"\."))
    folders = F.filter(F.split(part(url, 3), "/"), lambda s: s != "")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(part(url, 4), "&"), lambda s: F.substring_index(s, "=", 1)))), "&")
    rest = lambda a, n, sep: F.array_join(F.slice(a, n, F.greatest(F.size(a), F.lit(1))), sep)
    places = {
        "scheme": part(url, 1), "top": F.get(labels, F.lit(0)), "name": F.get(labels, F.lit(1)), "site": F.get(labels, F.lit(2)), "sub": rest(labels, 4, "."),
        "folder": F.get(folders, F.lit(0)), "page": rest(folders, 2, "/"), "names": names, "fragment": part(url, 5),
    }
    tagged = [F.concat(F.lit(f"{k}:"), F.regexp_replace(F.when(v != "", v), "[0-9]+", "#")) for k, v in places.items()]
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), F.array_sort(F.array_compact(F.array(*tagged)))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from labelled (url, verdict): tokens, verdict, n (URLs with both), n_tokens (URLs with the tokens), confidence.

    Each different URL counts once for each verdict it has.
    """
    spark = labelled.sparkSession
    urls = labelled.where(F.col("verdict").isin(*VERDICTS)).select("url", "verdict").distinct()
    items = materialize(urls.select(F.concat(tokens_of(F.col("url")), F.array(F.concat(F.lit("="), "verdict"))).alias("items")), "url-items")
    if items.isEmpty():
        return spark.createDataFrame([], "tokens array<string>, verdict string, n long, n_tokens long, confidence double")
    counts = {f"={r[0]}": r[1] for r in urls.groupBy("verdict").count().collect()}
    whole = sum(counts.values())
    sets = FPGrowth(itemsCol="items", minSupport=min_support).fit(items).freqItemsets
    sets = materialize(sets.select(F.array_sort("items").alias("items"), "freq"), "url-sets")
    is_verdict = lambda x: x.startswith("=")
    with_verdict = sets.where(F.exists("items", is_verdict) & (F.size("items") == F.size(F.filter("items", lambda x: ~is_verdict(x))) + 1) & (F.size("items") > 1))
    both = with_verdict.select(F.filter("items", lambda x: ~is_verdict(x)).alias("tokens"), F.element_at(F.filter("items", is_verdict), 1).alias("said"), F.col("freq").alias("n"))
    alone = sets.where(~F.exists("items", is_verdict)).select(F.col("items").alias("tokens"), F.col("freq").alias("n_tokens"))
    share = F.element_at(F.create_map(*[F.lit(x) for c in counts.items() for x in c]), F.col("said"))
    rules = both.join(alone, "tokens").withColumn("confidence", F.col("n") / F.col("n_tokens"))
    rules = rules.where((F.col("confidence") >= min_confidence) & (F.col("n") * whole > F.col("n_tokens") * share))
    return rules.select("tokens", F.substring("said", 2, 99).alias("verdict"), "n", "n_tokens", "confidence")


class Index:
    """Ranked rules, posted under their rarest token."""

    def __init__(self, rules: list[tuple[list[str], str, int, int]]):
        """rules: tokens, verdict, n, n_tokens."""
        ranked = sorted(((tuple(t), v, n, m) for t, v, n, m in rules), key=lambda r: (-r[2] / r[3], -r[2], len(r[0]), r[0], r[1]))
        kept: dict[tuple[str, ...], set[str]] = {}
        self.rules, self.posts, seen = [], {}, {}
        for tokens, verdict, n, m in ranked:
            # a rule never gets its turn where one with fewer of its tokens comes first
            if not any(part in kept for size in range(1, len(tokens) + 1) for part in combinations(tokens, size)):
                kept[tokens] = {verdict}
                self.rules.append((frozenset(tokens), verdict))
        for tokens, _ in self.rules:
            for t in tokens:
                seen[t] = seen.get(t, 0) + 1
        for rank, (tokens, _) in enumerate(self.rules):
            self.posts.setdefault(min(tokens, key=lambda t: (seen[t], t)), []).append(rank)

    def first(self, tokens: frozenset[str]) -> str | None:
        """The verdict of the first rule in rank whose tokens are all there."""
        ranks = [r for t in tokens for r in self.posts.get(t, ()) if self.rules[r][0] <= tokens]
        return self.rules[min(ranks)][1] if ranks else None


def index_of(rules: DataFrame, min_support: float = MIN_SUPPORT) -> Index:
    """The rules on the driver, of which there are at most (2 ** PLACES - 1) / min_support for each verdict."""
    found = [(r["tokens"], r["verdict"], r["n"], r["n_tokens"]) for r in rules.collect()]
    assert len(found) <= len(VERDICTS) * (2**PLACES - 1) / min_support
    return Index(found)


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=HOST_LIST, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule (of the host list, or null), verdict for each row of pages (page_id, url).

    labels: page_id, verdict (allow or block) of some pages; heeded for pages that the host list doesn't cover.
    """
    urls = pick(pages, "page_id", "url")
    host, path = host_of(F.col("url")), part(F.col("url"), 3)
    name, said = by_list(host, path, rules)
    seen = urls.select("page_id", "url", host.alias("host"), path.alias("path"), name.alias("rule"), said.alias("said"))
    labelled = seen.where("said IS NOT NULL").select("url", F.col("said").alias("verdict"))
    if labels is not None:
        labelled = labelled.union(seen.where("said IS NULL").join(pick(labels, "page_id", "verdict"), "page_id").select("url", "verdict"))
    index = index_of(mine(labelled, min_support, min_confidence), min_support)
    (tokens,) = free_names(seen, "tokens")
    open_ones = seen.withColumn(tokens, F.when(F.col("said").isNull(), tokens_of(F.col("url"))))

    def mined(rows: list[list[str] | None]):
        found = Pieces(lambda own: index.first(own) or "allow", CACHE)
        return [[None if row is None else found[frozenset(row)] for row in rows]]

    out = with_columns(open_ones, ["page_id", "host", "path", "rule", "said"], tokens, "mined string", mined, rows=4096)
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "mined").alias("verdict"))


def page_labels(labels: DataFrame) -> DataFrame:
    """page_id, verdict from doc_id, quality: a page is to be blocked where the document of its id is bad."""
    said = F.when(F.col("quality") == 0, "block").when(F.col("quality") == 1, "allow")
    return pick(labels, "doc_id", "quality").select(F.col("doc_id").alias("page_id"), said.alias("verdict"))


def _part_sql(k: int) -> str:
    return f"regexp_extract(url, '{PARTS}', {k})"


def judge_sql(rules=HOST_LIST, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> str:
    """The same by counting every subset of every labelled URL's tokens."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda k: " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, said)[k]}'" for said, h, p in ordered)
    tag = lambda k, v: f"'{k}:' || regexp_replace(nullif({v}, ''), '[0-9]+', '#', 'g')"
    folders = "list_filter(string_split(path, '/'), lambda s: s <> '')"
    names = f"array_to_string(list_sort(list_distinct(list_transform(string_split({_part_sql(4)}, '&'), lambda s: string_split(s, '=')[1]))), '&')"
    tokens = ", ".join([
        tag("scheme", _part_sql(1)), tag("top", "labels[1]"), tag("name", "labels[2]"), tag("site", "labels[3]"), tag("sub", "array_to_string(labels[4:], '.')"),
        tag("folder", f"({folders})[1]"), tag("page", f"array_to_string(({folders})[2:], '/')"), tag("names", names), tag("fragment", _part_sql(5)),
    ])
    return f"""
WITH parts AS (SELECT page_id, url, coalesce(translate({_part_sql(2)}, '{UPPER}', '{LOWER}'), '') AS host, coalesce({_part_sql(3)}, '') AS path FROM pages),
seen AS (SELECT *, list_reverse(string_split(host, '.')) AS labels, CASE {case(0)} END AS rule, CASE {case(1)} END AS said FROM parts),
tokened AS (SELECT page_id, url, host, path, rule, said, CASE WHEN contains(url, '://') THEN list_sort(list_filter([{tokens}], lambda t: t IS NOT NULL)) ELSE [] END AS tokens FROM seen),
labelled AS (
  SELECT url, said, tokens FROM tokened WHERE said IS NOT NULL
  UNION SELECT url, CASE quality WHEN 0 THEN 'block' ELSE 'allow' END, tokens FROM tokened JOIN labels ON doc_id = page_id WHERE said IS NULL AND quality IN (0, 1)),
whole AS (SELECT count(*) AS n FROM labelled),
shares AS (SELECT said, count(*) AS n FROM labelled GROUP BY said),
subsets AS (
  SELECT said, list_filter(tokens, lambda t, i: (mask >> (i - 1)) & 1 = 1) AS part
  FROM (SELECT said, tokens, unnest(generate_series(1, (1 << len(tokens)) - 1)) AS mask FROM labelled)),
counted AS (SELECT part, said, count(*) AS n, sum(count(*)) OVER (PARTITION BY part) AS m FROM subsets GROUP BY part, said),
rules AS (
  SELECT part, c.said AS verdict, c.n, c.n / m AS confidence FROM counted c JOIN shares s ON s.said = c.said, whole w
  WHERE c.n >= ceil({min_support} * w.n) AND c.n / m >= {min_confidence} AND c.n * w.n > m * s.n),
judged AS (
  SELECT t.page_id, t.url, arg_min(verdict, (-confidence, -n, len(part), part, verdict)) AS mined
  FROM (SELECT DISTINCT page_id, url, tokens FROM tokened WHERE said IS NULL) t JOIN rules ON len(list_intersect(t.tokens, part)) = len(part) GROUP BY t.page_id, t.url)
SELECT t.page_id, t.host, t.path, t.rule, coalesce(t.said, mined, 'allow') AS verdict
FROM tokened t LEFT JOIN judged j ON j.page_id = t.page_id AND j.url = t.url
"""


def readable(rules: DataFrame) -> DataFrame:
    """rule ("a & b => verdict"), n, n_tokens, confidence, for people to look through."""
    text = F.concat(F.array_join("tokens", " & "), F.lit(" => "), F.col("verdict"))
    return rules.select(text.alias("rule"), "n", "n_tokens", "confidence")


def tokens_plain(url: str | None) -> list[str]:
    """tokens_of for one url without Spark, for tests and look-ups of single urls."""
    found = re.match(PARTS, url or "")
    if not found:
        return []
    scheme, host, path, query, fragment = (g or "" for g in found.groups())
    labels, folders = host.translate(str.maketrans(UPPER, LOWER)).split(".")[::-1], [s for s in path.split("/") if s]
    names = "&".join(sorted({s.split("=")[0] for s in query.split("&")}))
    at = lambda a, k: a[k] if len(a) > k else ""
    places = {"scheme": scheme, "top": at(labels, 0), "name": at(labels, 1), "site": at(labels, 2), "sub": ".".join(labels[3:]), "folder": at(folders, 0), "page": "/".join(folders[1:]), "names": names, "fragment": fragment}
    return sorted(f"{k}:{re.sub('[0-9]+', '#', v)}" for k, v in places.items() if v)
