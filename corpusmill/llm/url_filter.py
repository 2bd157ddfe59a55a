"""URL filter: rule lists first, then logistic regression on hashed character 4-grams.

The model is trained on the driver from a small labelled URL table (at most ``LABELLED`` rows,
an error beyond).  Weights are whole numbers, so sums do not depend on their order.  Everything on
the main path is column expressions; scoring is one pass without a shuffle.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased;
path: what follows up to ``?``, ``#`` or the end.  A rule fits its host and all subdomains if the
path starts with the rule's path; the longest rule wins.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is
judged by the model like any other; repeated rows each stand; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (list, rule) pairs; fixed values of the filter's contract.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
BUCKETS = 4096
LABELLED = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SPAM_NAMES = ["cheap-pills", "spam-farm", "casino-bonus", "free-money", "win-prizes", "pills-online", "best-casino", "loan-now", "replica-watches", "hot-deals", "click-farm", "buy-followers", "seo-spam", "lucky-slots", "cheap-meds", "crypto-giveaway", "ads-track", "adult-x", "free-bets", "casino-win"]
PLAIN_NAMES = ["garden", "library", "history", "weather", "theatre", "therapy", "kitchen", "station", "thermal", "museum", "tionary", "anthem", "northern", "bicycle", "letters", "research", "thread", "printing", "harbour", "science"]


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: 1 is a URL to block."""
    rows = []
    for label, names in ((1, SPAM_NAMES), (0, PLAIN_NAMES)):
        for i, name in enumerate(names):
            for j, (lead, top) in enumerate([("", "com"), ("www.", "org"), ("blog.", "net"), ("m.", "com")]):
                path = ["/en/12", "/de/345/", "/fr/67.html", "/es/8901"][(i + j) % 4]
                rows.append((f"https://{lead}{name}.example.{top}{path}", label))
    return rows


def grams(text: str) -> list[int]:
    """Buckets of the character 4-grams of ``text``."""
    c = [ord(x) for x in text]
    return [(c[i] * 29791 + c[i + 1] * 961 + c[i + 2] * 31 + c[i + 3]) % BUCKETS for i in range(len(c) - 3)]


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(x) for x in "/?#" if x in rest), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((tail.find(x) for x in "?#" if x in tail), default=len(tail))
    return host.translate(str.maketrans(UPPER, LOWER)), tail[:stop]


def train(rows: list[tuple[str | None, int]], *, rounds: int = 200, rate: float = 0.5, penalty: float = 0.002) -> tuple[list[int], int]:
    """Weights by bucket and bias, times 10,000 and rounded, by gradient descent."""
    own = [(grams(f"^{h}{p}$"), y) for (h, p), y in ((split_url(u), y) for u, y in rows)]
    w, bias, n = [0.0] * BUCKETS, 0.0, max(1, len(own))
    for _ in range(rounds):
        slope, b = {}, 0.0
        for fs, y in own:
            s = bias + sum(w[f] for f in fs)
            d = 1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) - y
            b += d
            for f in fs:
                slope[f] = slope.get(f, 0.0) + d
        for f, d in slope.items():
            w[f] -= rate * (d / n + penalty * w[f])
        bias -= rate * b / n
    return [round(10_000 * x) for x in w], round(10_000 * bias)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its list, null where none fits."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{tail}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def score_of(host: Column, path: Column, weights: list[int], bias: int) -> Column:
    """The model's whole-number score; above zero means block.  One walk over the characters, however many they are."""
    codes = F.transform(F.split(F.concat(F.lit("^"), host, path, F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))
    table = F.from_json(F.lit(str(weights)), "array<int>")
    state = lambda a, b, c, s: F.struct(a.alias("a"), b.alias("b"), c.alias("c"), s.alias("s"))
    none = F.lit(-1).cast("long")

    def step(at: Column, code: Column) -> Column:
        bucket = F.pmod(at["a"] * 29791 + at["b"] * 961 + at["c"] * 31 + code, F.lit(BUCKETS))
        weight = F.when(at["a"] >= 0, F.element_at(table, (bucket + 1).cast("int"))).otherwise(0)
        return state(at["b"], at["c"], code, at["s"] + weight)

    return F.aggregate(codes, state(none, none, none, F.lit(bias).cast("long")), step, lambda at: at["s"])


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every row of ``pages``."""
    rows = labelled.select("url", "label").where("label is not null").limit(LABELLED + 1).collect()
    if len(rows) > LABELLED:
        raise ValueError(f"the labelled table has more than {LABELLED} rows")
    weights, bias = train(sorted(((r[0], int(r[1])) for r in rows), key=lambda r: (r[0] is not None, r)))
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    score = score_of(F.col("host"), F.col("path"), weights, bias)
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"))


def oracle() -> str:
    """The same in DuckDB SQL for the built-in labelled table and rules."""
    weights, bias = train(sorted(labelled_urls(), key=lambda r: (r[0] is not None, r)))
    cases = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = {t: f"(host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}')" for _, t in cases}
    rule = "CASE " + " ".join(f"WHEN {fits[t]} THEN '{t}'" for _, t in cases) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits[t]} THEN '{k}'" for k, t in cases) + " WHEN score > 0 THEN 'block' ELSE 'allow' END"
    return f"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
texts AS (SELECT *, '^' || host || path || '$' AS t FROM parts),
weights AS (SELECT {weights} AS w),
scored AS (
  SELECT page_id, host, path,
         CAST({bias} + coalesce(list_sum(list_transform(range(1, greatest(1, length(t) - 2)), lambda i:
           w[CAST((unicode(substr(t, i, 1))::BIGINT * 29791 + unicode(substr(t, i + 1, 1)) * 961 + unicode(substr(t, i + 2, 1)) * 31 + unicode(substr(t, i + 3, 1))) % {BUCKETS} AS INTEGER) + 1])), 0) AS BIGINT) AS score
  FROM texts, weights)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, score FROM scored"""
