"""URL verdicts: host and path rules first, then logistic regression on hashed character n-grams. DataFrame functions only.

The model is trained from a small labelled URL table (at most MAX_LABELLED rows, checked). Full-batch gradient descent
runs in the span of the training rows: with kernel K[i][j] = shared n-grams + 1, the weights stay w = sum a[i] x[i], and
one higher-order expression over one row iterates a. The resulting bucket weights are at most BUCKETS numbers; they go
to the scoring plan as one literal, so scoring is a projection without join or shuffle.

Null urls and urls without '://' have empty host and path, fit no rule and get the verdict of the bias alone. Very long urls
are judged whole. Of rules of equal length that both fit, which is possible only for a rule given twice, the later one
wins. Repeated rows and rows with a null id are judged each; an empty table gives an empty result; an empty labelled table
allows everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.labelled_urls import LABELLED

MAX_LABELLED = 500
GRAM = 3
#: Buckets are the first three hex digits of the n-gram's MD5.
BUCKETS = 4096
EPOCHS = 60
RATE = 0.05
SHRINK = 0.001
#: A url is blocked above this logit (a probability of 0.7); no other limit makes fewer errors on HELD_OUT.
LIMIT = 0.847

Rule = tuple[str, str]

#: (rule, verdict): the rules of the contract.
RULES: list[Rule] = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the last that fits wins
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(text: Column, mark: str) -> Column:
    """Marked n-grams of the text between '^' and '$'."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(framed) - GRAM + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.concat(F.lit(mark), framed.substr(i, F.lit(GRAM))))


def buckets(host: Column, path: Column) -> Column:
    """Distinct hashed n-grams of host and path as bucket numbers."""
    grams = F.array_distinct(F.concat(_grams(host, "h"), _grams(path, "p")))
    return F.array_distinct(F.transform(grams, lambda g: F.conv(F.left(F.md5(g.cast("binary")), F.lit(3)), 16, 10).cast("int")))


def labelled_table(spark: SparkSession, rows: Sequence[tuple[str, int]] = LABELLED) -> DataFrame:
    """The labelled URLs as a table of literals."""
    if not rows:
        return spark.sql("SELECT CAST(NULL AS STRING) AS url, 0 AS label WHERE false")
    quoted = (u.replace("\\", "\\\\").replace("'", "\\'") for u, _ in rows)
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {y})" for u, (_, y) in zip(quoted, rows, strict=True)) + " AS t(url, label)")


def train(labelled: DataFrame) -> tuple[float, list[float]]:
    """Bias and bucket weights. Raises where the table exceeds MAX_LABELLED rows, the bound on what is gathered."""
    rows = labelled.select(F.col("url"), F.col("label").cast("double").alias("y")).filter("url is not null and y is not null").limit(MAX_LABELLED + 1)
    host, path = host_path(F.col("url"))
    one = rows.select("url", "y", buckets(host, path).alias("x")).agg(F.array_sort(F.collect_list(F.struct("url", "y", "x"))).alias("t"))
    one = one.select("t", F.transform("t", lambda i: F.transform(F.col("t"), lambda j: F.size(F.array_intersect(i["x"], j["x"])) + F.lit(1.0))).alias("k"))

    def step(a: Column, _: Column) -> Column:
        def moved(row: Column, i: Column) -> Column:
            f = F.aggregate(F.zip_with(row, a, lambda k, x: k * x), F.lit(0.0), lambda s, v: s + v)
            return F.get(a, i) * (1 - RATE * SHRINK) + (F.get(F.col("t"), i)["y"] - 1 / (1 + F.exp(-f))) * RATE

        return F.transform("k", moved)

    start = F.transform("t", lambda _: F.lit(0.0))
    fitted = one.select("t", F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), start, step).alias("a"))
    points = fitted.select(F.size("t").alias("n"), F.explode(F.zip_with("t", "a", lambda t, a: F.struct(a.alias("a"), t["x"].alias("x")))).alias("p"))
    terms = points.select("n", F.col("p.a").alias("a"), F.explode(F.concat(F.col("p.x"), F.array(F.lit(-1)))).alias("b"))
    found = terms.groupBy("b").agg(F.sum("a").alias("w"), F.max("n").alias("n")).collect()  # at most BUCKETS + 1 rows
    if found and found[0]["n"] > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    weights = [0.0] * BUCKETS
    bias = 0.0
    for row in found:
        if row["b"] < 0:
            bias = row["w"]
        else:
            weights[row["b"]] = row["w"]
    return bias, weights


def logit_of(host: Column, path: Column, bias: float, weights: Sequence[float]) -> Column:
    """The model's logit."""
    table = F.array(*[F.lit(w) for w in weights]) if any(weights) else F.array(F.lit(0.0))
    return F.aggregate(buckets(host, path), F.lit(bias), lambda s, b: s + F.coalesce(F.get(table, b), F.lit(0.0)))


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row: the rule's verdict, else block where the model's logit is above LIMIT."""
    bias, weights = train(labelled)
    host, path = host_path(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    parts = base.select("page_id", host.alias("host"), path.alias("path"))
    logit = logit_of(F.col("host"), F.col("path"), bias, weights)
    hit = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(logit > LIMIT, F.lit("block")).otherwise(F.lit("allow"))
    return parts.select("page_id", "host", "path", hit["rule"].alias("rule"), F.when(hit.isNotNull(), hit["verdict"]).otherwise(own).alias("verdict"))


def oracle(rules: Sequence[Rule] = RULES, rows: Sequence[tuple[str, int]] = LABELLED) -> str:
    """The same in DuckDB SQL, training included."""

    def parts(url: str) -> str:
        rest = f"coalesce(CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) END, '')"
        return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"

    def grams(col: str, mark: str) -> str:
        return f"list_transform(range(1, 1 + greatest(length('^' || {col} || '$') - {GRAM - 1}, 1)), lambda i: '{mark}' || substr('^' || {col} || '$', i, {GRAM}))"

    x = f"list_distinct(list_transform(list_concat({grams('host', 'h')}, {grams('path', 'p')}), lambda g: CAST('0x' || substr(md5(g), 1, 3) AS INT)))"
    fit = " ".join(
        f"WHEN (host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '{s + p}') THEN {{'rule': '{r}', 'verdict': '{v}'}}"
        for r, v in sorted(rules, key=lambda r: -len(r[0]))
        for n, s, p in [r.partition("/")]
    )
    values = ", ".join("('" + u.replace("'", "''") + f"', {y})" for u, y in rows)
    f = "list_sum(list_transform(list_zip(k[i], a), lambda z: z[1] * z[2]))"
    step = f"list_transform(range(1, len(k) + 1), lambda i: a[i] * {1 - RATE * SHRINK!r} + (t[i].y - 1 / (1 + exp(-({f})))) * {RATE!r})"
    return f"""
      WITH RECURSIVE l AS (SELECT url, CAST(y AS DOUBLE) AS y, {parts('url')} FROM (VALUES {values}) v(url, y)),
      lx AS (SELECT list({{'url': url, 'y': y, 'x': {x}}} ORDER BY url) AS t FROM l),
      kk AS (SELECT t, list_transform(t, lambda p: list_transform(t, lambda q: len(list_intersect(p.x, q.x)) + 1.0::DOUBLE)) AS k FROM lx),
      fit(n, t, k, a) AS (
        SELECT 0, t, k, list_transform(t, lambda p: 0.0::DOUBLE) FROM kk
        UNION ALL SELECT n + 1, t, k, {step} FROM fit WHERE n < {EPOCHS}),
      point AS (SELECT unnest(list_zip(t, a)) AS z FROM fit WHERE n = {EPOCHS}),
      w AS (SELECT b, sum(z[2]) AS w FROM (SELECT z, unnest(list_concat(z[1].x, [-1])) AS b FROM point) GROUP BY b),
      p AS (SELECT page_id, rid, host, path, CASE {fit} END AS hit, {x} AS x FROM (SELECT page_id, row_number() OVER () AS rid, {parts('url')} FROM pages)),
      s AS (SELECT rid, sum(w) AS z FROM (SELECT rid, unnest(list_concat(x, [-1])) AS b FROM p) g JOIN w USING (b) GROUP BY rid)
      SELECT page_id, host, path, hit.rule AS rule, CASE WHEN hit IS NOT NULL THEN hit.verdict WHEN s.z > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
      FROM p LEFT JOIN s USING (rid)"""
