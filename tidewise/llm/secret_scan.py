"""Operator 10: secret scan with a battery of randomness tests, with DataFrame functions only.

Three kinds of spans come from patterns (assign, access, hex). A fourth, `random`, comes from tokens of 16 or more
characters with a letter. Each token's encoding is inferred (hex, base32, letters, letters and digits, base64, base64 for URLs, in
one or both cases) and three tests ask whether its symbols look drawn at random from that alphabet:

* chi-squared against equal frequencies, as a normal deviate by the Wilson-Hilferty cube root,
* runs above and below the middle of the alphabet, R - 1 ~ Binomial(n - 1, 1/2),
* serial correlation of neighbouring symbols, about N(0, 1 / (n - 1)).

The sum of squares (of chi-squared only an excess counts) is referred to chi-squared with 3 degrees of freedom; a token whose p is
below `missed` is not random, so about that share of true secrets is missed.

Not being rejected proves little of a short token. Therefore a token has to reject the opposite as well, that it is
ordinary text: its number of equal pairs of symbols (the chi-squared statistic under the frequencies of text), its runs of
words and digits (capitals after small letters, digits next to letters), and for hex the chance to use these sixteen symbols only, as one normal deviate. The
error that is controlled is the share of ordinary tokens among the findings: Benjamini-Hochberg at level `alpha`
over all tokens of the corpus in a class of length. The procedure works on a histogram of p-values, whose size does not depend on
the input. So the verdict on a token depends on the other tokens of the table as well.

Spans are code points of the text, end exclusive. All spans of a text follow from the text and the corpus, so texts are told apart by 128
bits of their md5 and positions are summed up once for each. Null texts count as empty; repeated rows come out as often as they
came in; other columns are not read (`redact_secrets` keeps all of them, whatever their names).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.llm.shared import materialise, text_id

KINDS = ["assign", "access", "hex", "random"]
#: Matches of a kind, without those that are too short.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A longest run from the first AKIA, so a short match never hides a long one; the same holds for hex.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
LEAST_ASSIGNED = 6
#: What an assignment begins with, in lower case.
NAMES = ["password", "passwd", "secret", "token", "apikey", "api_key"]

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from narrow to wide: a pattern of the whole token without padding, and the alphabet in order.
ENCODINGS = [
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[a-z]+$", _LOWER),
    ("^[A-Z]+$", _UPPER),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[a-z0-9]+$", _LOWER + _DIGITS),
    ("^[A-Z0-9]+$", _UPPER + _DIGITS),
    ("^[A-Za-z]+$", _UPPER + _LOWER),
    ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    ("", _UPPER + _LOWER + _DIGITS + "+/-_"),
]
#: The histogram of p-values: bins of -ln(p) of this width, and the last one.
BIN, LAST_BIN = 0.05, 2000
#: Ordinary text: the sums of squares and cubes of its letters' shares, the share of places where a
#: capital follows a small letter or digits meet letters, and the
#: share of its letters and digits that are hexadecimal ones.
REPEATS, CUBES, CHANGES, HEX_SHARE = 0.06, 0.005, 0.2, 0.4


def _upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z) by Abramowitz and Stegun 26.2.17, with a floor that keeps its logarithm finite."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    coefficients = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    series = reduce(lambda s, c: (s + c) * t, reversed(coefficients), F.lit(0.0))
    tail = F.exp(-a * a / 2) / 2.5066282746310002 * series
    return F.greatest(F.lit(1e-40), F.when(z >= 0, tail).otherwise(1 - tail))


def _cube_root(x2: Column, df: Column | float) -> Column:
    """Chi-squared as a normal deviate."""
    df = df if isinstance(df, Column) else F.lit(float(df))
    v = 2 / (9 * df)
    return (F.cbrt(x2 / df) - (1 - v)) / F.sqrt(v)


def _squares(text: Column) -> Column:
    """The sum over a text's symbols of their squared numbers."""
    n = F.length(text)
    return F.aggregate(F.transform(F.array_distinct(F.split(text, "")), lambda a: F.pow((n - F.length(F.replace(text, a, F.lit("")))).cast("double"), F.lit(2.0))), F.lit(0.0), lambda x, y: x + y)


def ordinary(tokens: DataFrame, token: str) -> DataFrame:
    """tokens with p_text: how probable a token as varied as this one is if it is ordinary text (+, /, -, _ and = don't count); null where there is no token."""
    out = tokens.withColumn("_plain", F.regexp_replace(F.col(token), "[^A-Za-z0-9]+", ""))
    n = F.length("_plain").cast("double")
    pairs = n * (n - 1) / 2
    spread = pairs * REPEATS * (1 - REPEATS) + n * (n - 1) * (n - 2) * (CUBES - REPEATS * REPEATS)
    few_pairs = (pairs * REPEATS - (_squares(F.col("_plain")) - n) / 2) / F.sqrt(spread)
    changes = F.regexp_count("_plain", F.lit("[a-z](?=[A-Z])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))
    many_changes = (changes - (n - 1) * CHANGES) / F.sqrt((n - 1) * CHANGES * (1 - CHANGES))
    is_hex = F.col("_plain").rlike("^([0-9a-f]+|[0-9A-F]+)$")
    only_hex = F.sqrt(-2 * n * math.log(HEX_SHARE)) - 1  # about the deviate of a tail of HEX_SHARE ^ n
    z = F.when(is_hex, (few_pairs + many_changes + only_hex) / math.sqrt(3)).otherwise((few_pairs + many_changes) / math.sqrt(2))
    return out.withColumn("p_text", F.when(n >= 12, _upper_tail(z)).when(n.isNotNull(), 1.0)).drop("_plain")


def battery(tokens: DataFrame, token: str) -> DataFrame:
    """tokens with z_chi, z_runs, z_serial, p (of the three together) and symbols (their number), null where there is no token."""
    core = F.regexp_replace(F.col(token), "=+$", "")
    alphabet = reduce(lambda rest, e: F.when(F.col("_core").rlike(e[0]), F.lit(e[1])).otherwise(rest), reversed(ENCODINGS[:-1]), F.lit(ENCODINGS[-1][1]))
    out = tokens.withColumn("_core", core).withColumn("_alphabet", F.when(F.col("_core").isNotNull(), alphabet))
    out = out.withColumn("_codes", F.transform(F.split("_core", ""), lambda c: F.position(c, F.col("_alphabet")) - 1))
    out = out.withColumns({"symbols": F.length("_core"), "_k": F.length("_alphabet").cast("double")})
    n, k = F.col("symbols").cast("double"), F.col("_k")
    squares = _squares(F.col("_core"))
    pairs = F.arrays_zip(F.slice("_codes", F.lit(1), F.size("_codes") - 1).alias("a"), F.slice("_codes", F.lit(2), F.size("_codes") - 1).alias("b"))
    high = lambda x: x >= k / 2
    turns = F.size(F.filter(pairs, lambda x: high(x["a"]) != high(x["b"])))
    product = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + (x["a"] - (k - 1) / 2) * (x["b"] - (k - 1) / 2))
    out = out.withColumns(
        {
            "z_chi": _cube_root(squares * k / n - n, k - 1),
            "z_runs": (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4),
            "z_serial": product / ((k * k - 1) / 12) / F.sqrt(n - 1),
        }
    )
    together = F.pow(F.greatest("z_chi", F.lit(0.0)), F.lit(2.0)) + F.col("z_runs") * F.col("z_runs") + F.col("z_serial") * F.col("z_serial")
    return out.withColumn("p", _upper_tail(_cube_root(together, 3))).drop("_core", "_alphabet", "_codes", "_k")


def discovered(tokens: DataFrame, alpha: float) -> DataFrame:
    """Rows (length_class, bin) of the histogram bins of p_text in which ordinary text is rejected: findings, `alpha` of them false at most."""
    counted = tokens.groupBy("length_class", "bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("length_class")
    from_smallest = whole.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumns({"rank": F.sum("n").over(from_smallest), "m": F.sum("n").over(whole)})
    within = F.exp(-F.col("bin") * BIN) <= alpha * F.col("rank") / F.col("m")
    return ranked.withColumn("cut", F.min(F.when(within, F.col("bin"))).over(whole)).where(F.col("bin") >= F.col("cut")).select("length_class", "bin")


def find_spans(texts: DataFrame, alpha: float, missed: float) -> DataFrame:
    """(text_id, start, end, kind_no) of all spans of the texts (text_id, text)."""

    def of(kind: int, pattern: str) -> Column:
        parts = F.arrays_zip(F.split("text", pattern).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("hit"))
        return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind_no"), i.alias("place"), F.length(x["gap"]).alias("gap"), x["hit"].alias("hit")))

    patterns = [ASSIGN, ACCESS, HEX, TOKEN]
    low = F.lower("text")
    may_have = [reduce(lambda a, b: a | b, [low.contains(n) for n in NAMES]), F.col("text").contains("AKIA"), F.col("text").rlike(HEX), F.col("text").rlike(TOKEN)]
    some = texts.withColumns({f"has_{k}": c for k, c in enumerate(may_have)}).where(reduce(lambda a, b: a | b, [F.col(f"has_{k}") for k in range(4)]))
    found = some.select("text_id", F.explode(F.flatten(F.array_compact(F.array(*[F.when(F.col(f"has_{k}"), of(k, p)) for k, p in enumerate(patterns)])))).alias("x"))
    found = found.select("text_id", "x.*").where("hit is not null")
    is_token = (F.col("kind_no") == 3) & F.col("hit").rlike("[A-Za-z]")
    found = ordinary(battery(found.withColumn("token", F.when(is_token, F.col("hit"))), "token"), "token")
    good = F.when(F.col("kind_no") == 0, F.length(F.regexp_extract("hit", ASSIGN, 2)) >= LEAST_ASSIGNED).when(F.col("kind_no") == 3, is_token).otherwise(True)
    bin_no = F.least(F.lit(LAST_BIN), F.floor(-F.log("p_text") / BIN)).cast("int")
    classes = F.floor(F.log2(F.col("symbols").cast("double")) * 2).cast("int")
    found = found.select("text_id", "kind_no", "place", "gap", F.length("hit").alias("hit"), good.alias("good"), bin_no.alias("bin"), classes.alias("length_class"), (F.col("p") >= missed).alias("random"))
    found = found.groupBy("text_id", "kind_no", "place").agg(*[F.max(c).alias(c) for c in ("gap", "hit", "good", "bin", "length_class", "random")])  # copies of a text
    line = Window.partitionBy("text_id", "kind_no").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = materialise(found.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(line)).where("good").withColumn("start", F.col("end") - F.col("hit")))
    base = found.where("kind_no < 3")
    tokens = found.where("kind_no = 3")
    random = tokens.where("random").join(discovered(tokens, alpha), ["length_class", "bin"], "left_semi")
    both = base.select("text_id", "start", "end", "kind_no").unionByName(random.select("text_id", "start", "end", "kind_no"))
    return both.groupBy("text_id", "start", "end").agg(F.min("kind_no").alias("kind_no"))  # a token that is an access key or hex already


def scan_secrets(docs: DataFrame, alpha: float = 0.05, missed: float = 0.001) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans, with spans as kind:start:end."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_id", text_id("text"))
    spans = find_spans(rows.select("text_id", "text"), alpha, missed)
    listed = spans.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "end"))).alias("found"))
    result = rows.select("doc_id", "text_id").join(listed, "text_id", "left")
    found = F.coalesce("found", F.array().cast("array<struct<start:long,kind_no:int,end:long>>"))
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind_no"] == kind))
    named = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(named, x["kind_no"]), x["start"], x["end"])), ",")
    return result.select(
        "doc_id",
        *[count(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)],
        text(F.filter(found, lambda x: x["kind_no"] < 3)).alias("base_spans"),
        text(found).alias("spans"),
    )


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", alpha: float = 0.05, missed: float = 0.001) -> DataFrame:
    """docs with every span of `text` replaced by mark; overlapping spans by one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    spans = find_spans(docs.select(text_id(whole).alias("text_id"), whole.alias("text")), alpha, missed)
    listed = spans.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    both = docs.select(F.struct(*docs.columns).alias("row"), text_id(whole).alias("text_id")).join(listed, "text_id", "left")
    old = F.col("row").getField(text)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    until = lambda state, end: F.substr(old, (state["at"] + 1).cast("int"), F.greatest(F.lit(0), end - state["at"]).cast("int"))

    def step(state: Column, x: Column) -> Column:
        parts = F.when(x["start"] >= state["at"], F.concat(state["parts"], F.array(until(state, x["start"]), F.lit(mark)))).otherwise(state["parts"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), parts.alias("parts"))

    redacted = F.aggregate("spans", start, step, lambda state: F.array_join(F.concat(state["parts"], F.array(until(state, F.length(old)))), ""))
    new = F.when(F.col("spans").isNull(), old).otherwise(redacted)
    return both.select(*(new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))


def _spans_sql(kind: int, pattern: str, good: str) -> str:
    return f"""
  select rid, {kind} as kind_no, hit, sum(gap + length(hit)) over (partition by rid order by n) as until, {good} as good from (
    select rid, n, length(gaps[n]) as gap, hits[n] as hit from (
      select rid, gaps, hits, unnest(range(1, len(hits) + 1)) as n from (select rid, regexp_split_to_array(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}') as hits from docs)))"""


_QUOTED = ASSIGN.replace("'", "''")
#: The columns that come from patterns: a text between matches and a match in turn give the places.
BASE_SQL = rf"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents), spans as (
  {_spans_sql(0, _QUOTED, f"length(regexp_extract(hit, '{_QUOTED}', 2)) >= {LEAST_ASSIGNED}")} union all {_spans_sql(1, ACCESS, "true")} union all {_spans_sql(2, HEX, "true")}
), listed as (
  select rid, count(*) filter (kind_no = 0) as n_assign, count(*) filter (kind_no = 1) as n_access, count(*) filter (kind_no = 2) as n_hex,
         string_agg((['assign', 'access', 'hex'])[kind_no + 1] || ':' || (until - length(hit))::bigint || ':' || until::bigint, ',' order by until - length(hit), kind_no) as base_spans
  from spans where good group by rid
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base_spans, '')) as base_sha256 from docs left join listed using (rid)
"""
