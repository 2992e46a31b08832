"""Secrets in text: fixed patterns, and tokens that pass for random; DataFrame operations only.

A long token with a digit is read in the encoding that its characters imply. Three tests ask whether
its values could be drawn at random: chi-squared for an even use of the alphabet, runs above and
below the middle, and correlation of neighbours. Fisher's method combines them. Over the corpus,
the tokens of one encoding and length class are tested together: by Benjamini and Hochberg's
procedure those that are not random are picked out at a bounded false-discovery rate, and what is
left is a secret. Encodings have a least length, below which a token says too little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.session import materialize

# The base patterns of the scan.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 6
#: A shorter match of AKIA[A-Z0-9]+ holds no longer one, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
#: Whole runs of [0-9a-f] of 24 characters or more.
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs of token characters with a digit among them.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"

# Encodings in the order they are tried: pattern of the whole token, alphabet, least length.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "hex": (r"^(?=.*[a-f])[0-9a-f]+$", "0123456789abcdef", 24),
    "upper_hex": (r"^(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF", 24),
    "base32": (r"^(?=.*[A-Z])[A-Z2-7]+=*$", UPPER + "234567", 20),
    "base36": (r"^(?=.*[a-z])[a-z0-9]+$", DIGITS + LOWER, 20),
    "base64": (r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/", 20),
    "base64url": (r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_", 20),
    "upper_base36": (r"^(?=.*[A-Z])[A-Z0-9]+=*$", UPPER + DIGITS, 20),
    "lower_url": (r"^(?=.*[a-z])[a-z0-9_-]+=*$", DIGITS + LOWER + "-_", 20),
    "upper_url": (r"^(?=.*[A-Z])[A-Z0-9_-]+=*$", UPPER + DIGITS + "-_", 20),
    "digits": (r"^[0-9]+=*$", DIGITS, 20),
    "any": (r"^[A-Za-z0-9+/_-]+=*$", UPPER + LOWER + DIGITS + "+/-_", 20),
}
#: p-values are counted in bins of this many to a factor of ten.
BINS_PER_TEN, MOST_TENS = 10, 30


def spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Matches from left to right as (start, end, kind number, token), in code points.

    What splitting by the pattern leaves between its matches tells where they are. A match whose
    group is shorter than `least` is dropped, but has used up its characters.
    """
    span = "struct<start:int,end:int,kind:int,token:string>"
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("token"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("found"))

    def step(seen: Column, part: Column) -> Column:
        start = seen["at"] + F.char_length(part["gap"])
        end = start + F.coalesce(F.char_length(part["match"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), part["token"].alias("token"))
        keep = part["match"].isNotNull() & (F.char_length(part["token"]) >= least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(seen["found"], F.array(one))).otherwise(seen["found"]).alias("found"))

    none = F.array().cast(f"array<{span}>")
    return F.when(text.rlike(pattern), F.aggregate(parts, begin, step, lambda seen: seen["found"])).otherwise(none)


def above(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic approximation, error below 2e-4)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))


def two_sided(z: Column) -> Column:
    return F.greatest(F.least(2 * above(F.abs(z)), F.lit(1.0)), F.lit(10.0 ** -(MOST_TENS / 3)))


def randomness(values: Column, size: Column) -> Column:
    """p-value of the combined battery under the hypothesis that values, an array of doubles below size, are random."""

    def battery(x: Column) -> Column:
        v, k = x["values"], x["size"]
        n = F.size(v).cast("double")
        squares = F.aggregate(F.sequence(F.lit(0), (k - 1).cast("int")), F.lit(0.0), lambda s, y: s + F.pow(F.size(F.filter(v, lambda z: z == y)), F.lit(2.0)))
        chi = F.greatest(squares * k / n - n, F.lit(0.0)) / (k - 1)
        part = 2 / (9.0 * (k - 1))
        even = (F.pow(chi, F.lit(1 / 3)) - (1 - part)) / F.sqrt(part)
        high = F.size(F.filter(v, lambda y: y >= k / 2)).cast("double")
        low = n - high
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda y, z: F.struct(y.alias("x"), z.alias("y")))
        # Of each pair: does it begin a run, and its product about the middle.
        begin = F.struct(F.lit(1.0).alias("runs"), F.lit(0.0).alias("products"))
        sums = F.aggregate(pairs, begin, lambda s, p: F.struct(
            (s["runs"] + F.when((p["x"] >= k / 2) != (p["y"] >= k / 2), 1.0).otherwise(0.0)).alias("runs"),
            (s["products"] + (p["x"] - (k - 1) / 2) * (p["y"] - (k - 1) / 2)).alias("products")))
        mean = 2 * high * low / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        run = F.when(variance > 0, (sums["runs"] - mean) / F.sqrt(variance)).otherwise(10.0)
        serial = sums["products"] / ((k * k - 1) / 12) / F.sqrt(n - 1)
        logs = F.transform(F.array(even, run, serial), lambda z: F.log(two_sided(z)))
        half = F.transform(F.array(logs), lambda y: -(F.get(y, F.lit(0)) + F.get(y, F.lit(1)) + F.get(y, F.lit(2))))
        return F.element_at(F.transform(half, lambda h: F.exp(-h) * (1 + h + h * h / 2)), 1)

    return F.element_at(F.transform(F.array(F.struct(values.alias("values"), size.alias("size"))), battery), 1)


def read_tokens(tokens: Column) -> Column:
    """Tokens with the encoding they imply, their length class and p-value; the last encoding takes every token.

    The encoding is chosen first; its alphabet turns characters to values, and one battery looks at
    them, whatever the encoding.
    """
    names, alphabets = (F.array(*(F.lit(x) for x in xs)) for xs in (list(ENCODINGS), [alphabet for _, alphabet, _ in ENCODINGS.values()]))

    def encoded(x: Column) -> Column:
        code = F.lit(None).cast("int")
        for number, (pattern, _, least) in reversed(list(enumerate(ENCODINGS.values()))):
            code = F.when(x["token"].rlike(pattern) & (F.char_length(x["token"]) >= least), number).otherwise(code)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["token"].alias("token"), code.alias("code"))

    def read(x: Column) -> Column:
        alphabet = F.get(alphabets, x["code"])
        values = F.transform(F.split(F.rtrim(x["token"], F.lit("=")), ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        group = F.concat(F.get(names, x["code"]), F.lit(":"), F.floor(F.log2(F.char_length(x["token"]).cast("double")) * 2).cast("string"))
        p = randomness(values, F.char_length(alphabet).cast("double"))
        tens = F.least(F.lit(MOST_TENS * BINS_PER_TEN), F.floor(-F.log10(F.greatest(p, F.lit(10.0**-MOST_TENS))) * BINS_PER_TEN)).cast("int")
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), group.alias("group"), tens.alias("bin"))

    return F.transform(F.filter(F.transform(tokens, encoded), lambda x: x["code"].isNotNull()), read)


def least_random(scanned: DataFrame, rate: float) -> dict[str, int]:
    """Per group the first bin of p-values that Benjamini and Hochberg reject as not random.

    A bin stands for its largest p-value, so the rate holds. Counts are of groups (encodings by
    length classes) and bins, however many tokens there are.
    """
    counts = scanned.select(F.explode("tokens").alias("x")).groupBy("x.group", "x.bin").agg(F.count("*").alias("n")).collect()
    out = {}
    for group in sorted({r["group"] for r in counts}):
        bins = {r["bin"]: r["n"] for r in counts if r["group"] == group}
        total, seen = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 10 ** (-b / BINS_PER_TEN) <= rate * seen / total:
                out[group] = b
    return out


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Every row's doc_id and spans, an array of (start, end, kind) by start, then kind.

    Kinds are numbered as in KINDS; random tokens are reported where no base span overlaps them. A
    null text is empty. Repeated rows are scanned each; an empty table gives no rows.
    """
    text = F.col("text")
    rows = docs.select("doc_id", common.text_of().alias("text"))
    base = F.concat(spans(text, ASSIGN, "assign", 2, ASSIGN_LENGTH), spans(text, ACCESS, "access"), spans(text, HEX, "hex"))
    rows = rows.select("doc_id", base.alias("base"), spans(text, TOKEN, "random").alias("tokens"))
    bare = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    scanned = materialize(rows.select("doc_id", F.transform("base", bare).alias("base"), read_tokens(F.col("tokens")).alias("tokens")), "secrets")
    bounds = least_random(scanned, rate)
    bound = F.lit(1 << 30)
    known = F.create_map(*(F.lit(x) for item in bounds.items() for x in item)) if bounds else None
    random = lambda x: (x["bin"] < F.coalesce(known[x["group"]], bound)) if known is not None else F.lit(True)
    clear = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    more = F.transform(F.filter("tokens", lambda x: random(x) & clear(x)), bare)
    by_start = F.transform(F.concat("base", more), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    ordered = F.transform(F.sort_array(by_start), bare)
    return scanned.select("doc_id", ordered.alias("spans"))


def without_secrets(docs: DataFrame, mark: str = "[SECRET]", rate: float = 0.05) -> DataFrame:
    """docs with each secret's characters replaced by `mark`; overlapping spans become one.

    Only rows that have a secret meet their spans again. Rows without a doc_id are joined too: nulls
    and repeated doc_ids are told apart by their text.
    """
    key = F.xxhash64(common.text_of())
    found = find_secrets(docs.select(F.struct("doc_id", key.alias("key")).alias("doc_id"), "text"), rate)
    found = found.where(F.size("spans") > 0).select(F.col("doc_id.doc_id").alias("__found_id"), F.col("doc_id.key").alias("__found_key"), F.col("spans").alias("__found_spans"))
    found = materialize(found.dropDuplicates(["__found_id", "__found_key"]), "found-secrets")
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__found_id")) & (key == F.col("__found_key")), "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(seen: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), seen["at"] + 1, F.greatest(x["start"] - seen["at"], F.lit(0)))
        new = F.when(x["start"] >= seen["at"], F.concat(seen["text"], gap, F.lit(mark))).otherwise(seen["text"])
        return F.struct(F.greatest(seen["at"], x["end"]).alias("at"), new.alias("text"))

    rest = lambda seen: F.concat(seen["text"], F.substring(F.col("text"), seen["at"] + 1, F.char_length("text")))
    clean = F.when(F.col("__found_spans").isNull(), F.col("text")).otherwise(F.aggregate("__found_spans", begin, step, rest))
    return joined.withColumn("text", clean).select(*docs.columns)


def op9_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.read_table(spark, sf_dir, "documents"))
    name = lambda x: F.element_at(F.array(*(F.lit(k) for k in KINDS)), x["kind"] + 1)
    said = lambda array: F.concat_ws(",", F.transform(array, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
