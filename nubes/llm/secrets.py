"""Secret scans: candidate patterns, then a random forest that removes false positives.

All of it is DataFrame functions and Spark ML, no Python in the tasks.  A text is cut at its candidates, so every candidate
comes with the characters before and after it and with its position.  The forest sees the candidate's length, the share of
character transitions by kind, how much of it dictionary words cover, the path (the document's source) and the neighbouring
words.  It is trained on a table of labelled findings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats of known secrets, by kind.
FORMATS = {
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "stripe_key": r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
    "assigned": r"""(?<=[=:]\s{0,2}["']?)(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}={0,2}""",
    "hex": r"\b[0-9a-fA-F]{32,}\b",
}
CANDIDATE = "|".join(FORMATS.values())
#: Words that speak for a secret, or against one, near a candidate or in a path; common words for coverage.
FOR = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "key", "auth", "bearer", "credential", "access")
AGAINST = ("hash", "sha1", "sha256", "md5", "commit", "checksum", "digest", "etag", "uuid", "guid", "id", "version", "integrity", "revision", "example", "sample", "dummy")
PATHS = ("test", "example", "doc", "sample", "fixture", "mock")
DICTIONARY = ("password", "example", "secret", "token", "change", "test", "dummy", "sample", "your", "here", "value", "default", "http", "index", "image", "config", "local", "admin", "user", "name", "this", "that", "with", "from")
CONTEXT = 48
LEAST_PROBABILITY = 0.5
MAX_LABELLED = 20_000


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, start (code point, from 0), value, before, after: every match of a format in every whole text."""
    # Java's lookbehind must be bounded, which the patterns respect; one regular scan drops texts without any match
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), "text").where(F.col("text").rlike(CANDIDATE))
    cut = rows.select("doc_id", "path", F.split("text", CANDIDATE, -1).alias("parts"), F.regexp_extract_all("text", F.lit(f"({CANDIDATE})"), F.lit(1)).alias("values"))
    # part i stands before value i; where a match is empty at an end, split and extract still agree in number
    found = cut.select("doc_id", "path", F.posexplode(F.arrays_zip("values", F.slice("parts", 1, F.size("values")).alias("ahead"), F.slice("parts", 2, F.size("values")).alias("next"))).alias("i", "x"), "parts", "values")
    length = lambda column, n: F.aggregate(F.slice(column, 1, n), F.lit(0), lambda a, p: a + F.length(p))
    start = length("parts", F.col("i") + 1) + length("values", F.col("i"))
    return found.select(
        "doc_id", "path", start.cast("long").alias("start"), F.col("x.values").alias("value"),
        F.lower(F.substring("x.ahead", -CONTEXT, CONTEXT)).alias("before"), F.lower(F.substring("x.next", 1, CONTEXT)).alias("after"),
    ).where("value IS NOT NULL")


FEATURES = ("length", "digits", "letters_to_digits", "digits_to_letters", "case_changes", "distinct", "covered", "hex_only", "known", "path_hint", "for_near", "against_near", "for_after", "against_after", "quoted", "assigned")


def features(found: DataFrame) -> DataFrame:
    """``found`` with the forest's features: numbers from value, path, before and after."""
    v, low, size = F.col("value"), F.lower("value"), F.length("value").cast("double")
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    any_of = lambda column, words: reduce(lambda a, w: a | column.contains(w), words[1:], column.contains(words[0])).cast("double")
    tail = lambda n: F.substring(F.col("before"), -n, n)
    bare = reduce(lambda text, word: F.replace(text, F.lit(word), F.lit("")), DICTIONARY, low)
    known = reduce(lambda a, p: a | v.rlike(p), [p for k, p in FORMATS.items() if k not in ("assigned", "hex")], F.lit(False))
    return found.withColumns({
        "length": size,
        "digits": count("[0-9]") / size,
        "letters_to_digits": count("[A-Za-z](?=[0-9])") / size,
        "digits_to_letters": count("[0-9](?=[A-Za-z])") / size,
        "case_changes": count("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / size,
        "distinct": F.size(F.array_distinct(F.split(low, ""))).cast("double"),
        "covered": (size - F.length(bare)) / size,
        "hex_only": v.rlike("^[0-9a-fA-F]+$").cast("double"),
        "known": known.cast("double"),
        "path_hint": any_of(F.lower("path"), PATHS),
        "for_near": any_of(tail(24), FOR),
        "against_near": any_of(tail(24), AGAINST),
        "for_after": any_of(F.col("after"), FOR),
        "against_after": any_of(F.col("after"), AGAINST),
        "quoted": tail(1).isin('"', "'").cast("double"),
        "assigned": tail(4).rlike("[=:]").cast("double"),
    })


def labelled_findings(spark: SparkSession, n: int = 1200) -> DataFrame:
    """The labelled table: path, value, before, after, label.  Values come from MD5 and SHA digests of a counter."""
    i = F.col("id")
    md5, sha = F.md5(i.cast("string")), F.sha1(i.cast("string"))
    mixed = F.translate(F.base64(F.unhex(F.sha2(i.cast("string"), 256))), "=", "")
    long = F.translate(F.base64(F.unhex(F.concat(F.sha2(i.cast("string"), 512), F.sha2(F.concat(i.cast("string"), F.lit("b")), 512)))), "\r\n", "")
    plain = F.translate(mixed, "0123456789+/", "qXzJkVbWyHgR")
    word = F.element_at(F.array(*map(F.lit, ("archive", "general", "harbour", "measure", "reading", "station", "winter", "language"))), (F.pmod(F.xxhash64(i), F.lit(8)) + 1).cast("int"))
    cases = [  # value, before, after, path, label
        (sha, 'of the token = "', '" and on', "src/app", 1), (md5, "api_key: ", "\n", "src/main", 1), (mixed, 'secret = "', '"', "deploy", 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(md5, 1, 16))), "access ", " end", "src/app", 1), (F.concat(F.lit("ghp_"), F.substring(F.translate(mixed, "+/", "ab"), 1, 36)), "auth ", "", "ci", 1),
        (F.concat(F.lit("sk_live_"), F.substring(md5, 1, 24)), "key=", "", "pay", 1), (mixed, "password: ", "\n", "settings", 1), (F.upper(sha), 'TOKEN = "', '"!!', "src3", 1),
        (sha, "commit ", " fixed", "log", 0), (md5, "md5 ", " file", "dist", 0), (F.sha2(i.cast("string"), 256), "sha256: ", "\n", "package", 0), (F.concat(F.substring(md5, 1, 8), F.lit("-"), F.substring(md5, 9, 4), F.lit("-"), F.substring(md5, 13, 20)), "uuid: ", "", "src", 0),
        (sha, "checksum = ", " ", "lib", 0), (F.concat(F.lit("your-secret-token-here-"), i.cast("string")), "token: ", "", "doc/example", 0), (F.concat(F.lit("example.config.value."), i.cast("string")), 'key = "', '"', "test/sample", 0),
        (F.concat(F.lit("static/images/index"), i.cast("string"), F.lit(".default.png")), "src: ", "", "web", 0), (F.concat(F.lit("changeme-password-"), i.cast("string")), "password: ", "", "test", 0), (md5, "etag: ", "", "http", 0),
        # of any length, with digits or none
        (long, 'private_key = "', '"', "src/app", 1), (plain, "api_key: ", "\n", "src/main", 1), (F.sha2(i.cast("string"), 512), 'secret = "', '"', "deploy", 1),
        (F.sha2(i.cast("string"), 512), "sha512: ", " file", "package", 0), (F.sha2(i.cast("string"), 512), "digest ", "\n", "lib", 0), (F.concat(F.lit("//www."), word, F.lit(".org/"), word, F.lit("/index")), "see http:", " for", "web", 0),
        (F.concat(word, F.lit("_"), word, F.lit("_value")), "name = ", "\n", "src", 0), (F.concat(word, F.lit("-"), word, F.lit("-"), word), "title: ", " and", "", 0),
    ]
    pick = F.pmod(i, F.lit(len(cases)))
    column = lambda k: reduce(lambda a, c: F.when(pick == c[0], c[1][k] if not isinstance(c[1][k], str) else F.lit(c[1][k])).otherwise(a), enumerate(cases), F.lit(None))
    label = reduce(lambda a, c: F.when(pick == c[0], F.lit(c[1][4])).otherwise(a), enumerate(cases), F.lit(0))
    return spark.range(n).select(column(3).alias("path"), column(0).alias("value"), F.lower(column(1)).alias("before"), F.lower(column(2)).alias("after"), label.cast("double").alias("label"))


def train(findings: DataFrame, most: int = MAX_LABELLED) -> RandomForestClassificationModel:
    """A forest on at most ``most`` labelled findings, taken by the hash of their value."""
    rows = features(findings.na.drop(subset=["value", "label"]).orderBy(F.xxhash64("value", "before")).limit(most))
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=24, maxDepth=8, seed=5, labelCol="label").fit(table)


def scan(docs: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """doc_id, start, stop, kind, value_sha256, probability, is_secret of every candidate in ``docs`` (doc_id, text, source).

    Null and empty texts have no candidates; a null source is an empty path; a null doc_id stays null; repeated rows each
    give their candidates; an empty table gives an empty result.  The value itself stays out of the result.
    """
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(candidates(docs)))
    kind = reduce(lambda a, k: F.when(F.col("value").rlike(f"^(?:{FORMATS[k]})$"), k).otherwise(a), [k for k in reversed(FORMATS) if k != "assigned"], F.lit("assigned"))
    scored = model.transform(table).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return scored.select(
        "doc_id", "start", (F.col("start") + F.length("value")).cast("long").alias("stop"), kind.alias("kind"),
        F.sha2("value", 256).alias("value_sha256"), "probability", (F.col("probability") >= LEAST_PROBABILITY).alias("is_secret"),
    )
