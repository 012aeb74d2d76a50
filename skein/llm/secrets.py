"""Secret scans with DataFrame functions alone; a random forest removes false positives.

Rules propose wide: long runs of key characters that hold a digit, whatever is assigned to a name that says credential (of any length, with or without a
digit), passwords inside addresses. Each candidate gets its length, character classes and their
transitions, its coverage by dictionary words, what its path says, and the words beside it. A random forest (Spark ML)
trained on labelled findings scores it. Where no findings are handed in, rules label those of the corpus that are plain: vendor
prefixes and assignments to a credential are secrets; plain numbers, hashes named as such, dates and dictionary words are not.
The forest is fitted on about ``train_rows`` labelled findings chosen by hash (a documented bound); every candidate of
every whole text is scored.

A text is scanned once; every occurrence of a candidate is scored by its own place, and a value is reported once for a text, at the
place that scores highest. Only findings are shuffled, texts don't travel. No Python runs on the executors.

Defined results: a null or empty text has no finding; a null path says nothing; equal rows give equal findings, a set for each;
without labels of both classes the score is 0.5 and nothing is removed; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_rows, materialize

TRAIN_ROWS = 20_000
TREES, DEPTH = 20, 6
THRESHOLD = 0.5
#: Names that values are assigned to (bounded, as a lookbehind must be), and what a value of such a name is made of.
_NAMED = r"(?i:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)[A-Za-z0-9_-]{0,20}[\"']?\s{0,2}[=:]\s{0,2}"
#: A dotted JWT; a run of key characters with a digit ("=" is padding at its end alone, so that a name before "=" is no part of it); a quoted or bare value
#: of a credential's name; the password of an address.
CANDIDATE = (
    r"((?<![A-Za-z0-9+/_.-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+(?:\.[A-Za-z0-9_-]++)?"
    r"|(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
    # short lookbehinds first: the long ones are looked at after an assignment or a colon alone
    rf"|(?<=[\"'])(?<=[=:]\s{{0,2}}[\"'])(?<={_NAMED}[\"'])[^\s\"']{{4,}}+(?=[\"'])|(?<=[=:\s])(?<=[=:]\s{{0,2}})(?<={_NAMED})[^\s\"'`,;(){{}}\[\]<>]{{6,}}+"
    r"|(?<=:)(?<=[a-z]{2,10}://[^\s:/@]{1,64}:)[^\s:/@]{3,}+(?=@))"
)

# Words that identifiers and examples are made of, prefixes of issued keys, and words beside findings.
DICTIONARY = "access account admin api auth bucket cache cloud code config data demo dummy example file host http https index item key local login main name node page password path port private public query sample secret server service session source test text token type user value version".split()
PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|xox[abp]-|AIza|eyJ)"
CREDENTIAL = r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)[A-Za-z0-9_-]{0,20}\W*$"
ADDRESS, BLOCK = r"[a-z]{2,10}://[^\s:/@]+:$", r"PRIVATE KEY-----\s*$"
ASSIGNED = r"[=:]\s*[\"']?$"
DIGEST = r"(?i)(?:sha-?\d*|md5|checksum|digest|commit|uuid|etag|hash)\W*$"
QUIET_PATH = r"(?i)(?:^|[^a-z])(?:tests?|examples?|samples?|fixtures?|docs?|mock)(?:[^a-z]|$)"
FEATURES = ["length", "digits", "upper", "lower", "others", "transitions", "distinct_chars", "hex_only", "dictionary", "letter_runs", "prefix", "credential", "assigned", "address", "block", "quoted", "digest", "quiet_path", "beside_letters"]


def _share(value: Column, pattern: str) -> Column:
    """Share of the characters that ``pattern`` removes."""
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, row, start, length, value and the features of every occurrence of a candidate in every text."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), "text").filter(F.col("text").rlike(CANDIDATE))
    every = rows.select("doc_id", "row", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(1)).alias("all"), F.split("text", CANDIDATE, -1).alias("gaps"))
    # a match starts after all gaps and matches before it
    ends = F.aggregate(F.arrays_zip("gaps", "all"), F.array(F.lit(0).cast("long")), lambda got, x: F.concat(got, F.array(F.element_at(got, -1) + F.length(x["gaps"]) + F.coalesce(F.length(x["all"]), F.lit(0)))))
    each = every.withColumn("ends", ends).select("*", F.posexplode("all").alias("i", "value"))
    value, i = F.col("value"), F.col("i")
    gap = lambda n: F.get("gaps", n)
    near = lambda n: F.coalesce(F.get("all", n), F.lit(""))
    at = each.select("doc_id", "row", "path", "value", (F.get("ends", i) + F.length(gap(i))).alias("start"), F.right(F.concat(F.when(i > 0, near(i - 1)).otherwise(""), gap(i)), F.lit(40)).alias("before"), F.left(F.concat(gap(i + 1), near(i + 1)), F.lit(20)).alias("after"))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "c"), "[^abc]", "d")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    before, after = F.col("before"), F.col("after")
    return at.select(
        "doc_id",
        "row",
        "start",
        F.length(value).cast("long").alias("length_chars"),
        "value",
        F.length(value).cast("double").alias("length"),
        _share(value, "[0-9]").alias("digits"),
        _share(value, "[A-Z]").alias("upper"),
        _share(value, "[a-z]").alias("lower"),
        _share(value, "[^A-Za-z0-9]").alias("others"),
        ((F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1) / F.length(value)).alias("transitions"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.length(value)).alias("distinct_chars"),
        flag(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")).alias("hex_only"),
        _share(F.lower(value), "|".join(sorted(DICTIONARY, key=len, reverse=True))).alias("dictionary"),
        _share(value, "[A-Za-z]{4,}").alias("letter_runs"),
        flag(value.rlike(PREFIXES)).alias("prefix"),
        flag(F.regexp_replace(before, ASSIGNED, "").rlike(CREDENTIAL)).alias("credential"),
        flag(before.rlike(ASSIGNED)).alias("assigned"),
        flag(before.rlike(ADDRESS) & after.startswith("@")).alias("address"),
        flag(before.rlike(BLOCK)).alias("block"),
        flag(before.rlike("[\"']$") & after.rlike("^[\"']")).alias("quoted"),
        flag(F.regexp_replace(before, ASSIGNED, "").rlike(DIGEST)).alias("digest"),
        flag(F.col("path").rlike(QUIET_PATH)).alias("quiet_path"),
        _share(F.concat(before, after, F.lit(" ")), r"[\p{L}]").alias("beside_letters"),
    )


def plain_labels(found: DataFrame) -> DataFrame:
    """Candidates that rules can label, with ``label`` 1.0 (secret) or 0.0."""
    secret = (F.col("prefix") == 1) | (F.col("address") == 1) | (F.col("block") == 1) | ((F.col("credential") == 1) & (F.col("assigned") == 1) & (F.col("digits") < 1))
    harmless = (F.col("digits") == 1) | (F.col("digest") == 1) | (F.col("dictionary") > 0.6) | F.col("value").rlike(r"^\d{4}-\d\d-\d\d")
    return found.withColumn("label", F.when(secret, 1.0).when(harmless, 0.0)).filter(F.col("label").isNotNull())


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS):
    """A forest from ``labelled`` findings (features and label), or None without both classes."""
    keys = [c for c in ("doc_id", "value", "start") if c in labelled.columns]
    rows = materialize(bounded_rows(labelled.select(*keys, "label", *FEATURES), train_rows, *keys))
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=13, featuresCol="x", labelCol="label")
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows))


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, length, found, sha256 and masked value, score and is_secret of every finding."""
    found = materialize(candidates(docs, path))
    model = train(plain_labels(found) if labelled is None else labelled)
    if model is None:
        scored = found.withColumn("score", F.lit(0.5))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(found)).withColumn("score", vector_to_array("probability")[1])
    best = F.max(F.struct("score", (-F.col("start")).alias("back"), "length_chars")).alias("best")
    scored = scored.groupBy("doc_id", "row", "value").agg(F.count("*").cast("int").alias("found"), best)
    scored = scored.select("doc_id", (-F.col("best.back")).alias("start"), "best.length_chars", "found", "value", "best.score")
    masked = F.concat(F.substring("value", 1, 4), F.lit("..."))
    return scored.select("doc_id", "start", F.col("length_chars").alias("length"), "found", F.sha2("value", 256).alias("value_sha256"), masked.alias("masked"), "score", (F.col("score") >= threshold).alias("is_secret"))
