"""Secret scan: candidate strings of documents, and a random forest that drops false findings. DataFrame functions only.

Candidates are long runs of token characters in whole texts. Each is described by its length, its character transitions
(share of neighbouring characters that change class, and their mean log probability under transitions counted over words of all
documents), its dictionary coverage (share of its letters in parts that are words of the corpus), whether it stands in a
path, URL or address, and its neighbouring words. A forest of Spark ML is trained on labelled findings.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import held_out, text_key
from skyledger.session import materialize

LEAST = 12  # characters of a candidate; there is no upper bound
CHUNK = 512  # characters whose pairs are looked up at once
CANDIDATE = rf"[A-Za-z0-9_+/=\-.@:]{{{LEAST},}}"
HINTS = ("key", "secret", "token", "password", "passwd", "pwd", "auth", "credential", "api")  # fixed values
FINDINGS = 20_000  # labelled findings the forest is trained on, at most
DICTIONARY_DOCUMENTS = 3  # documents that must hold a word for it to count as one
TREES, DEPTH = 24, 7
FEATURES = ["length", "digit_share", "upper_share", "letter_share", "changes", "transition", "coverage", "distinct_share", "in_path", "assigned", "hint_before", "quoted", "word_before", "word_after"]
PARTS = "[^A-Za-z]+"
LOWER, UPPER, DIGITS, OTHER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "_+/=-.@:"


def value_key(value: str = "value") -> Column:
    """Stands for a candidate in joins and groups, so rows of its parts do not carry it."""
    return F.unhex(F.sha2(F.col(value), 256))


def class_changes(value: Column) -> Column:
    """How often neighbouring characters differ in class: runs of one class become one character, and all but one count."""
    kinds = F.translate(value, LOWER + UPPER + DIGITS + OTHER, "a" * len(LOWER) + "A" * len(UPPER) + "9" * len(DIGITS) + "-" * len(OTHER))
    for kind in "aA9-":
        kinds = F.regexp_replace(kinds, f"{kind}+", kind)
    return F.length(kinds) - 1


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, nth, value, before, after) of each candidate of each text, with up to 40 characters around it.

    Texts are cut at candidates, so nothing of a text but its surroundings is carried along. Null and empty texts have none.
    Rows alike in id and text count once.
    """
    rows = docs.filter(F.col("text").rlike(CANDIDATE)).select("doc_id", text_key().alias("text_key"), "text")
    cut = rows.select("doc_id", "text_key", F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("values"), F.split("text", CANDIDATE).alias("between"))
    kept = cut.select(
        "doc_id", "text_key",
        F.transform("values", lambda v, i: F.struct(
            i.cast("int").alias("nth"), v.alias("value"), F.length(v).alias("length"),
            F.right(F.get("between", i), F.lit(40)).alias("before"), F.left(F.get("between", i + 1), F.lit(40)).alias("after"),
        )).alias("found"),
    )
    return kept.select("doc_id", "text_key", F.explode_outer("found").alias("f")).select("doc_id", "text_key", "f.*").filter("value is not null").filter(F.col("value").rlike("[0-9]") | F.col("value").rlike("^[^a-z]*[a-z].*[A-Z]") | F.col("value").rlike("[=:]")).distinct()


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, documents): lower-case words of 2 to 24 ASCII letters and how many texts hold each, over all documents."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word"))
    return words.filter(F.length("word").between(2, 24)).groupBy("word").agg(F.count("*").alias("documents"))


def transitions(words: DataFrame) -> DataFrame:
    """(pair, log_p): log probability of the second of two characters after the first, over corpus words; 702 rows at most."""
    pairs = words.select("documents", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("pair"))
    counted = pairs.groupBy("pair").agg(F.sum("documents").alias("n"))
    firsts = counted.groupBy(F.substring("pair", 1, 1).alias("c")).agg(F.sum("n").alias("all"))
    return counted.join(firsts, F.substring("pair", 1, 1) == F.col("c")).select("pair", F.log(F.col("n") / F.col("all")).alias("log_p"))


def described(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates with the columns FEATURES. Each distinct value is described once."""
    words = materialize(corpus_words(docs))
    table = transitions(words).agg(F.map_from_entries(F.collect_list(F.struct("pair", "log_p"))).alias("pairs"))  # one row of at most 702 pairs
    known = words.filter(F.col("documents") >= DICTIONARY_DOCUMENTS).select("word")

    values = materialize(found.select("value").distinct().withColumn("value_key", value_key()))
    parts = values.select("value_key", F.explode(F.filter(F.split(F.lower(F.regexp_replace("value", "([a-z])([A-Z])", "$1 $2")), PARTS), lambda p: F.length(p) >= 2)).alias("word"))
    covered = parts.join(known, "word").groupBy("value_key").agg(F.sum(F.length("word")).alias("covered"))

    # a value is read in chunks, each with the first character of the next, so pairs of one chunk are in memory at once
    n = F.length("value")
    chunks = F.filter(F.regexp_extract_all("value", F.lit(f"(?=(.{{1,{CHUNK + 1}}})).{{1,{CHUNK}}}"), F.lit(1)), lambda c: F.length(c) >= 2)
    log_p = lambda c, i: F.coalesce(F.try_element_at("pairs", F.lower(F.substr(c, i, F.lit(2)))), F.lit(-8.0))
    total = F.aggregate(chunks, F.lit(0.0), lambda s, c: F.aggregate(F.sequence(F.lit(1), F.length(c) - 1), s, lambda t, i: t + log_p(c, i)))
    distinct = F.aggregate(chunks, F.array().cast("array<string>"), lambda s, c: F.array_union(s, F.array_remove(F.split(c, "(?!^)"), "")))
    shape = values.crossJoin(F.broadcast(table)).select("value_key", (class_changes(F.col("value")) / n).alias("changes"), (total / n).alias("transition"), (F.size(distinct) / n).alias("distinct_share"))
    letters = F.length(F.regexp_replace("value", "[^A-Za-z]", ""))
    size = F.length("value")
    by_value = shape.join(covered, "value_key", "left")
    hint = "(" + "|".join(HINTS) + ")"
    told = found.withColumn("value_key", value_key()).join(by_value, "value_key").select(
        "doc_id", "text_key", "nth", "value", "before", "after", F.col("length").cast("double").alias("length"),
        (F.length(F.regexp_replace("value", "[^0-9]", "")) / size).alias("digit_share"), (F.length(F.regexp_replace("value", "[^A-Z]", "")) / size).alias("upper_share"),
        (letters / size).alias("letter_share"), "changes", "transition", (F.coalesce("covered", F.lit(0)) / F.greatest(letters, F.lit(1))).alias("coverage"), "distinct_share",
        (F.col("value").rlike("[a-z]/|://|@|^www[.]|[.](com|org|net|html?)") | F.col("before").rlike("[/@.]$")).cast("double").alias("in_path"),
        (F.col("value").rlike("^[A-Za-z_-]+[=:]") | F.col("before").rlike("[=:]\\s*[\"']?$")).cast("double").alias("assigned"),
        (F.lower("before").rlike(hint + "\\W*$") | F.lower("value").rlike("^" + hint + "[a-z_]*[=:]")).cast("double").alias("hint_before"),
        F.col("before").rlike("[\"'`]$").cast("double").alias("quoted"),
        F.col("before").rlike("[^\\W\\d]{2,} $").cast("double").alias("word_before"), F.col("after").rlike("^ [^\\W\\d]{2,}").cast("double").alias("word_after"),
    )
    return told.fillna(0.0, subset=FEATURES)


def train(labelled: DataFrame, most: int = FINDINGS, seed: int = 7) -> PipelineModel:
    """Forest over the columns FEATURES and `label` (0 or 1); takes the `most` first findings by a hash of their value."""
    slim = labelled.select(*FEATURES, F.col("label").cast("double").alias("label"), F.xxhash64("value", "doc_id", "nth").alias("_hash"), value_key().alias("_key"), "doc_id", "nth")
    bounded = slim.orderBy("_hash", "_key", "doc_id", "nth").limit(most).select(*FEATURES, "label")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"), forest]).fit(materialize(bounded))


def classify(told: DataFrame, model: PipelineModel) -> DataFrame:
    """(doc_id, text_key, nth, value, score, secret): score is the forest's probability that the finding is a secret."""
    score = vector_to_array("probability").getItem(1)
    return model.transform(told).select("doc_id", "text_key", "nth", "value", score.alias("score"), (score >= 0.5).alias("secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Findings of all documents with scores. `labelled` are findings (doc_id, nth, label); without them those outside the
    held-out fold are labelled by `likely`. One class alone scores all findings by that class."""
    told = materialize(described(materialize(candidates(docs)), docs))
    if labelled is None:
        truth = told.filter(~held_out()).withColumn("label", likely(F.col("value"), F.col("before")).cast("int"))
    else:
        truth = told.join(labelled.select("doc_id", "nth", "label"), ["doc_id", "nth"])
    kinds = {r.label for r in truth.select("label").distinct().collect()}  # 0 and 1
    if kinds != {0, 1}:
        score = F.lit(1.0 if kinds == {1} else 0.0)
        return told.select("doc_id", "text_key", "nth", "value", score.alias("score"), (score >= 0.5).alias("secret"))
    return classify(told, train(truth))


def likely(value: Column, before: Column) -> Column:
    """The label of a finding by public formats; hex digests count only where a credential's name is assigned them."""
    keyed = value.rlike("^(password|passwd|token|secret|api_key)[=:]") | F.lower(before).rlike("(password|passwd|token|secret|api_key)\\s*[=:]\\s*[\"']?$")
    return F.coalesce(value.rlike("^AKIA[0-9A-Z]{16}[.,]?$") | value.rlike("^gh[pousr]_[A-Za-z0-9]{36}$") | keyed, F.lit(False))
