"""Secret scan with a random forest that removes false positives.

Scanner: every run of at least ``SHORTEST`` characters of ``[A-Za-z0-9_+/=-]`` inside a
word is a finding, with the words around it. That finds keys and tokens of any format,
and far more long words, numbers, paths and identifiers. Besides, whatever stands after
a credential's name and an assignment sign is a finding, of any length and characters. A
random forest tells them apart by

* length, kinds of characters and distinct characters,
* character transitions: changes of kind, longest run of one kind, consonant runs,
* dictionary coverage: the share of the characters that frequent word parts explain,
* path: slashes, dots, at signs and schemes around the finding in its word,
* neighbouring words: names of credentials, assignment signs and quotes before it.

It is trained on labelled findings: ``labelled`` marks those of the published formats of
credentials, and those assigned to a variable named like one, as secrets; the others are
false positives. At most ``TRAINING_ROWS`` findings of each kind are used, taken in the
order of a hash; every finding is then judged.

Everything on the way of the rows is DataFrame functions and pyspark.ml, without Python
code on executors. Findings are an explode of one row's words, so no group of rows
meets in a task.

Defined results: null and empty texts have no findings; documents without id are scanned
and redacted; repeated rows have the findings repeated; without findings of both kinds
to train on, every finding is kept; columns of the input may have any other names.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST = 16
TRAINING_ROWS = 10_000
TREES, DEPTH, SEED = 20, 6, 11
KEPT = 0.5               # least probability of a finding that is kept
MASK = "[SECRET]"

RUN = "[A-Za-z0-9_+/=-]{%d,}" % SHORTEST
CREDENTIAL = "(token|secret|passw|pwd|api_?key|apikey|access_?key|private_?key|auth|bearer|credential|signature)"
# published formats of credentials (fixed values)
FORMATS = (
    "^AKIA[0-9A-Z]{16}$",
    "^ASIA[0-9A-Z]{16}$",
    "^gh[pousr]_[A-Za-z0-9]{36}",
    "^xox[abprs]-[A-Za-z0-9-]{10,}",
    "^sk_(live|test)_[A-Za-z0-9]{16,}",
    "^AIza[A-Za-z0-9_-]{35}$",
    "^eyJ[A-Za-z0-9_-]{10,}",
)
# frequent parts of words in the corpus' languages
PARTS = ("tion|ment|keit|heit|lich|isch|ung|ing|the|and|for|with|that|this|have|from|are|was|ation|able|ness|ous|ent|ant|"
         "sch|ein|der|die|das|und|ich|nicht|auf|ver|ge|be|zu|en|er|es|re|de|le|la|el|los|las|que|qui|con|por|para|una|un|"
         "les|des|dans|pour|est|sur|elle|eau|eux|aux|oi|ou|an|in|on|or|at|to|of|it|is|ar|ra|do|ado|ido|mente|cion|ie|ue|ea|nd|th|st|sh|ha|he|ti|ly|ed")

# what is assigned to a credential's name, in the name's own word or as the next word
QUOTES = r"\x22\x27`"
NAMED = CREDENTIAL + rf"[^=:]*[=:]+[\s!{QUOTES}]*$"
OPENING, CLOSING = rf"^[{QUOTES}(\[{{<!]*", rf"[{QUOTES},;)\]}}>.]*$"
ASSIGNED = rf"(?i)^(.*?{CREDENTIAL}[^=:]*[=:]+[{QUOTES}]*)([^=:{QUOTES}].*?){CLOSING}"

FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_other", "f_hex", "f_distinct", "f_changes", "f_run", "f_consonants",
            "f_coverage", "f_path", "f_named", "f_assigned", "f_quoted"]


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, word_index, finding, prefix, word, before, before2, before3) of every run and
    every value of a credential's name; prefix is what the word has before the finding."""
    words = F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ").alias("w")
    d = docs.select("doc_id", words, F.col("text").rlike(f"(?i){CREDENTIAL}").alias("named"))
    d = d.where(F.col("named") | F.exists("w", lambda x: F.length(x) >= SHORTEST))
    d = d.select("doc_id", F.explode(F.expr(
        "transform(filter(sequence(0, size(w) - 1),"
        f" i -> (length(w[i]) >= {SHORTEST} and w[i] rlike '{RUN}') or (named and (w[i] rlike '[=:]' or coalesce(get(w, i - 1), '') rlike r'[=:][!{QUOTES}]*$'))),"
        " i -> struct(i as i, w[i] as word, coalesce(get(w, i - 1), '') as b1, coalesce(get(w, i - 2), '') as b2, coalesce(get(w, i - 3), '') as b3))")).alias("x"))
    d = d.select("doc_id", F.col("x.i").cast("long").alias("word_index"), F.col("x.word").alias("word"),
                 F.col("x.b1").alias("before"), F.col("x.b2").alias("before2"), F.col("x.b3").alias("before3"))
    run = F.expr(f"transform(regexp_extract_all(word, '({RUN})', 1), f -> struct(f as finding, substring_index(word, f, 1) as prefix))")
    after = F.lower(F.concat_ws(" ", "before3", "before2", "before")).rlike(NAMED)
    groups = len(CREDENTIAL.split("(")) - 1                # groups of the name come between the prefix and the value
    own = F.struct(F.regexp_extract("word", ASSIGNED, 2 + groups).alias("finding"), F.regexp_extract("word", ASSIGNED, 1).alias("prefix"))
    opening = F.regexp_extract("word", OPENING, 0)
    following = F.struct(F.when(after, F.regexp_replace(F.regexp_replace("word", OPENING, ""), CLOSING, "")).otherwise("").alias("finding"), opening.alias("prefix"))
    values = F.filter(F.array(own, following), lambda x: x["finding"].rlike(rf"[^=:!{QUOTES}]"))
    # a run that is such a value is one finding
    others = F.filter(values, lambda v: ~F.exists(run, lambda r: r["finding"] == v["finding"]))
    d = d.withColumn("x", F.explode(F.concat(run, F.array_distinct(others))))
    return d.select("doc_id", "word_index", F.col("x.finding").alias("finding"), F.col("x.prefix").alias("prefix"), "word", "before", "before2", "before3")


def _share(c: Column, pattern: str) -> Column:
    """Share of the characters left when ``pattern`` is removed."""
    return F.length(F.regexp_replace(c, pattern, "")) / F.length(c)


def with_features(found: DataFrame) -> DataFrame:
    c, word = F.col("finding"), F.col("word")
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]", "U"), "[a-z]", "l"), "[0-9]", "8"), "_+/=-", "-----")
    near = F.lower(F.concat_ws(" ", "before3", "before2", "before", "prefix"))
    number = {
        "f_length": F.length(c),
        "f_digits": 1 - _share(c, "[0-9]"), "f_upper": 1 - _share(c, "[A-Z]"), "f_lower": 1 - _share(c, "[a-z]"), "f_other": _share(c, "[A-Za-z0-9]"),
        "f_hex": 1 - _share(c, "[0-9a-fA-F]"),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))),
        "f_changes": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / F.length(c),
        "f_run": F.array_max(F.transform(F.regexp_extract_all(kinds, F.lit(r"((.)\2*)"), 1), F.length)),
        "f_consonants": F.array_max(F.transform(F.split(F.lower(c), "[aeiouy]"), F.length)),
        "f_coverage": 1 - _share(F.lower(c), f"({PARTS})"),
        "f_path": F.length(word) - F.length(F.translate(word, "/.@:\\", "")),
        "f_named": near.rlike(CREDENTIAL).cast("int"),
        "f_assigned": near.rlike(r"[=:]+[\s!\"']*$").cast("int"),
        "f_quoted": F.col("prefix").rlike("[\"'`]$").cast("int"),
    }
    return found.select("*", *[F.coalesce(number[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])


def labelled(found: DataFrame) -> DataFrame:
    """Findings with features and a label: 1.0 for the formats of credentials and for
    assignments to a credential's name, otherwise 0.0."""
    known = F.lit(False)
    for f in FORMATS:
        known = known | F.col("finding").rlike(f)
    assigned = (F.col("f_named") == 1) & (F.col("f_assigned") == 1) & (F.col("f_digits") > 0) & (F.col("f_digits") < 1)
    return found.withColumn("label", (known | assigned).cast("double"))


def train(examples: DataFrame, rows: int = TRAINING_ROWS):
    """Forest from labelled findings with features; None when a kind is missing. At most
    ``rows`` examples of each kind, in hash order."""
    order = F.xxhash64("finding", "word", "before", "doc_id", "word_index")
    sample = None
    for label in (1.0, 0.0):
        part = examples.where(F.col("label") == label).select(*FEATURES, "label", order.alias("_o")).orderBy("_o").limit(rows)
        sample = part if sample is None else sample.union(part)
    counts = dict(sample.groupBy("label").count().collect())
    if len(counts) < 2:
        return None
    weight = {k: sum(counts.values()) / (2 * n) for k, n in counts.items()}
    sample = sample.withColumn("weight", F.when(F.col("label") == 1.0, weight[1.0]).otherwise(weight[0.0]))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight").fit(
        VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample))


def judged(found: DataFrame, forest) -> DataFrame:
    """Findings with features, judged: probability and kept."""
    if forest is None:
        return found.withColumn("probability", F.lit(1.0)).withColumn("kept", F.lit(True))
    rows = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    return (rows.withColumn("probability", F.round(vector_to_array("probability")[1], 6)).withColumn("kept", F.col("probability") >= KEPT)
            .drop("features", "rawPrediction", "prediction"))


def scan(docs: DataFrame) -> DataFrame:
    """All findings in ``docs`` (doc_id, text): doc_id, word_index, finding, n_chars,
    probability and kept, false where the forest takes it for a false positive."""
    from callwise.llm.textbytes import checkpointed
    found = checkpointed(with_features(findings(docs)), "findings")
    return judged(found, train(labelled(found))).select(
        "doc_id", "word_index", "finding", F.length("finding").cast("long").alias("n_chars"), "probability", "kept")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in their texts replaced and n_chars renewed."""
    # findings belong to their text: documents without id, or of one id, don't mask each other's
    key, columns = F.xxhash64("text"), docs.columns
    secrets = (scan(docs.select(key.alias("doc_id"), "text")).where("kept").groupBy(F.col("doc_id").alias("_id"))
               .agg(F.array_sort(F.collect_set("finding")).alias("_secrets")))
    # longest first, so that no secret is cut by a shorter one inside it
    secrets = secrets.select("_id", F.expr("array_sort(_secrets, (a, b) -> length(b) - length(a))").alias("_secrets"))
    # a short one is masked where it stands by itself, not inside other words
    alone = r"concat(r'(?<![A-Za-z0-9])\Q', replace(s, r'\E', r'\E\\E\Q'), r'\E(?![A-Za-z0-9])')"
    text = F.expr(f"aggregate(coalesce(_secrets, array()), _doc.text, (t, s) -> if(length(s) < {SHORTEST}, regexp_replace(t, {alone}, '{MASK}'), replace(t, s, '{MASK}')))")
    new = {"text": text, "n_chars": F.when(F.col("_secrets").isNull(), F.col("_doc.n_chars")).otherwise(F.length(text)).cast("long")} if "n_chars" in columns else {"text": text}
    return (docs.select(F.struct(*columns).alias("_doc"), key.alias("_key")).join(secrets, F.col("_key") == F.col("_id"), "left")
            .select(*[new[c].alias(c) if c in new else F.col("_doc").getField(c).alias(c) for c in columns]))


def op2_forest_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
