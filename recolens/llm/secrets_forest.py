"""Secret scan: candidate runs scored by a random forest, in native functions.

Candidates are all values assigned to a credential name, of any length and
characters, and elsewhere known key shapes and runs of 12 or more token
characters with a digit; a name and its value are apart.  Features: length, distinct characters, character-class transitions, share covered by the
corpus' frequent words (a dictionary counted over all documents), path and
address surroundings, and the neighbouring words and quotes.  The forest is
fitted with MLlib on labelled findings; its job is to remove false positives
such as numbers, identifiers and addresses.

Labelled findings may be passed in; without them a bounded sample of the
candidates is labelled by precise rules: published shapes of provider keys are
secrets wherever they stand (and have score 1), and so is an assignment to a
credential name of a mixed, dense value; placeholders there, and elsewhere bare
numbers, UUIDs, names, paths, addresses and values made of words are not.  All
others (short or plain assigned values, dense runs without an assignment) have no
label; the forest decides.

Defined results: null and empty texts have no candidate; null ids are kept;
repeated rows give repeated findings; when the labelled findings are not of
both kinds, a candidate's score is its rule label (0 where no rule speaks); an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recolens.llm.frames import LAST_ID, WORD_GAP, text_rows, unpacked, whole_rows, written

CREDENTIAL = (r"(?i:token|secret(?!ar)|passw(?:or)?d|passphrase|pwd|api.?key|access.?key|private.?key"
              r"|auth(?!or(?!i[sz])|entic(?!at))|credential|bearer)")
#: Published shapes of provider keys; dotted ones are a candidate as a whole.
KNOWN_KEY = (r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{22,}|glpat-[\w\-]{20,}"
             r"|xox[abeprs]-[A-Za-z0-9\-]{10,}|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[\w\-]{20,}"
             r"|AIza[\w\-]{35}|npm_[A-Za-z0-9]{36}|SG\.[\w\-]{16,}\.[\w\-]{16,}"
             r"|eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{8,})(?![A-Za-z0-9_\-])")
#: Credential name, sign and scheme before an assigned value (bounded, as it is looked behind for).
_SIGN, _SCHEME = r"[\"'`\]]{0,2}\s{0,3}(?:=>|[:=]?=|:)\s{0,3}", r"(?:(?i:bearer|basic)\s{1,3})?"
_NAMED = CREDENTIAL + r"[\w\-]{0,20}" + _SIGN + _SCHEME
#: Characters that end an unquoted value when nothing follows, or when , ; & start the next assignment.
_STOPS = r",;&.)\]}\"'`"
_UNQUOTED = (rf"(?!(?i:bearer|basic)\s)(?:[^\s{_STOPS}]++|[{_STOPS}]++(?!\s|$)"
             rf"(?!(?<=[,;&][\"'`]?)[\w.\-]{{1,40}}[\"'`]?\s{{0,3}}[=:][^\s=]))++")
_ASSIGNED = "|".join(rf"(?<={q})(?<={_NAMED}{q})(?:[^{q}\\\n]++|\\.)++(?={q})" for q in "\"'`")
_ASSIGNED += rf"|(?<={_NAMED}[\"'`]?)(?![\"'`]){_UNQUOTED}"
#: Cheap looks behind come first: the pattern is tried at every character.
_ASSIGNED = (r"(?<=[=:>\s\"'`])(?=\S)(?:(?<=[=:>]\s{0,3}[\"'`]?)|(?<=[cCrR]\s{1,3}[\"'`]?)(?<=" + _SCHEME[:-1]
             + rf"[\"'`]?))(?:{_ASSIGNED})")
_RUN = r"[A-Za-z0-9+/_\-]"
#: Any value assigned to a credential name; provider keys; runs of 12 or more token
#: characters with a digit, '=' only as closing padding.
CANDIDATE = (rf"{_ASSIGNED}|(?<!{_RUN})(?={_RUN})(?:{KNOWN_KEY}"
             rf"|(?=[A-Za-z+/_\-]*+[0-9]){_RUN}{{12,}}+(?:={{1,2}}(?![A-Za-z0-9+/_\-=\"'`]))?"
             rf"(?!(?<={CREDENTIAL}[\w\-]{{0,20}}){_SIGN}[^\s=]))")
#: Slashes between names of letters and a short number; slashes alone also occur in Base64.
PATH = r"^/?[A-Za-z_\-]{2,}[0-9]{0,4}(/[A-Za-z_\-]+[0-9]{0,4}|/[0-9]{1,4}){2,}/?$"
UUID = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
#: Values that stand for a secret or for none.
PLACEHOLDER = (r"(?i)^(true|false|none|null|nil|undefined|string|str|int|bool|bytes|an?|the|is|was|and|or|in|of|to|for"
               r"|\*+|x+|\.+|<.*>|\$\{?\w+\}?|\{\{.*|your\W.*)$")
#: Bounds of the training sample (findings of each kind) and of the dictionary (words).
SAMPLE_FINDINGS, DICTIONARY_WORDS = 2000, 300
#: Characters around a candidate that features look at.
CONTEXT = 64
#: Findings of documents up to this many rows (some 100 bytes each) are broadcast for redaction.
BROADCAST_ROWS = 400_000
FEATURES = ("length", "distinct_share", "digit_share", "symbol_share", "upper_share", "letter_digit", "digit_letter", "case_changes",
            "vowel_pairs", "hex_only", "covered", "path", "address", "credential", "assigned", "quoted",
            "number_before", "word_before", "word_after")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, at, start, value, before, after): candidates in order, with their
    character offset and the text around them."""
    rows = text_rows(docs)
    cut = (rows.withColumn("values", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
           .where(F.size("values") > 0).withColumn("gaps", F.split("text", CANDIDATE, -1)).drop("text"))
    lengths = F.zip_with(F.slice("gaps", 1, F.size("values")), "values", lambda g, v: F.length(g) + F.length(v))
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return (cut.withColumn("ends", ends)
            .select("doc_id", "gaps", "ends", "values", F.posexplode("values").alias("at", "value"))
            .select("doc_id", "at", "value",
                    (F.get("ends", F.col("at")) + F.length(F.get("gaps", F.col("at")))).cast("long").alias("start"),
                    F.substring(F.concat(_value(-1), F.get("gaps", F.col("at"))), -CONTEXT, CONTEXT).alias("before"),
                    F.substring(F.concat(F.get("gaps", F.col("at") + 1), _value(1)), 1, CONTEXT).alias("after")))


def _value(step: int) -> Column:
    return F.coalesce(F.get("values", F.col("at") + step), F.lit(""))


def dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS) -> str:
    """Alternation of the most frequent words of 4 to 12 letters over all documents."""
    words = (text_rows(docs).select(F.explode(F.split(F.lower("text"), WORD_GAP)).alias("w"))
             .where(F.length("w").between(4, 12)).groupBy("w").count()
             .where(F.regexp_like("w", F.lit(r"^[a-z]+$")))
             .orderBy(F.desc("count"), "w").limit(size).collect())
    return "|".join(sorted((r.w for r in words), key=lambda w: (-len(w), w)))


def _count(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)).cast("double")


def _is(column: str, pattern: str) -> Column:
    return F.regexp_like(column, F.lit(pattern)).cast("double")


def with_features(found: DataFrame, words: str) -> DataFrame:
    n = F.length("value").cast("double")
    covered = (n - F.length(F.regexp_replace(F.lower("value"), words, ""))) / n if words else F.lit(0.0)
    return found.withColumns({
        "length": n,
        "distinct_share": F.size(F.array_distinct(F.split("value", ""))) / n,
        "digit_share": _count("[0-9]") / n,
        "symbol_share": _count("[^A-Za-z0-9]") / n,
        "upper_share": _count("[A-Z]") / n,
        "letter_digit": _count("(?<=[A-Za-z])(?=[0-9])") / n,
        "digit_letter": _count("(?<=[0-9])(?=[A-Za-z])") / n,
        "case_changes": _count("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
        "vowel_pairs": _count("(?i)[aeiou][bcdfghjklmnpqrstvwxyz]") / n,
        "hex_only": _is("value", "^([0-9a-f]+|[0-9A-F]+)$"),
        "covered": covered,
        "path": F.greatest(_is("before", r"(/|\\|://[^\s?#]*)$"), _is("after", r"^\.[A-Za-z]{1,5}\b"), _is("value", PATH)),
        "address": F.greatest(_is("after", r"^(@|\.[A-Za-z0-9])"), _is("before", r"[@.]$")),
        "credential": _is("before", rf"({_NAMED}[\"'`]?|{CREDENTIAL}\W{{0,6}})$"),
        "assigned": _is("before", rf"(=>|[=:])\s*{_SCHEME}[\"'`]?$"),
        "quoted": F.greatest(_is("before", "[\"'`]$"), _is("after", "^[\"'`]")),
        "number_before": _is("before", r"[0-9)]\W{0,3}$"),
        "word_before": _is("before", r"[A-Za-z]{2,}\s$"),
        "word_after": _is("after", r"^\s[A-Za-z]{2,}"),
    })


def rule_labels(featured: DataFrame) -> DataFrame:
    """``label`` 1.0 or 0.0 where a precise rule speaks, else null."""
    named = (F.col("credential") == 1) & (F.col("assigned") == 1)
    blank = F.regexp_like("value", F.lit(PLACEHOLDER)) | ((F.col("covered") == 1) & (F.col("length") <= 12))
    secret = (named & (F.col("length") >= 8) & (F.col("distinct_share") >= 0.2) & (F.col("covered") < 0.5)
              & F.col("digit_share").between(0.01, 0.95) & ~blank)
    identifier = F.regexp_like("value", F.lit(UUID)) | F.regexp_like("after", F.lit(rf"^{_SIGN}[^\s=]"))
    number = F.regexp_like("value", F.lit(r"^[0-9+/=_\-]+$")) | (F.col("digit_share") >= 0.95)
    clean = F.when(named, blank).otherwise(
        number | identifier | (F.col("path") == 1) | (F.col("address") == 1) | (F.col("covered") >= 0.6))
    return featured.withColumn("label", F.when(secret | known_key(), 1.0).when(clean, 0.0))


def known_key() -> Column:
    """Whether the value has the published shape of a provider's key, whatever stands around it."""
    return F.regexp_like("value", F.lit(f"^{KNOWN_KEY}$"))


def scored(docs: DataFrame, findings: DataFrame | None = None, sample: int = SAMPLE_FINDINGS, trees: int = 30,
           depth: int = 6, seed: int = 11) -> DataFrame:
    """(doc_id, at, start, length, value, score, is_secret) of every candidate.

    ``findings`` are labelled ones: (doc_id, start, label 0/1)."""
    featured = rule_labels(with_features(candidates(docs), dictionary(docs)))
    if findings is not None:
        given = findings.select(F.col("doc_id").cast("long"), F.col("start").cast("long"),
                                F.col("label").cast("double").alias("given")).dropDuplicates(["doc_id", "start"])
        featured = (featured.drop("label").join(given, ["doc_id", "start"], "left")
                    .withColumnRenamed("given", "label"))
    featured = written(featured, "findings")
    kinds = [featured.where(F.col("label") == kind).orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start", "value")
             .limit(sample) for kind in (0.0, 1.0)]
    train = written(kinds[0].unionAll(kinds[1]), "findings-sample")
    if train.select("label").distinct().count() < 2:
        score = F.coalesce("label", F.lit(0.0))
        out = featured
    else:
        join = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
        ordered = train.repartition(1).sortWithinPartitions("label", "doc_id", "start", "value")
        model = forest.fit(join.transform(ordered).select("features", "label"))
        out = model.transform(join.transform(featured))
        score = vector_to_array("probability")[1]
        if findings is None:
            score = F.when(known_key(), 1.0).otherwise(score)
    return (out.withColumn("score", score)
            .select("doc_id", "at", "start", F.col("length").cast("long").alias("length"), "value", "score",
                    (F.col("score") >= 0.5).alias("is_secret")))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """All columns of ``docs``, with every secret in ``text`` replaced by ``mark``."""
    found = (scored(docs, **options).where("is_secret")
             .groupBy("doc_id", F.col("at")).agg(F.collect_set("value").alias("values"))
             .groupBy(F.coalesce("doc_id", F.lit(LAST_ID)).alias("__id"))
             .agg(F.collect_set(F.struct("at", "values")).alias("__found")))
    found = written(found, "secrets")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    values = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    gaps = F.split("text", CANDIDATE, -1)
    hit = lambda i, v: F.exists("__found", lambda f: (f["at"] == i) & F.array_contains(f["values"], v))
    marked = F.transform(values, lambda v, i: F.concat(F.get(gaps, i), F.when(hit(i, v), F.lit(mark)).otherwise(v)))
    text = F.concat(F.array_join(marked, ""), F.element_at(gaps, -1))
    rows = whole_rows(docs).join(found.withColumnRenamed("__id", "id"), "id", "left")
    return unpacked(rows, docs.columns, text=F.when(F.col("__found").isNull(), F.col("text")).otherwise(text))
