"""Secret scan with a random forest that removes false positives; JVM expressions and MLlib only.

A candidate is a run of at least ``min_length`` key-like characters in a word, or of ``SHORT`` where
the words or names before give a hint and the run is assigned or holds a digit.  ``=`` and ``:`` end a name, every run
of a word counts, and ``run`` numbers them.  Its features are
length, share of digits, capitals and symbols, switches between character classes, mean
log-probability of its character transitions under the corpus, coverage by dictionary words
(words that at least ``min_count`` places of the corpus use), what the two words before and
the word after say, and the path (``path_col``) that the text comes from, hashed.  Dictionary
and transitions are counted over all texts, words first, so that each shuffled row
stands for all uses of a word in a task.

The forest learns from labelled findings (id, pos, label, and run where it is given), at most ``max_labelled`` of
them, the first by a hash.  Where these don't hold both labels there is nothing to learn:
probability is null and every candidate stays a finding.

Null and empty texts have no candidates.  Repeated rows give equal findings; rows that
share an id but not the text are told apart by the text's hash.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import words_of
from tidewatch.llm.quality_cascade import let
from tidewatch.session import stored

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
SIDE = len(ALPHABET) + 1
HINTS = "(?i)(token|secret|key|passw|pwd|auth|api|credential|bearer|private)"
SHORT = 4
ASSIGNED = "[=:]>?\\s*[\"'`]*$"
NAMES = ("length", "digits", "capitals", "symbols", "switches", "transitions", "dictionary", "hint", "assigned", "quoted", "before", "after", "path")


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None, min_length: int) -> DataFrame:
    """Rows (id, sig, pos, run, value, word, before, w1, next, path): one per key-like run; before is what stands before it."""
    least, key = min(SHORT, min_length), "[A-Za-z0-9+/_.@-]"
    run = f"(?s)\\G(.*?)({key}{{{least},}}(?:={{1,2}}(?!{key}|=))?)"  # what lies between, and the run

    def near(w: Column) -> Column:
        hinted = lambda i: F.concat_ws(" ", F.get(w, i - 2), F.get(w, i - 1), F.get(w, i)).rlike(HINTS)
        long = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("word"), i.alias("pos"))),
                        lambda s: (F.length(s["word"]) >= min_length) | ((F.length(s["word"]) >= least) & hinted(s["pos"])))
        return F.transform(long, lambda s: F.struct(
            s["word"].alias("word"), s["pos"].cast("long").alias("pos"), F.get(w, s["pos"] - 1).alias("w1"), F.get(w, s["pos"] - 2).alias("w2"),
            F.get(w, s["pos"] + 1).alias("next")))

    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("sig"), path.alias("path"), F.explode(let(words_of(F.col(text_col)), near)).alias("c"))
    found = found.select("id", "sig", "path", "c.*")
    runs = F.arrays_zip(F.regexp_extract_all("word", F.lit(run), 1).alias("gap"), F.regexp_extract_all("word", F.lit(run), 2).alias("value"))
    said = let(runs, lambda r: F.transform(r, lambda x, i: F.struct(
        i.cast("long").alias("run"), x["value"].alias("value"), F.concat(F.coalesce(F.get(r, i - 1)["value"], F.lit("")), x["gap"]).alias("lead"))))
    found = found.withColumn("r", F.explode(said)).select("id", "sig", "pos", "r.run", "r.value", "word", "w1", "next", "path",
        F.concat_ws(" ", F.coalesce("w2", F.lit("")), F.coalesce("w1", F.lit("")), F.col("r.lead")).alias("before"))
    short = F.col("before").rlike(HINTS) & (F.col("before").rlike(ASSIGNED) | F.col("value").rlike("[0-9]"))
    return found.where((F.length("value") >= min_length) | short)


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts: lower-case runs of letters and digits between other characters."""
    word = F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^\\p{L}\\p{N}]+"))
    return docs.select(word.alias("word")).where("word != ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def transition_table(words: DataFrame) -> list[float]:
    """log10 probability of the second character after the first, SIDE x SIDE (1,369 numbers), add-one smoothed."""
    spelt = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), lambda i: F.substring("word", i, 2))).alias("g"))
    cell = F.instr(F.lit(ALPHABET), F.substring("g", 1, 1)) * SIDE + F.instr(F.lit(ALPHABET), F.substring("g", 2, 1))
    got = {r["cell"]: r["n"] for r in spelt.where(F.length("g") == 2).groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")).collect()}
    out = []
    for a in range(SIDE):
        total = sum(got.get(a * SIDE + b, 0) for b in range(SIDE)) + SIDE
        out += [math.log10((got.get(a * SIDE + b, 0) + 1) / total) for b in range(SIDE)]
    return out


def _transitions(value: Column, table: list[float]) -> Column:
    cells = F.array(*[F.lit(x) for x in table])

    def mean(v: Column) -> Column:
        at = lambda i: F.instr(F.lit(ALPHABET), F.substring(v, i, 1))
        steps = F.transform(F.sequence(F.lit(1), F.length(v) - 1), lambda i: F.get(cells, at(i) * SIDE + at(i + 1)))
        return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (F.length(v) - 1)

    return let(F.lower(value), mean)


def _share(value: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{keep}]+", "")) / F.length(value)


def _dictionary(found: DataFrame, words: DataFrame, min_count: int) -> DataFrame:
    """(value, dictionary): share of the value's characters that lie in pieces of three letters or more which are words."""
    values = found.select("value").distinct()
    pieces = values.select("value", F.explode(F.split(F.lower("value"), "[^\\p{L}\\p{N}]+")).alias("word")).where(F.length("word") >= 3)
    known = pieces.join(words.where(F.col("n") >= min_count).select("word"), "word")
    return known.groupBy("value").agg((F.sum(F.length("word")) / F.length("value")).alias("dictionary"))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, min_length: int = 16, min_count: int = 5) -> DataFrame:
    """One row per candidate: id, sig, pos, run, value and the columns NAMES (doubles)."""
    found = stored(candidates(docs, id_col, text_col, path_col, min_length), "candidates")
    words = stored(word_counts(docs, text_col), "words")
    table = transition_table(words)
    v = F.col("value")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "l"), "[A-Z]+", "L"), "[0-9]+", "d"), "[^lLd]+", "s")
    bucket = lambda c, n: F.pmod(F.xxhash64(F.lower(F.coalesce(c, F.lit("")))), F.lit(n))
    before = F.col("before")
    made = found.select(
        "id", "sig", "pos", "run", "value", F.length(v).alias("length"), _share(v, "0-9").alias("digits"), _share(v, "A-Z").alias("capitals"),
        (1 - _share(v, "A-Za-z0-9")).alias("symbols"), ((F.length(kinds) - 1) / F.length(v)).alias("switches"), _transitions(v, table).alias("transitions"),
        before.rlike(HINTS).alias("hint"), before.rlike(ASSIGNED).alias("assigned"), F.col("word").rlike("[\"'`]").alias("quoted"),
        bucket(F.col("w1"), 16).alias("before"), bucket(F.col("next"), 16).alias("after"), bucket(F.col("path"), 32).alias("path"),
    )
    share = _dictionary(found, words, min_count)
    made = made.join(share, "value", "left").withColumn("dictionary", F.coalesce("dictionary", F.lit(0.0)))
    return made.select("id", "sig", "pos", "run", "value", *[F.col(n).cast("double").alias(n) for n in NAMES])


def scan(
    docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, min_length: int = 16,
    min_count: int = 5, max_labelled: int = 20_000, trees: int = 20, depth: int = 6, threshold: float = 0.5, label=None,
) -> DataFrame:
    """One row per candidate: id, pos, run, value, value_sha256, the features, probability, is_secret.

    ``labelled`` has (id, pos, label), with run to name one of a word's runs; or ``label`` gives the label (0, 1 or null for none) of a row of ``features``.
    """
    rows = stored(features(docs, id_col, text_col, path_col, min_length, min_count), "features")
    if label is not None:
        known = label(rows)
    else:
        run = F.col("run").cast("long") if "run" in labelled.columns else F.lit(None).cast("long")
        marks = labelled.select(F.col("id").alias("__id"), F.col("pos").alias("__pos"), run.alias("__run"), F.col("label").cast("double").alias("label")).distinct()
        same = rows["id"].eqNullSafe(marks["__id"]) & (rows["pos"] == marks["__pos"]) & (marks["__run"].isNull() | (rows["run"] == marks["__run"]))
        known = rows.join(marks, same).drop("__id", "__pos", "__run")
    known = stored(known.where("label is not null").orderBy(F.xxhash64("id", "pos", "run", "value")).limit(max_labelled), "labelled")
    out = ["id", "pos", "run", "value", F.sha2("value", 256).alias("value_sha256"), *NAMES]
    if known.select("label").distinct().count() < 2:
        scored = rows.select(*out, F.lit(None).cast("double").alias("probability"), F.lit(True).alias("is_secret"))
    else:
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        vector = VectorAssembler(inputCols=list(NAMES), outputCol="__x")
        forest = RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7)
        model = forest.fit(vector.transform(known))
        scored = model.transform(vector.transform(rows)).withColumn("probability", vector_to_array("probability")[1])
        scored = scored.select(*out, "probability", (F.col("probability") >= threshold).alias("is_secret"))
    return scored.withColumnRenamed("id", id_col)
