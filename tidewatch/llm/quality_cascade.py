"""Quality rules as a short-circuit cascade, JVM expressions only.

A rule is a Boolean expression over the text that says when to reject.  Cost (seconds) and
selectivity (share rejected) of every rule are measured on a sample of about
``sample_rows`` documents chosen by the hash of their id; rules then run in the order of
rejections per second, and a document that one rule rejects is not shown to the next.  The
verdict is the same in any order, so the sample decides about speed only.

Null texts count as empty.  Empty tables give empty results.  Every row is judged by
itself, so repeated rows get equal verdicts; other columns are passed on.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import SPACES, UPPER, LOWER, words_of
from tidewatch.session import stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``rejects`` judges a text; ``counted``, where given, says the same about columns that ``counts`` has already made."""

    name: str
    rejects: Callable[[Column], Column]
    counted: Callable[[dict[str, Column]], Column] | None = None


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with value evaluated once: lambda bodies share no subexpressions."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _tail(a: Column, k: int) -> Column:
    return F.slice(a, k + 1, F.array_size(a))


def _chain(a: Column, k: int) -> Column:
    return F.zip_with(a, _tail(a, k), lambda x, y: F.xxhash64(x, y))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice: sort (hash, position), keep equal neighbours, add up the gaps."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(p: Column) -> Column:
        twins = F.zip_with(p, _tail(p, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda t: t.isNotNull()))))

    def total(p: Column) -> Column:
        gaps = F.zip_with(p, _tail(p, 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    return let(let(pairs, positions), total)


def repeat_words(words: Column) -> Column:
    """Words of the array that lie in 8-word windows found twice or more (windows compared by 64-bit hash)."""

    def of(windows: Column) -> Column:
        return F.when(F.array_size(F.array_distinct(windows)) == F.array_size(windows), F.lit(0)).otherwise(_covered(windows))

    def hashed(h: Column) -> Column:
        eight = let(let(_chain(h, 1), lambda a: _chain(a, 2)), lambda b: _chain(b, 4))
        return let(F.slice(eight, 1, F.array_size(h) - (WINDOW - 1)), of)

    enough = F.array_size(words) >= WINDOW
    return F.when(enough, let(F.transform(words, lambda w: F.xxhash64(w)), hashed)).otherwise(F.lit(0)).cast("long")


def word_stats(text: Column) -> Column:
    """struct(n_words, n_repeat_words); the words are split once."""
    return let(words_of(text), lambda w: F.struct(F.array_size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def n_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(SPACES)) != "")


def line_stats(text: Column) -> Column:
    """struct(n_lines, n_dup_lines) of the lines that have a word."""
    size = lambda a: F.array_size(a).cast("long")
    return let(_lines(text), lambda a: F.struct(size(a).alias("n_lines"), (size(a) - size(F.array_distinct(a))).alias("n_dup_lines")))


def counts(text: Column) -> dict[str, Column]:
    """What the report shows and rules share, each counted once: name -> column."""
    return {"w": word_stats(text), "word_chars": word_chars(text), "n_symbols": n_of(text, SYMBOLS), "lines": line_stats(text)}


#: The counts as the rules name them, over columns made by ``counts``.
COUNTED = {"n_words": "w.n_words", "n_repeat_words": "w.n_repeat_words", "word_chars": "word_chars", "n_symbols": "n_symbols",
           "n_lines": "lines.n_lines", "n_dup_lines": "lines.n_dup_lines"}


RULES = (
    Rule("few_words", lambda t: n_words(t) < 20, lambda c: c["n_words"] < 20),
    Rule("repeats", lambda t: let(word_stats(t), lambda s: 100 * s["n_repeat_words"] > 30 * s["n_words"]), lambda c: 100 * c["n_repeat_words"] > 30 * c["n_words"]),
    Rule("symbols", lambda t: 10 * n_of(t, SYMBOLS) > n_words(t), lambda c: 10 * c["n_symbols"] > c["n_words"]),
    Rule("word_length", lambda t: let(n_words(t), lambda n: (word_chars(t) > 10 * n) | (word_chars(t) < 2 * n)),
         lambda c: (c["word_chars"] > 10 * c["n_words"]) | (c["word_chars"] < 2 * c["n_words"])),
    Rule("duplicate_lines", lambda t: let(line_stats(t), lambda s: 2 * (s["n_lines"] - s["n_dup_lines"]) < s["n_lines"]),
         lambda c: 2 * (c["n_lines"] - c["n_dup_lines"]) < c["n_lines"]),
    Rule("shouting", lambda t: n_of(t, UPPER) > n_of(t, LOWER)),
    Rule("few_letters", lambda t: 2 * F.length(F.regexp_replace(t, "[^\\p{L}]+", "")) < word_chars(t)),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000) -> list[dict]:
    """Rules with their measured cost and rejected share, best first; an empty table keeps the given order."""
    n = docs.count()
    share = min(1.0, sample_rows / max(n, 1))
    picked = docs.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = stored(picked.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), "rules")
    sample.agg(F.sum(F.length("text"))).first()

    def timed(rejects: Column) -> tuple[float, float]:
        begun = time.perf_counter()
        total, hit = sample.agg(F.count(F.lit(1)), F.count_if(rejects)).first()
        return time.perf_counter() - begun, hit / max(total, 1)

    base, _ = timed(F.col("text") == "")
    found = []
    for rule in rules:
        seconds, rejected = timed(rule.rejects(F.col("text")))
        found.append({"rule": rule, "seconds": max(seconds - base, 1e-3), "rejected": rejected})
    return sorted(found, key=lambda r: -r["rejected"] / r["seconds"])


def passes(text: Column, rules: list[Rule], counted: dict[str, Column] | None = None) -> Column:
    """True if no rule rejects; the first that does ends the row's evaluation.

    With ``counted``, rules on counts cost nothing more and come first.
    """
    text = F.coalesce(text, F.lit(""))
    free = [r.counted(counted) for r in rules if counted and r.counted]
    out = F
    for reject in [*free, *(r.rejects(text) for r in rules if not (counted and r.counted))]:
        out = out.when(reject, F.lit(False))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The documents that pass every rule, all columns kept."""
    order = [r["rule"] for r in order_rules(docs, rules, id_col, text_col, sample_rows)]
    return docs.where(passes(F.col(text_col), order))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """Per document: id, the counts, base_failed and kept.

    The cascade runs over what the counts have not decided: only texts that pass those rules meet the others.
    """
    open_rules = tuple(r for r in rules if r.counted is None)
    order = [r["rule"] for r in order_rules(docs, open_rules, id_col, text_col, sample_rows)] if open_rules else []
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = texts.select("id", "text", *[c.alias(n) for n, c in counts(F.col("text")).items()])
    named = {n: F.col(c) for n, c in COUNTED.items()}
    failed = (named["n_words"] < 20) | (100 * named["n_repeat_words"] > 30 * named["n_words"])
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return made.select(
        F.col("id").alias(id_col), *[named[n].alias(n) for n in shown], failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(passes(F.col("text"), [r for r in rules if r.counted] + order, named)).alias("kept"),
    )
