"""Weak supervision of text quality.

Eleven rules look at whole texts. Each votes good, bad, or abstains between the two, and each defect is seen
by two rules at least, whose agreement is what the estimate rests on. Expectation-maximisation over the table
of vote patterns (3**11 rows at most, some hundreds in practice, whatever the corpus) estimates how often
each rule is right about good texts, how often it is right about bad ones, and the share of good texts; the
posterior probability that a text is good then decides, in place of demanding that every rule passes. A
rule that speaks against as many good texts as bad ones so loses its weight; one that is seldom wrong
outweighs many others that see nothing.

What EM starts from (each rule right about 98 in 100 good texts and 30 in 100 bad ones, four texts in five
good) weighs as much as ``weight`` texts, whatever the corpus, and data outgrow it. Two limits keep the
classes from swapping: a rule's bad vote never speaks for a text, and no rate reaches 0 or 1 (0.001).

Texts are measured once; the counts are written down with the documents' columns, patterns are counted with
partial sums, and the posterior is attached from a broadcast table (of the bounded size above). No text is
shuffled.

Defined cases: a null or empty text has no words, so all counts are 0, the length rule votes bad, rules about
shares abstain, and ``base_failed`` is true. Very long texts are measured whole. Equal rows give equal results.
An empty table gives an empty result. Other columns pass through untouched, whatever their names; the operator
adds one struct column whose name the caller picks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import encoded, give_back, holding, structs, written

BAD, ABSTAIN, GOOD = 0, 1, 2

FEATURES = pa.struct(
    [
        (n, pa.int64())
        for n in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper", "n_letters", "n_alpha_words", "n_ended_lines", "n_marks", "n_distinct",
        )
    ]
)
FEATURES_DDL = "struct<" + ",".join(f"{f.name}:bigint" for f in FEATURES) + ">"

_ASCII_LOWER = bytes(range(97, 123))
_ASCII_UPPER = bytes(range(65, 91))
_NON_LETTERS = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))
_ENDS = (b".", b"!", b"?", b":", b";", b'"', b")", "…".encode(), "»".encode(), "”".encode())


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """How many words lie in a window of ``width`` words that the text has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    size = len(ids)
    if size == n:
        return 0
    key = seq[: n - width + 1].copy()
    top = size
    for k in range(1, width):
        if top > (1 << 62) // size:  # ranks keep the key within 63 bits
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            top = int(key.max()) + 1
        key = key * size + seq[k : n - width + 1 + k]
        top *= size
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = counts[inverse] >= 2
    if not starts.any():
        return 0
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= starts
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts named in FEATURES. Words are runs without ASCII white space."""
    b = encoded(text)
    if not b:
        return (0,) * len(FEATURES)
    words = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    n_bytes = sum(map(len, words))
    letters = b.translate(None, _NON_LETTERS)
    wide = len(letters.translate(None, _ASCII_LOWER + _ASCII_UPPER))
    if wide:  # other alphabets: count by code point
        upper = sum(map(str.isupper, text))
        n_letters = sum(map(str.isalpha, text))
    else:
        n_letters = len(letters)
        upper = len(letters.translate(None, _ASCII_LOWER))
    return (
        len(words),
        len(text) - (len(b) - n_bytes),
        len(b) - len(b.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        n_letters,
        sum(1 for w in words if not w.translate(None, _NON_LETTERS) == b""),
        sum(1 for x in lines if x.rstrip().endswith(_ENDS)),
        b.count(b"!") + b.count(b"?"),
        len(set(words)),
    )


def _features(text: pa.Array) -> pa.Array:
    holding("quality rules")
    rows = [measure(x.as_py()) for x in text]
    out = structs(FEATURES, list(zip(*rows, strict=True)) if rows else [[]] * len(FEATURES))
    give_back()
    return out


def features(text: Column) -> Column:
    return F.arrow_udf(_features, FEATURES_DDL)(text)


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are SQL conditions on the features; neither: the rule abstains."""

    name: str
    bad: str
    good: str


#: The conditions multiply instead of dividing, so that zero words or lines need no guard.
RULES = (
    Rule("length", "n_words < 50", "n_words >= 100"),
    Rule("word_length", "10 * word_chars < 25 * n_words OR word_chars > 14 * n_words", "n_words > 0 AND word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    Rule("symbols_by_word", "10 * n_symbols > n_words", "n_words > 0 AND 50 * n_symbols <= n_words"),
    Rule("symbols_by_letter", "100 * n_symbols > 8 * n_letters", "n_letters > 0 AND 100 * n_symbols <= n_letters"),
    Rule("alpha_words", "10 * n_alpha_words < 7 * n_words", "n_words > 0 AND 10 * n_alpha_words >= 9 * n_words"),
    Rule("upper", "10 * n_upper > 4 * n_letters", "n_letters > 0 AND 10 * n_upper <= 2 * n_letters"),
    Rule("marks", "10 * n_marks > 2 * n_words", "n_words > 0 AND 20 * n_marks <= n_words"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "n_words > 0 AND 100 * n_repeat_words <= 10 * n_words"),
    Rule("distinct", "100 * n_distinct < 25 * n_words", "n_words > 0 AND 100 * n_distinct >= 40 * n_words"),
    Rule("dup_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines >= 2"),
    Rule("ended_lines", "10 * n_ended_lines < 2 * n_lines", "n_lines > 0 AND 10 * n_ended_lines >= 6 * n_lines"),
)


def pattern(measured: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """The votes as one number, a digit of base 3 for each rule."""
    names = [f.name for f in FEATURES]
    total = F.lit(0)
    for k, rule in enumerate(rules):
        bad, good = (_on(measured, cond, names) for cond in (rule.bad, rule.good))
        total = total + (F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)) * (3**k)
    return total.cast("int")


def _on(measured: str, condition: str, names: list[str]) -> Column:
    for n in names:
        condition = condition.replace(n, f"`{measured}`.`{n}`")
    return F.expr(condition)


#: What EM starts from: shares of good texts that a rule calls good, of bad ones that it calls bad, and of good texts.
START_GOOD, START_BAD, START_PRIOR = 0.98, 0.3, 0.8


@dataclass(frozen=True)
class Model:
    """on_good, on_bad: by rule, of the good (bad) texts that it votes on, the share that it gets right."""

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]
    posterior: dict[int, float]


def posteriors(votes: np.ndarray, prior: float, on_good: np.ndarray, on_bad: np.ndarray) -> np.ndarray:
    """The chance of a good text, of votes (-1, 0, 1) that are independent given the class."""
    logit = math.log(prior / (1 - prior)) + (votes > 0) @ np.log(on_good / (1 - on_bad)) + (votes < 0) @ np.log((1 - on_good) / on_bad)
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(counts: dict[int, int], n_rules: int, rounds: int = 200, weight: float = 100.0, edge: float = 0.001) -> Model:
    """EM over vote patterns and how many texts have each; abstentions tell nothing."""
    on_good, on_bad, prior = np.full(n_rules, START_GOOD), np.full(n_rules, START_BAD), START_PRIOR
    if not counts:
        return Model(prior, tuple(on_good.tolist()), tuple(on_bad.tolist()), {})
    keys = np.array(sorted(counts))
    n = np.array([counts[int(k)] for k in keys], float)
    votes = (keys[:, None] // 3 ** np.arange(n_rules)) % 3 - 1
    for _ in range(rounds):
        good = posteriors(votes, prior, on_good, on_bad)
        in_good, in_bad = n * good, n * (1 - good)
        on_good = np.clip(((votes > 0).T @ in_good + START_GOOD * weight) / ((votes != 0).T @ in_good + weight), edge, 1 - edge)
        on_bad = ((votes < 0).T @ in_bad + START_BAD * weight) / ((votes != 0).T @ in_bad + weight)
        on_bad = np.clip(on_bad, np.maximum(edge, 1 - on_good), 1 - edge)
        prior = float(np.clip((in_good.sum() + START_PRIOR * weight) / (n.sum() + weight), edge, 1 - edge))
    good = posteriors(votes, prior, on_good, on_bad)
    return Model(prior, tuple(on_good.tolist()), tuple(on_bad.tolist()), {int(k): float(p) for k, p in zip(keys, good, strict=True)})


def measured(docs: DataFrame, text_col: str = "text", out: str = "__quality", rules: tuple[Rule, ...] = RULES, columns: list[str] | None = None) -> DataFrame:
    """The documents (with these columns of theirs) with a struct ``out`` of the features and the pattern of
    votes, as a table: texts are gone through once."""
    own = [F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)]
    with_features = docs.select(*own, features(F.col(f"`{text_col}`")).alias(out))
    return written(with_features.withColumn(out, F.col(f"`{out}`").withField("pattern", pattern(out, rules))), "quality-features")


def learn(table: DataFrame, out: str = "__quality", rules: tuple[Rule, ...] = RULES) -> Model:
    """From what ``measured`` has written; at most 3**len(rules) rows reach the driver."""
    counted = table.groupBy(F.col(f"`{out}`.pattern").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return fit({r["p"]: r["n"] for r in counted.collect()}, len(rules))


def score(table: DataFrame, model: Model, out: str = "__quality") -> DataFrame:
    """What ``measured`` has written, with ``posterior``, ``base_failed`` and ``kept`` in struct ``out``."""
    spark = table.sparkSession
    # as an Arrow table, which takes no Python workers of another kind
    known = spark.createDataFrame(pa.table({f"{out}_p": pa.array(model.posterior, pa.int32()), f"{out}_post": pa.array(model.posterior.values(), pa.float64())}))
    f = f"`{out}`"
    failed = F.expr(f"{f}.n_words < 50 OR 100 * {f}.n_repeat_words > 50 * {f}.n_words")
    posterior = F.coalesce(F.col(f"{out}_post"), F.lit(model.prior))
    return (
        table.withColumn(f"{out}_p", F.expr(f"{f}.pattern"))
        .join(F.broadcast(known), f"{out}_p", "left")
        .withColumn(out, F.col(f).withField("posterior", posterior).withField("base_failed", failed).withField("kept", ~failed & (posterior >= 0.5)))
        .drop(f"{out}_p", f"{out}_post")
    )


def quality_rules(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The documents (with these columns of theirs) with a struct ``__quality`` of what the rules measured and
    decided."""
    table = measured(docs, text_col, columns=columns)
    return score(table, learn(table))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    return quality_rules(docs, text_col).where(F.col("__quality.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
