"""License scans by diagonal voting.

Templates are the paragraphs of whole public license texts (the files in ``licenses``, a label in each name),
but for those that most licenses of another label share, and short notices made by rule of a license's
names. All rolling word k-grams of every document are hashed and joined by Spark with the k-grams of the
templates (some ten thousand rows, whatever the corpus, so broadcast). A hit votes for the diagonal ``document
position - template position``. Votes are gathered by document, template and diagonal; diagonals at most
``slack`` apart are merged, which bridges inserted and missing words; the span that a band of diagonals marks
is then verified: the share of the template's words that matched k-grams cover, in place, must reach
``least`` (all of them for a template of fewer than WHOLE words, as names differ by a word), and the span may
not be longer than the template allows. ``score`` is the largest share that any band
of such length covers, verified or not.

Beside the method, the plain phrases of PHRASES are counted where their words stand consecutively.

Only hits are shuffled, with sets of template positions, so a group is bounded by a template's length.

Defined cases: null and empty texts have no words, labels '' and score 0; a repeated row gets the same result
as its copies, a null id too; very long texts are scanned whole, as rows of k-grams; a license that comes many
times has a span for each; of equal shares the first spans come first. An empty table gives an empty result;
other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import ascii_words, row_key, structs

#: Phrase and label.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Label and the names a license goes by.
NAMES = {
    "apache": ("Apache License, Version 2.0", "Apache-2.0"),
    "bsd": ("BSD 2-Clause License", "BSD 3-Clause License"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "gpl": ("GNU General Public License, version 2", "GNU General Public License, version 3"),
    "isc": ("ISC License",),
    "mit": ("MIT License",),
    "mpl": ("Mozilla Public License, v. 2.0",),
}
#: What leads to a name in a notice.
LEADS = ("licensed under", "released under", "distributed under the terms of")
SHORTEST, WHOLE = 8, 12


@cache
def templates_of(k: int = 4, shared: float = 0.5) -> tuple[tuple[str, str], ...]:
    """Label and wording: notices; and paragraphs of SHORTEST words or more, without those of which other
    labels' texts have the share ``shared`` of the k-grams or more, as they tell no license apart."""
    out = [(label, f"{lead} {the}{name}") for label, names in NAMES.items() for name in names for lead in LEADS for the in ("", "the ")]
    texts = [(p.name.partition(".")[0], p.read_text()) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    kept = [(label, part, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))) for label, x in texts for part in x.split("\n\n") if len(w := ascii_words(part)) >= SHORTEST]
    owners: dict[tuple, set[str]] = {}
    for label, _, own in kept:
        for g in own:
            owners.setdefault(g, set()).add(label)
    seen = set()
    for label, part, own in kept:
        wording = " ".join(part.split())
        if sum(len(owners[g]) > 1 for g in own) < shared * len(own) and (label, wording.lower()) not in seen:
            seen.add((label, wording.lower()))
            out.append((label, wording))
    return tuple(out)


BASE = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("labels", pa.list_(pa.string()))])
BASE_DDL = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,labels:array<string>>"
_PHRASES = [(p.encode().split(), label) for p, label in PHRASES.items()]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def places(words: list[bytes]) -> tuple[list[int], list[str]]:
    """Starts of all phrases' places, and the labels of those found."""
    starts, labels = [], set()
    for phrase, label in _PHRASES:
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(phrase)] == phrase:
                starts.append(at)
                labels.add(label)
    return starts, sorted(labels)


def _base(text: pa.Array) -> pa.Array:
    rows = []
    for x in text:
        words = ascii_words(x.as_py())
        starts, labels = places(words)
        rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), labels))
    return structs(BASE, list(zip(*rows, strict=True)) if rows else [[]] * len(BASE))


def base(text: Column) -> Column:
    return F.arrow_udf(_base, BASE_DDL)(text)


class Hashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 400_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def grams(words: list[bytes], k: int, hashes: Hashes) -> np.ndarray:
    """A 64-bit hash for each k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = hashes(words)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * _BASE + h[j : j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out.view(np.int64)


_hashes = Hashes()


def rolling(text: Column, k: int) -> Column:
    def run(column: pa.Array) -> pa.Array:
        parts = [grams(ascii_words(x.as_py()), k, _hashes) for x in column]
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))

    return F.arrow_udf(run, "array<bigint>")(text)


def template_rows(k: int, templates: tuple[tuple[str, str], ...]) -> Iterator[tuple[int, int, int]]:
    """(hash, template, position) of every k-gram of every template."""
    for t, (_, wording) in enumerate(templates):
        for at, h in enumerate(grams(ascii_words(wording), k, Hashes()).tolist()):
            yield h, t, at


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "__license", k: int = 4, slack: int = 3, least: float = 0.6, templates: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """Adds struct ``out``: the base's fields, ``found`` (labels of the method), ``score`` and ``spans``
    (first word, end, label, share of the template covered) that are verified."""
    spark = docs.sparkSession
    templates = templates_of(k) if templates is None else templates
    table = spark.createDataFrame(list(template_rows(k, templates)), "g bigint, t int, tpos int")
    sizes = [len(ascii_words(w)) for _, w in templates]
    names = spark.createDataFrame([(t, label, n, 1.0 if n < WHOLE else least) for t, ((label, _), n) in enumerate(zip(templates, sizes, strict=True))], "t int, label string, size int, least double")
    key, text = f"{out}_key", F.col(f"`{text_col}`")
    # equal rows have equal results, and copies under different ids, however many, are dealt apart
    keyed = docs.withColumn(key, row_key(F.col(f"`{id_col}`"), text))
    rolled = keyed.select(F.col(key).alias("d"), F.posexplode(rolling(text, k)).alias("pos", "g"))
    votes = (
        rolled.join(F.broadcast(table), "g")
        .groupBy("d", "t", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.collect_set("tpos").alias("at"))
    )
    own = Window.partitionBy("d", "t").orderBy("diagonal")
    share = F.col("words") / F.col("size")
    band = (
        votes.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(own) <= slack, 0).otherwise(1))
        .withColumn("band", F.sum("new").over(own))
        .groupBy("d", "t", "band")
        .agg(
            F.min(F.col("diagonal") + F.array_min("at")).alias("first"),
            (F.max(F.col("diagonal") + F.array_max("at")) + k).alias("end"),
            F.size(F.array_distinct(F.flatten(F.collect_list(F.flatten(F.transform("at", lambda x: F.sequence(x, x + k - 1))))))).alias("words"),
        )
        .join(F.broadcast(names), "t")
        .where(F.col("end") - F.col("first") <= 2 * F.col("size") + slack)
        .withColumn("share", share)
    )
    verified = F.when(F.col("share") >= F.col("least"), F.struct("first", "end", "label", "share"))
    found = band.groupBy("d").agg(F.array_sort(F.collect_set(F.when(F.col("share") >= F.col("least"), F.col("label")))).alias("found"), F.max("share").alias("share"), F.array_sort(F.collect_list(verified)).alias("spans"))
    found = found.select(F.col("d").alias(key), F.struct("found", "share", "spans").alias(f"{out}_f"))
    got = F.col(f"{out}_f")
    return (
        keyed.withColumn(out, base(text))
        .join(found, key, "left")
        .withColumn(
            out,
            F.col(out)
            .withField("found", F.coalesce(got["found"], F.array().cast("array<string>")))
            .withField("score", F.coalesce(got["share"], F.lit(0.0)))
            .withField("spans", F.coalesce(got["spans"], F.array().cast("array<struct<first:int,end:int,label:string,share:double>>"))),
        )
        .drop(key, f"{out}_f")
    )
