"""Toxicity scores (operator 8): a weighted lexicon, matched by Aho-Corasick after folding look-alikes.

The lexicon is learned from labelled texts: for every folded word and for word beginnings of 4 to 6 letters, the number of
toxic and of other texts that hold it; terms that lean clearly to toxic texts get their log-odds as weight. A text's hits are
summed, exception phrases taken out, and the sum is set against the text's length; a logistic curve over both gives the score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_python, remainder, table

#: Letters of other scripts that look like a Latin letter.
LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
#: Digits and signs written for letters.
STAND_IN = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
#: Phrases whose words count for nothing when they stand together.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "sore loser rule", "pond scum")
#: Bounds: labelled rows that the lexicon and curve are fitted on; terms of the lexicon; word beginnings that are tried.
FIT_ROWS, MAX_TERMS, STEMS, LONGEST = 20_000, 4_000, (4, 5, 6), 32
#: A term is kept if so many toxic texts of the sample hold it and its log-odds reach so far, after that many standard errors are taken off.
LEAST_TEXTS, LEAST_WEIGHT, ERRORS = 6, 2.0, 2.0

_fold_table = str.maketrans(LOOK_ALIKE)
_in_word = regex.compile(r"(?<=\p{L})[0134578@$!9]+(?=\p{L})|(?<![\p{L}\d])[01345789@$](?=\p{L}{2})|(?<=\p{L}{2})[013457@$](?![\p{L}\d])")
_stand_in = str.maketrans(STAND_IN)
_word = regex.compile(r"\p{L}+").findall
_marks = regex.compile(r"\p{Mn}+|[\u00ad\u200b-\u200d\u2060\ufeff]")


def fold(text: str) -> str:
    """Lower case, compatibility forms and look-alikes undone, digits and signs inside words read as letters, no invisible marks."""
    text = text.lower()
    if not text.isascii():
        text = _marks.sub("", unicodedata.normalize("NFKD", text))
        text = unicodedata.normalize("NFC", text).translate(_fold_table)
    return _in_word.sub(lambda m: m[0].translate(_stand_in), text)


def folded_words(text: str | None) -> list[str]:
    return _word(fold(text)) if text else []


def terms_of(words) -> set[str]:
    """Each word as `word `, and its beginnings as `begin`."""
    out = {w + " " for w in words if 2 <= len(w) <= LONGEST}
    for n in STEMS:
        out.update([w[:n] for w in words if len(w) > n])
    return out


def count_terms(labelled: DataFrame) -> DataFrame:
    """(term, n_toxic, n_other): labelled texts that hold each term, added up within tasks first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, other = Counter(), Counter()

        def full():
            keys = list(toxic.keys() | other.keys())
            for at in range(0, len(keys), 20_000):
                some = keys[at : at + 20_000]
                yield pd.DataFrame({"term": some, "n_toxic": [toxic[k] for k in some], "n_other": [other[k] for k in some]})

        for frame in frames:
            for text, label in zip(frame["text"], frame["toxic"], strict=True):
                (toxic if label else other).update(terms_of(set(folded_words(text))))
                if len(toxic) + len(other) > 400_000:
                    yield from full()
                    toxic.clear(), other.clear()
        yield from full()

    return labelled.select("text", "toxic").mapInPandas(run, "term string, n_toxic long, n_other long").groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_other").alias("n_other"))


def learn_lexicon(labelled: DataFrame, max_terms: int = MAX_TERMS) -> dict[str, float]:
    """term -> weight: log-odds of toxic texts less some standard errors; at most max_terms, the surest first."""
    sizes = labelled.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("o")).first()
    if not sizes.t or not sizes.o:
        return {}
    counts = count_terms(labelled).where(F.col("n_toxic") >= LEAST_TEXTS)
    raw = F.log((F.col("n_toxic") + 0.5) / (sizes.t + 1.0)) - F.log((F.col("n_other") + 0.5) / (sizes.o + 1.0))
    error = F.sqrt(1 / (F.col("n_toxic") + 0.5) + 1 / (F.col("n_other") + 0.5))
    rows = counts.select("term", raw.alias("w"), (raw - ERRORS * error).alias("sure")).where(F.col("sure") > LEAST_WEIGHT)
    return {r.term: r.w for r in rows.orderBy(F.desc("sure"), "term").limit(max_terms).collect()}


class Matcher:
    """Aho-Corasick over ` begin` and ` word ` in the folded words joined by blanks."""

    def __init__(self, lexicon: dict[str, float], exceptions=EXCEPTIONS):
        import ahocorasick

        self.lexicon, self.size = lexicon, 0
        auto = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            auto.add_word(" " + term, (term, weight))
            self.size += 1
        for phrase in exceptions:
            auto.add_word(" " + " ".join(folded_words(phrase)) + " ", (phrase, None))
            self.size += 1
        if self.size:
            auto.make_automaton()
        self.auto = auto

    def hits(self, words: list[str]) -> list[tuple[int, str, float]]:
        """(start, term, weight): the heaviest term at each word, without those inside an exception phrase."""
        if not words or not self.size:
            return []
        best: dict[int, tuple[float, str]] = {}
        spared: list[tuple[int, int]] = []
        for end, (term, weight) in self.auto.iter(" " + " ".join(words) + " "):
            if weight is None:
                spared.append((end - len(term) - 1, end))
                continue
            start = end - len(term)
            if start not in best or (weight, term) > best[start]:
                best[start] = (weight, term)
        return [(s, t, w) for s, (w, t) in sorted(best.items()) if not any(a <= s < b for a, b in spared)]


_matchers: dict[str, Matcher] = {}


def matcher(key: str, lexicon: dict[str, float], exceptions) -> Matcher:
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(lexicon, exceptions)
    return _matchers[key]


def features(docs: DataFrame, lexicon: dict[str, float], exceptions=EXCEPTIONS) -> DataFrame:
    """Adds n_words, hit_weight (sum of weights), heaviest, hit_density (sum by length) and hits (the matched terms, in order) to docs(.., text)."""
    sc = docs.sparkSession.sparkContext
    sent, key = sc.broadcast(lexicon), f"{hash(frozenset(lexicon.items()))}-{len(lexicon)}-{exceptions}"

    def work(texts: list) -> tuple:
        m = matcher(key, sent.value, exceptions)
        n, total, most, hits = [], [], [], []
        for text in texts:
            words = folded_words(text)
            found = m.hits(words)
            n.append(len(words))
            total.append(math.fsum(w for _, _, w in found))
            most.append(max((w for _, _, w in found), default=0.0))
            hits.append([t.strip() for _, t, _ in found])
        return n, total, most, hits, [w / math.log2(2.0 + k) for w, k in zip(total, n, strict=True)]

    return in_python(docs, ["text"], "n_words long, hit_weight double, heaviest double, hits array<string>, hit_density double", work)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> list[float]:
    """Logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(beta)), a.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(b) for b in beta]


def sample_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of about fit_rows labels at most, picked by a hash of the id; equal texts once, toxic if any is.

    Of equal ids the larger label counts. The picked labels are few by their bound, so they are what is sent to the texts.
    """
    ok = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = ok.count()
    if n > fit_rows:
        ok = ok.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(1e6 * fit_rows / n))
    texts = docs.select("doc_id", "text").join(F.broadcast(ok), "doc_id")
    return texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, exceptions=EXCEPTIONS) -> tuple[dict[str, float], list[float]]:
    """Lexicon and curve from docs(doc_id, text) and labels(doc_id, toxic), on fit_rows rows or so at most.

    A quarter of those rows, by another hash, is held back from the lexicon to fit the curve on. Without both labels the
    lexicon is empty and every score is 0.
    """
    ok = cut(sample_rows(docs, labels, fit_rows))
    part = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4))
    lexicon = learn_lexicon(ok.where(part > 0))
    if not lexicon:
        return {}, [-20.0, 0.0, 0.0, 0.0]
    rows = features(ok.where(part == 0), lexicon, exceptions).select(*_inputs(), "toxic").toPandas()  # bounded by fit_rows
    if rows["toxic"].nunique() < 2:
        return lexicon, [-4.0, 0.5, 0.5, 0.5]
    return lexicon, fit_curve(rows[["x1", "x2", "x3"]].to_numpy(float), rows["toxic"].to_numpy(float))


def _inputs() -> list:
    """What the curve sees: all hits, hits by length, and the surest hit."""
    return [F.log1p("hit_weight").alias("x1"), F.least("hit_density", F.lit(40.0)).alias("x2"), F.col("heaviest").alias("x3")]


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, exceptions=EXCEPTIONS) -> DataFrame:
    """Score every text of docs(doc_id, text, ...) with a lexicon learned from docs and labels(doc_id, toxic) together.

    Adds score (0 to 1), predicted (1 if score >= 0.5), n_words, hit_weight, heaviest, hit_density and hits. Null and empty texts have no
    hits and get the score of a text without hits. Rows are scored one by one: repeats get equal scores, other columns pass
    through, columns named like the new ones are replaced; an empty table gives an empty table, and without labels of both
    kinds every score is close to 0. Labels other than 0 and 1, nulls included, are not learned from.
    """
    lexicon, (b0, *b) = fit(docs, labels, fit_rows, exceptions)
    x = sum((F.lit(w) * c for w, c in zip(b, _inputs(), strict=True)), F.lit(b0))
    scored = features(docs.drop("score", "predicted"), lexicon, exceptions).withColumn("score", 1 / (1 + F.exp(-x)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels outside the held-out fold."""
    return table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder() != 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, training_labels(spark, sf_dir))
    return out.select("doc_id", (remainder() == 0).alias("held_out"), "score", "predicted", "n_words", "hit_weight", F.array_join(F.slice("hits", 1, 5), ",").alias("first_hits"))
