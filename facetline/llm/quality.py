"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies, the posterior decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facetline.llm.common import binary, bounded, by_batch, hash_words, read, windows
from facetline.session import Scratch

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_letters bigint, n_upper bigint, n_marks bigint"
NAMES = [x.split()[0] for x in STATS.split(", ")]

#: Each rule: name, when it votes bad, when it votes good; else it abstains. SQL over the statistics; fixed values.
#: A rule that looks for one fault abstains where it finds none: that says little of the others' faults.
RULES = [
    ("length", "n_words < 20", "false"),
    ("symbols", "50 * n_symbols > word_chars", "false"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words", "false"),
    ("lines", "n_dup_lines >= 3 and 3 * n_dup_lines > n_lines", "false"),
    ("repeats", "10 * n_repeat_words > 3 * n_words", "false"),
    ("capitals", "2 * n_upper > n_letters and n_letters > 0", "false"),
    ("marks", "4 * n_marks > n_words and n_words > 0", "false"),
    ("prose", "false", "n_words >= 20 and 200 * n_symbols <= word_chars and 4 * n_upper <= n_letters and 10 * n_repeat_words <= n_words"),
]
#: Prior rates of voting bad, abstaining and voting good, in bad and in good texts, for rules that vote bad only and for
#: rules that vote good only; they count as STRENGTH of the rows.
PRIOR = {"bad": np.array([[0.25, 0.749, 0.001], [0.01, 0.989, 0.001]]), "good": np.array([[0.001, 0.899, 0.1], [0.001, 0.299, 0.7]])}
STRENGTH = 0.2


def repeated(h: np.ndarray) -> int:
    """Of a text's words (hashes), how many lie in three-word windows that the text has more than once."""
    if len(h) <= 3:
        return 0
    w = windows(h, 3)
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    hit = twice[np.minimum(np.searchsorted(twice, w), len(twice) - 1)] == w
    cover = np.zeros(len(h), bool)
    for j in range(3):
        cover[j : j + len(w)] |= hit
    return int(cover.sum())


def measure(col: pa.Array) -> list[pa.Array]:
    """The statistics of all texts, in the order of STATS."""
    h, at = hash_words(col)
    rows = []
    for raw, i, j in zip(binary(col), at, at[1:], strict=False):
        text = raw.decode("utf-8", "replace")
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        a = np.frombuffer(raw, np.uint8)
        letters = a | np.uint8(32)
        n_letters = int(((letters >= 97) & (letters <= 122)).sum())
        n_upper = int(((a >= 65) & (a <= 90)).sum())
        word_chars = len(text) - sum(text.count(c) for c in SPACES)
        rows.append((int(j - i), word_chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated(h[i:j]), len(lines), n_letters, n_upper, text.count("!") + text.count("?")))
    return [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(NAMES))]


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns to keep and STATS for every row; a null text has no words. One narrow pass."""
    slim = docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *measure(b.column(len(keep)))], names=[*keep, *NAMES])

    return by_batch(slim, fn, StructType(slim.schema.fields[:-1] + StructType.fromDDL(STATS).fields))


def votes() -> list:
    """One column per rule: 0 bad, 2 good, 1 abstains."""
    return [F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1).cast("int").alias(name) for name, bad, good in RULES]


def fit(patterns: np.ndarray, counts: np.ndarray, kinds: list[str], rounds: int = 200) -> np.ndarray:
    """Posterior probability of good for each vote pattern: expectation-maximisation of a two-class model whose rules are
    independent given the class and each have their own rates of voting bad, abstaining and voting good.

    kinds: of each rule, "bad" or "good" by what it can vote. PRIOR says which class is which and keeps a rule that fires rarely from being explained away; its weight is a share
    of the rows, so that results do not depend on the number of rows.
    """
    if not len(patterns):
        return np.zeros(0)
    share = counts / counts.sum()
    before = np.stack([PRIOR[k] for k in kinds], 1)
    rates = before.copy()
    prior, post = np.array([0.1, 0.9]), None
    for _ in range(rounds):
        logs = np.log(prior)[:, None] + sum(np.log(rates[:, r])[:, patterns[:, r]] for r in range(patterns.shape[1]))
        old, post = post, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if old is not None and np.abs(post - old).max() < 1e-9:
            break
        for k, w in enumerate((share * (1 - post), share * post)):
            prior[k] = (w.sum() + STRENGTH * (0.1, 0.9)[k]) / (1 + STRENGTH)
            for r in range(patterns.shape[1]):
                per = np.bincount(patterns[:, r], weights=w, minlength=3) + STRENGTH * before[k, r]
                rates[k, r] = per / per.sum()
    return post


VOTES = [f"vote_{name}" for name, _, _ in RULES]


def with_votes(stats: DataFrame) -> DataFrame:
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed")
    return stats.select("*", base, *[v.alias(n) for v, n in zip(votes(), VOTES, strict=True)])


def posteriors(voted: DataFrame) -> DataFrame:
    """(votes, posterior) for each pattern of votes that occurs: at most 3 to the number of rules rows."""
    rows = voted.groupBy(*VOTES).count().collect()
    patterns = np.array([[r[c] for c in VOTES] for r in rows], np.int64).reshape(-1, len(VOTES))
    post = fit(patterns, np.array([r["count"] for r in rows], float), ["good" if bad == "false" else "bad" for _, bad, _ in RULES])
    table = [(*map(int, p), float(x)) for p, x in zip(patterns, post, strict=True)]
    return voted.sparkSession.createDataFrame(table, ", ".join(f"{c} int" for c in VOTES) + ", posterior double")


def judged(voted: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    out = voted.join(F.broadcast(table), VOTES, "left")  # at most 3 ** len(RULES) rows
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def judge(docs: DataFrame, keep: list[str], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns to keep, STATS, base_failed, each rule's vote, posterior and kept, one row per row of docs.

    base_failed: under 50 words, or over half of them in repeated three-word windows. kept: not base_failed and the
    posterior reaches the threshold. Nulls, empty texts: no words, so base_failed. Repeated rows are judged alike. The
    driver sees counts of vote patterns only; so does the join that gives posteriors.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    inner = [f"__k{i}" for i in range(len(keep))]
    slim = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(keep, inner, strict=True)], F.col(f"`{text}`").alias("__t"))
    voted = scratch.cut(with_votes(statistics(slim, inner, "__t")))
    out = judged(voted, posteriors(voted), threshold)
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, keep, strict=True)], *NAMES, "base_failed", *VOTES, "posterior", "kept")


def filter_documents(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns. Two narrow passes: votes are counted, then rows judged.
    Only the text goes to Python, once a pass, and only numbers come back: whole rows stay where they are."""
    bounded(docs.sparkSession)
    inner = [f"__k{i}" for i in range(len(docs.columns))]
    flat = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(docs.columns, inner, strict=True)])
    t = inner[docs.columns.index(text)]
    table = posteriors(with_votes(statistics(flat, [], t)))

    @F.arrow_udf(STATS)
    def measured(col: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(measure(col), names=NAMES)

    once = measured.asNondeterministic()  # else filters on its result would be pushed below it, with a second call
    rows = flat.withColumn("__s", once(F.col(t).cast("string"))).select(*inner, *[F.col(f"__s.{n}").alias(n) for n in NAMES])
    out = judged(with_votes(rows), table, threshold).where("kept")
    return out.select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True)])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), ["doc_id"])
