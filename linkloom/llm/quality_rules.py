"""Weak supervision over quality rules, in DataFrame functions only.

Each rule looks at a few counts of a text and votes good (+1), bad (-1) or abstains (0). Expectation-
maximisation over the histogram of vote patterns (at most 3^rules rows, so its size is bounded whatever
the corpus) estimates how often each rule is right on good and on bad texts; a text's posterior
probability of being good replaces the demand that it pass every rule.

Defined results: a null or empty text has no words, every count 0, fails the base checks and is not
kept. A null id is an ordinary row. Repeated rows are judged alike, each on its own. An empty table
gives an empty result. Columns of the input are untouched, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import materialize, spare, word_array

#: The contract's symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5
FEATURED = "__ll_f"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim", "n_stops", "n_lines")


def with_features(df: DataFrame, text: str = "text", name: str = FEATURED) -> DataFrame:
    """Adds one struct column of the counts in FEATURES. Whole texts, narrow, no shuffle."""
    _w, _l, _h, _s, _p = (spare([*df.columns, name], f"__ll_{c}") for c in "wlhsp")
    t = F.coalesce(F.col(text), F.lit(""))

    def count(chars: str) -> Column:
        return F.length(t) - F.length(F.translate(t, chars, ""))

    df = df.withColumns({_w: word_array(F.col(text)), _l: F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)})
    n = F.size(_w)

    def at(i: Column) -> list[Column]:
        return [F.get(_w, i - 1), F.get(_w, i), F.get(_w, i + 1)]

    empty = F.array().cast("array<bigint>")
    df = df.withColumn(_h, F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(*at(i)))).otherwise(empty))
    # Only where two hashes agree are the windows themselves sorted and compared.
    windows = F.sort_array(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("t"), (i - 1).alias("p"))))
    df = df.withColumn(_s, F.when((n >= 3) & (F.size(_h) > F.size(F.array_distinct(_h))), windows))
    same = lambda x, i: (x["t"] == F.get(_s, i - 1)["t"]) | (x["t"] == F.get(_s, i + 1)["t"])
    df = df.withColumn(_p, F.when(F.isnotnull(_s), F.sort_array(F.transform(F.filter(_s, same), lambda x: x["p"]))))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(_p, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    values = {
        "n_words": n,
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
        "n_symbols": count(SYMBOLS),
        "n_dup_lines": F.size(_l) - F.size(F.array_distinct(_l)),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_exclaim": count("!"),
        "n_stops": count(".?"),
        "n_lines": F.size(_l),
    }
    struct = F.struct(*(values[k].cast("long").alias(k) for k in FEATURES))
    return df.withColumn(name, struct).drop(_w, _l, _h, _s, _p)


def rule_votes(f: Column) -> dict[str, Column]:
    """The rules: name to a vote of +1, -1 or 0 from the struct of counts."""
    n = F.greatest(f["n_words"], F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(f["n_words"] == 0, -1).when(bad, -1).when(good, 1).otherwise(0)

    mean = f["word_chars"] / n
    return {
        "length": vote(f["n_words"] >= 80, f["n_words"] < MIN_WORDS),
        "word_length": vote(mean.between(3, 10), ~mean.between(2, 16)),
        "symbols": vote(20 * f["n_symbols"] <= n, 5 * f["n_symbols"] > n),
        "lines": vote((f["n_dup_lines"] == 0) & (f["n_lines"] > 1), 10 * f["n_dup_lines"] > 3 * f["n_lines"]),
        "repeats": vote(10 * f["n_repeat_words"] <= n, 3 * f["n_repeat_words"] > n),
        "capitals": vote(10 * f["n_upper"] <= f["word_chars"], 10 * f["n_upper"] > 4 * f["word_chars"]),
        "shouting": vote(20 * f["n_exclaim"] <= n, 4 * f["n_exclaim"] > n),
        "sentences": vote((f["n_stops"] * 100).between(n, 40 * n), f["n_stops"] == 0),
    }


@dataclass(frozen=True)
class RuleModel:
    """Share of good texts; for each rule, how often its vote is right on good and on bad texts."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self, votes: list) -> float:
        return 1 / (1 + math.exp(-self._log_odds(votes)))

    def _log_odds(self, votes: list) -> float:
        odds = math.log(self.prior / (1 - self.prior))
        for v, g, b in zip(votes, self.good, self.bad, strict=True):
            odds += math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) if v < 0 else 0.0
        return odds


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 40, rules: int | None = None) -> RuleModel:
    """Expectation-maximisation over (votes, count) pairs under weak beta priors.

    Accuracy on good texts stays within 0.5 to 1. That on bad texts may be lower, as each rule sees one kind
    of them only, but never below one minus the other: a vote never argues against itself.
    """
    k = rules if rules is not None else len(patterns[0][0]) if patterns else 0
    model = RuleModel(0.8, (0.9,) * k, (0.7,) * k)
    total = sum(c for _, c in patterns)
    if not total:
        return model
    weight = 0.01 * total + 1
    for _ in range(rounds):
        p = [(v, c, model.posterior(v)) for v, c in patterns]
        good, bad = [], []
        for j in range(k):
            g = [sum(c * q for v, c, q in p if v[j] == s) for s in (1, -1)]
            b = [sum(c * (1 - q) for v, c, q in p if v[j] == s) for s in (1, -1)]
            good.append(min(0.995, max(0.5, (g[0] + 9 * weight / 10) / (g[0] + g[1] + weight))))
            bad.append(min(0.995, max(0.05, 1 - good[-1], (b[1] + 7 * weight / 10) / (b[0] + b[1] + weight))))
        prior = (sum(c * q for _, c, q in p) + 0.8 * weight) / (total + weight)
        model = RuleModel(min(0.98, max(0.2, prior)), tuple(good), tuple(bad))
    return model


def fit_on(featured: DataFrame, f: str = FEATURED) -> RuleModel:
    """Fits on all rows of a table with the struct of counts."""
    votes = rule_votes(F.col(f))
    rows = featured.groupBy(*(v.alias(k) for k, v in votes.items())).count().collect()  # at most 3^8 rows
    return fit(sorted((tuple(r)[:-1], r["count"]) for r in rows), rules=len(votes))


def posterior_column(f: Column, model: RuleModel) -> Column:
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for v, g, b in zip(rule_votes(f).values(), model.good, model.bad, strict=True):
        odds = odds + F.when(v > 0, math.log(g / (1 - b))).when(v < 0, math.log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, the counts, base_failed, posterior, kept."""
    featured = materialize(with_features(docs.select(key, text), text).select(F.col(key), FEATURED), "rules")
    f = F.col(FEATURED)
    posterior = posterior_column(f, fit_on(featured))
    out = featured.select(key, f"{FEATURED}.*", base_failed(f).alias("base_failed"), posterior.alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_AT))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with docs' columns.

    The counts are written beside the rows: a filter straight on with_features would have the optimizer
    put the counts' whole expressions in place of each use in the rules, which grows without end.
    """
    name = spare(docs.columns, FEATURED)
    featured = materialize(with_features(docs, text, name), "rules")
    f = F.col(name)
    posterior = posterior_column(f, fit_on(featured, name))
    return featured.where(~base_failed(f) & (posterior >= KEEP_AT)).select(*(F.col(f"`{c}`") for c in docs.columns))
