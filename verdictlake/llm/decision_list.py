"""Quality rules: learned decision lists over text statistics.

``text_statistics`` measures every whole text; ``learn_decision_list`` runs
sequential covering over labelled statistics. It grows a conjunction of thresholds
by information gain, prunes it on held-back rows, and keeps it if it is precise
enough; the rows it covers are taken away. Rules that reject are tried first; where
none is left, a rule that keeps is added, which may make others precise on what
remains. Rules that fail are discarded, and growing goes on without the rows that
led to them. The first rule of the list that holds decides, so that the list becomes
one ordered chain of Spark conditional expressions; where none holds, a row is kept.

Defined cases: a null text counts as empty (all statistics 0); rows are judged
one by one, so repeated rows give repeated results, and a labelled row that is
repeated is learned from once; an empty table gives an empty result; without usable
labels the list is empty and keeps everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, hash_edge, small_batches, stage, tidy

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
WINDOW = 5
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)

#: Ratios offered to the learner beside the counts; a zero divisor gives 0.
FEATURES = {
    "n_words": lambda s: s("n_words").cast("double"),
    "mean_word": lambda s: s("word_chars") / F.greatest(s("n_words"), F.lit(1)),
    "symbol_rate": lambda s: s("n_symbols") / F.greatest(s("n_words"), F.lit(1)),
    "dup_line_rate": lambda s: s("n_dup_lines") / F.greatest(s("n_lines"), F.lit(1)),
    "repeat_rate": lambda s: s("n_repeat_words") / F.greatest(s("n_words"), F.lit(1)),
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(window):
        x = h[j : j + n] * _MULTIPLIERS[j % 5]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (x ^ (x >> np.uint64(31)))
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics_of(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    chars = len(text.decode("utf-8", "replace")) if not text.isascii() else len(text)
    seen, dup, lines = set(), 0, text.split(b"\n") if text else []
    for line in lines:
        if line in seen:
            dup += not (not line or line.isspace())
        else:
            seen.add(line)
    return (
        len(words),
        chars - sum(map(text.count, (SPACES[i : i + 1] for i in range(6)))),
        sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))),
        dup,
        repeated_words(words),
        len(lines),
    )


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the id and ``STATS`` as longs."""
    kind = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)

    def measure(batches):
        for b in batches:
            for part in small_batches([b], "text"):
                rows = list(zip(*map(statistics_of, as_bytes(part.column(1))), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(r, pa.int64()) for r in rows)], [id_col, *STATS])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{s} bigint" for s in STATS)
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(tidy(measure), schema)


@dataclass(frozen=True)
class Rule:
    """Where all of ``tests`` (feature, '<=' or '>', threshold) hold, the row is rejected (``bad``) or kept."""

    tests: tuple[tuple[str, str, float], ...]
    bad: bool
    precision: float = 0.0
    covered: int = 0

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, t in self.tests:
            out &= x[name] <= t if op == "<=" else x[name] > t
        return out


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def kept(self, feature) -> Column:
        """The ordered conditional expression; ``feature(name)`` gives a column."""
        out = None
        for rule in self.rules:
            cond = F.lit(True)
            for name, op, t in rule.tests:
                cond = cond & (feature(name) <= F.lit(t) if op == "<=" else feature(name) > F.lit(t))
            out = F.when(cond, F.lit(not rule.bad)) if out is None else out.when(cond, F.lit(not rule.bad))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -np.inf)


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray, most_cuts: int) -> tuple[float, tuple[str, str, float] | None]:
    best, found, p0, n0 = 1e-9, None, bad.sum(), (~bad).sum()
    for name, v in x.items():
        cuts = np.unique(v)
        if len(cuts) < 2:
            continue
        cuts = (cuts[:-1] + cuts[1:]) / 2
        if len(cuts) > most_cuts:
            cuts = cuts[np.linspace(0, len(cuts) - 1, most_cuts).astype(int)]
        order = np.argsort(v, kind="stable")
        at = np.searchsorted(v[order], cuts, "right")
        below = np.concatenate([[0], np.cumsum(bad[order])])[at]
        for op, p, n in (("<=", below, at - below), (">", p0 - below, len(v) - at - (p0 - below))):
            g = _gain(p0, n0, p.astype(float), n.astype(float))
            k = int(np.argmax(g))
            if g[k] > best:
                best, found = float(g[k]), (name, op, float(cuts[k]))
    return best, found


def chance(hits: int, n: int, rate: float) -> float:
    """The probability of ``hits`` or more among ``n`` draws that each hit at ``rate``."""
    if not 0 < rate < 1:
        return 1.0
    i = np.arange(hits, n + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    return float(np.exp(logs[n] - logs[i] - logs[n - i] + i * np.log(rate) + (n - i) * np.log1p(-rate)).sum())


def learn_decision_list(
    x: dict[str, np.ndarray], bad: np.ndarray, *, min_precision: float = 0.95, max_chance: float = 1e-5, min_covered: int = 10, max_rules: int = 32, max_tests: int = 4, most_cuts: int = 512
) -> DecisionList:
    """Sequential covering of ``bad`` and of the other rows, in one list. A third of the rows is held back for pruning.

    A rule must be precise on all rows and on those held back, where rows drawn at random would do as well with a
    probability of ``max_chance`` at most. A rule that keeps may cover at most the part ``1 - min_precision`` of the bad rows that chance would give it.
    """
    rules: list[Rule] = []
    alive, third = np.ones(len(bad), bool), np.arange(len(bad)) % 3
    needed = {True: min_precision, False: 1 - (1 - min_precision) * (bad.mean() if len(bad) else 0.0)}

    def grown(of: np.ndarray, rows: np.ndarray, start: str) -> list[tuple[str, str, float]]:
        """A conjunction whose first test is of the feature ``start``."""
        tests: list[tuple[str, str, float]] = []
        inside = np.flatnonzero(rows)
        while len(tests) < max_tests and (~of[inside]).any():
            _, t = _best_test({k: v[inside] for k, v in x.items() if tests or k == start}, of[inside], most_cuts)
            if t is None:
                break
            tests.append(t)
            v = x[t[0]][inside]
            inside = inside[v <= t[2] if t[1] == "<=" else v > t[2]]
        return tests

    def pruned(tests: list[tuple[str, str, float]], rejects: bool, of: np.ndarray, hold: np.ndarray) -> tuple[Rule, np.ndarray]:
        def worth(n: int) -> float:
            c = Rule(tuple(tests[:n]), rejects).holds(x) & hold
            p, q = (c & of).sum(), (c & ~of).sum()
            return (p - q) / (p + q) if p + q else -1.0

        keep = max(range(1, len(tests) + 1), key=lambda n: (worth(n), -n))
        c = Rule(tuple(tests[:keep]), rejects).holds(x) & alive
        on_hold = c & hold
        hits, n = int((on_hold & of).sum()), int(on_hold.sum())
        precision = min((c & of).sum() / max(1, c.sum()), hits / n if n and chance(hits, n, of[hold].mean()) <= max_chance else 0.0)
        return Rule(tuple(tests[:keep]), rejects, float(precision), int(c.sum())), c

    def next_rule(rejects: bool) -> tuple[Rule, np.ndarray] | None:
        """The acceptable rule that covers most, of those grown from each feature's best test; with another third held back where there is none."""
        of = bad if rejects else ~bad
        for held in (2, 0, 1):
            usable, hold = alive & (third != held), alive & (third == held)
            while of[usable].sum() >= min_covered:
                made = [tests for tests in (grown(of, usable, k) for k in x) if tests]
                if not made:
                    break
                fit = [f for f in (pruned(tests, rejects, of, hold) for tests in made) if f[0].precision >= needed[rejects] and f[0].covered >= min_covered]
                if fit:
                    return max(fit, key=lambda f: int((f[1] & of).sum()) - int((f[1] & ~of).sum()))
                led = np.zeros(len(bad), bool)
                for tests in made:
                    led |= Rule(tuple(tests), rejects).holds(x)
                if not (led & usable & of).any():
                    break
                usable &= ~(led & of)
        return None

    while len(rules) < max_rules and len(bad):
        found = next_rule(True) or next_rule(False)
        if found is None:
            break
        rules.append(found[0])
        alive &= ~found[1]
    while rules and not rules[-1].bad:  # what no rule decides is kept anyway
        rules.pop()
    return DecisionList(tuple(rules))


def quality_rules(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = 20_000, min_precision: float = 0.95
) -> tuple[DataFrame, DecisionList]:
    """Judge every row of ``docs``: its id, ``STATS``, ``base_failed`` and ``kept``, and the list that was learned.

    The list is fitted to at most ``max_train`` labelled rows, those with the
    smallest hashes of their ids; statistics and verdicts cover all rows.
    ``base_failed`` is fewer than 10 words, or over 20 % of the words repeated.
    """
    stats = stage(text_statistics(docs, id_col, text_col), "statistics")
    feature = lambda name: FEATURES[name](F.col)
    one = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) == 0).alias("_bad"))
    one = one.select(F.xxhash64("_id").alias("_h"), "_id", "_bad")
    ids = one.agg(F.approx_count_distinct("_h")).first()[0]
    near = one.where(F.col("_h") <= hash_edge(ids, max_train)).distinct()
    sample = (
        stats.join(near, F.col(id_col) == F.col("_id")).select("_h", F.col("_id").cast("string").alias("_k"), "_bad", *(feature(k).alias(f"_f_{k}") for k in FEATURES)).distinct()
        .orderBy("_h", "_k", "_bad", *(f"_f_{k}" for k in FEATURES)).limit(max_train).collect()
    )
    x = {k: np.array([r[f"_f_{k}"] for r in sample], float) for k in FEATURES}
    rules = learn_decision_list(x, np.array([r["_bad"] for r in sample], bool), min_precision=min_precision)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select(id_col, *STATS, failed.alias("base_failed"), (~failed & rules.kept(feature)).alias("kept")), rules
