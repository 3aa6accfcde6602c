"""Toxicity by a linear-chain conditional random field over the words of a line.

Labels mark documents, so tokens are labelled first: word and prefix features that occur far
more often in toxic documents than in others (likelihood ratio test over the labelled
sample) form a lexicon, unless they owe it to copies: such a feature stands between the same
words again and again. In toxic documents the tokens that show a feature of the lexicon are
toxic, all others are not. The field then learns weights of word and prefix features and of the four
transitions from windows around labelled tokens, of other documents around tokens that share a prefix with the
lexicon. Its marginals (forward-backward over every
line of the whole text) give the toxic spans, runs of tokens of at least one half, and the
document's score: one minus the product over spans of one minus their highest marginal, or
without a span the highest marginal.

Fitting uses a bounded sample of the distinct labelled texts (about ``sample_rows``, drawn by
a hash of the text) and ``windows`` of it; scoring covers whole texts. A line is scored as one chain, and the
lines of an Arrow batch advance together, step by step.

Defined results: a null or wordless text has score 0 and no span; rows without label teach
nothing, and a text labelled twice, as one document or as copies, counts once and is toxic if
any label says so; without toxic labels
every score is the floor of an untrained field, 0; repeated rows are scored alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallywatch.llm.common import pick, place, positional, ship_code
from tallywatch.session import stage

TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000
    windows: int = 40_000
    window: int = 16
    lexicon: int = 5_000
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    #: Least likelihood ratio statistic, and least ratio of the rates, of a lexicon feature.
    evidence: float = 35.0
    ratio: float = 20.0
    steps: int = 80
    rate: float = 0.15
    penalty: float = 1e-4


@dataclass
class Model:
    """Weights of the toxic state against the other; transitions [from, to] as log weights."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    trained: bool = False


def features(word: str, prefixes: tuple[int, ...]) -> list[str]:
    """The word itself, and its prefixes marked by a blank."""
    return [word, *[word[:n] + " " for n in prefixes if len(word) > n]]


def _feature_counts(prefixes: tuple[int, ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of a batch with each feature, by label."""
        for batch in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set()
                for word in set(TOKEN.findall((text or "").lower())):
                    own.update(features(word, prefixes))
                seen[toxic].update(own)
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array([seen[1][n] for n in names], pa.int64()),
                    pa.array([seen[0][n] for n in names], pa.int64()),
                ],
                names=["feature", "toxic", "other"],
            )

    return count


def _contexts(candidates: set[str], prefixes: tuple[int, ...]):
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The neighbours that each candidate feature has in a batch."""
        for batch in batches:
            found = set()
            for text in batch.column(0).to_pylist():
                tokens = TOKEN.findall((text or "").lower())
                for i, word in enumerate(tokens):
                    for f in features(word, prefixes):
                        if f in candidates:
                            found.add((f, " ".join(tokens[max(0, i - 1) : i + 2])))
            pairs = sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)],
                names=["feature", "context"],
            )

    return contexts


def _windows(lexicon: set[str], settings: Settings):
    alike = {f for word in lexicon for f in features(word.strip(), settings.prefixes)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of tokens with their tags: around toxic tokens, else one of the text."""
        size = settings.window
        for batch in batches:
            found, tags = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = TOKEN.findall((text or "").lower())
                if not tokens:
                    continue
                mark = [
                    int(bool(toxic) and any(f in lexicon for f in features(w, settings.prefixes)))
                    for w in tokens
                ]
                hits = [i for i, m in enumerate(mark) if m]
                if toxic and not hits:
                    continue  # nothing says which of its tokens are toxic
                if not toxic:
                    hits = [
                        i
                        for i, w in enumerate(tokens)
                        if any(f in alike for f in features(w, settings.prefixes))
                    ]
                centers = hits[:: max(1, len(hits) // 4)] or [len(text) % len(tokens)]
                for center in centers:
                    low = max(0, center - size // 2)
                    found.append(tokens[low : low + size])
                    tags.append(mark[low : low + size])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.int8()))],
                names=["tokens", "tags"],
            )

    return cut


def marginals(unary: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(toxic) of every token of chains laid end to end; chain k is first[k]:first[k + 1].

    All chains advance together; the longest come first, so those still running are a
    prefix. ``unary`` is the log weight of the toxic state against the other.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    steps = int(length[0]) if len(length) else 0
    running = np.searchsorted(-length, -np.arange(steps), "left")  # longer than the step
    forward = np.zeros(len(unary))
    backward = np.zeros(len(unary))
    (aa, ab), (ba, bb) = moves
    log_add = np.logaddexp
    for t in range(steps):
        at = start[: running[t]] + t
        if t == 0:
            forward[at] = unary[at]
        else:
            # Log odds of toxic to other after the move.
            x = forward[at - 1]
            forward[at] = unary[at] + log_add(ab, bb + x) - log_add(aa, ba + x)
    for t in range(steps - 2, -1, -1):
        at = start[: running[t + 1]] + t
        y = unary[at + 1] + backward[at + 1]
        backward[at] = log_add(ba, bb + y) - log_add(aa, ab + y)
    return 1 / (1 + np.exp(-np.clip(forward + backward, -60, 60)))


def train(samples: list[tuple[list[str], list[int]]], settings: Settings) -> Model:
    """Weights that make the tags of the windows likeliest (full gradients, Adam)."""
    if not any(any(tags) for _, tags in samples):
        return Model(prefixes=settings.prefixes)
    size = settings.window
    n = len(samples)
    names: dict[str, int] = {}
    rows: list[int] = []
    columns: list[int] = []
    tags = np.zeros((n, size), np.int8)
    valid = np.zeros((n, size), bool)
    for i, (tokens, own) in enumerate(samples):
        valid[i, : len(tokens)] = True
        tags[i, : len(own)] = own
        for t, word in enumerate(tokens):
            for f in features(word, settings.prefixes):
                rows.append(i * size + t)
                columns.append(names.setdefault(f, len(names)))
    row, column = np.array(rows), np.array(columns)
    k = len(names)
    theta = np.zeros(k + 5)
    theta[k] = -3.0
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    both = valid[:, 1:]
    for step in range(1, settings.steps + 1):
        unary = np.bincount(row, theta[column], n * size).reshape(n, size) + theta[k]
        moves = theta[k + 1 :].reshape(2, 2)
        weight = np.exp(np.clip(moves, -20, 20))
        # Scaled forward and backward over the windows, two states.
        psi = np.stack([np.ones_like(unary), np.exp(np.clip(unary, -30, 30))], axis=2)
        alpha = np.zeros((n, size, 2))
        beta = np.ones((n, size, 2))
        alpha[:, 0] = psi[:, 0] / psi[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, size):
            a = (alpha[:, t - 1] @ weight) * psi[:, t]
            alpha[:, t] = a / a.sum(axis=1, keepdims=True)
        for t in range(size - 2, -1, -1):
            b = (psi[:, t + 1] * beta[:, t + 1]) @ weight.T
            b /= b.sum(axis=1, keepdims=True)
            beta[:, t] = np.where(valid[:, t + 1, None], b, 1.0)
        p = alpha * beta
        p /= p.sum(axis=2, keepdims=True)
        pair = (
            alpha[:, :-1, :, None]
            * weight[None, None]
            * (psi[:, 1:] * beta[:, 1:])[:, :, None, :]
        )
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        gap = np.where(valid, p[:, :, 1] - tags, 0.0)
        gradient = np.zeros_like(theta)
        gradient[:k] = np.bincount(column, gap.ravel()[row], k)
        gradient[k] = gap.sum()
        expected = (pair * both[:, :, None, None]).sum(axis=(0, 1))
        seen = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                seen[a, b] = ((tags[:, :-1] == a) & (tags[:, 1:] == b) & both).sum()
        gradient[k + 1 :] = (expected - seen).ravel()
        gradient = gradient / n + settings.penalty * theta
        mean = 0.9 * mean + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        theta -= (
            settings.rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        )
    weights = {f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-3}
    return Model(weights, float(theta[k]), theta[k + 1 :].reshape(2, 2).copy(), settings.prefixes, True)


def fit(labelled: DataFrame, settings: Settings = Settings(), mark: str | None = None) -> Model:
    """Learn from ``text`` and ``toxic``; the bounded lexicon and windows come to the driver.

    ``mark`` names a column of ``xxhash64(text)``, if there is one: made before a join, it spares
    that join the texts while they are counted.
    """
    ship_code(labelled.sparkSession)
    known = pick(labelled, "text", "toxic", *[mark] * bool(mark)).filter("toxic is not null and text is not null")
    hashed = F.col(mark) if mark else F.xxhash64("text")
    total = known.select(F.count_distinct(hashed)).first()[0]
    draw = F.pmod(hashed, F.lit(1 << 40)) / F.lit(float(1 << 40))
    known = known.filter(draw < F.lit(settings.sample_rows / max(total, settings.sample_rows)))
    # One row per text: copies neither raise nor lower the evidence of their words.
    known = stage(
        known.groupBy("text").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")), "labelled"
    )
    n = known.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not n or not n[0]:
        return Model(prefixes=settings.prefixes)
    counts = (
        known.mapInArrow(
            _feature_counts(settings.prefixes), "feature string, toxic bigint, other bigint"
        )
        .groupBy("feature")
        .agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    )
    bad, good = float(n[0]), float(max(n[1], 1))
    share = (F.col("a") + F.col("b")) / (bad + good)
    # Likelihood ratio of two rates against one.
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    evidence = 2 * (
        part(a, bad * share) + part(b, good * share)
        + part(bad - a, bad * (1 - share)) + part(good - b, good * (1 - share))
    )
    ratio = ((a + 0.5) / bad) / ((b + 0.5) / good)
    lexicon = (
        counts.filter((ratio >= settings.ratio) & (evidence >= settings.evidence))
        .orderBy(evidence.desc(), "feature")
        .limit(settings.lexicon)
        .collect()
    )
    docs_with = {r["feature"]: r["a"] for r in lexicon}
    around = (
        known.filter("toxic = 1")
        .mapInArrow(_contexts(set(docs_with), settings.prefixes), "feature string, context string")
        .distinct()
        .groupBy("feature")
        .count()
        .collect()
    )
    words = {r["feature"] for r in around if 2 * r["count"] >= docs_with[r["feature"]]}
    cut = known.mapInArrow(_windows(words, settings), "tokens array<string>, tags array<tinyint>")
    # At most five windows per sampled row; the lowest hashes stay.
    samples = cut.orderBy(F.xxhash64("tokens"), "tokens").limit(settings.windows).collect()
    return train([(r["tokens"], r["tags"]) for r in samples], settings)


class Scorer:
    """Scores texts of a batch together; words once scored are remembered, up to a bound."""

    def __init__(self, model: Model, remembered: int = 300_000) -> None:
        self.model = model
        self.most = remembered
        self.known: dict[str, float] = {}

    def _unary(self, tokens: list[str]) -> list[float]:
        known, get = self.known, self.model.weights.get
        if len(known) > self.most:
            known.clear()
        out = []
        for word in tokens:
            value = known.get(word)
            if value is None:
                value = self.model.bias + sum(
                    get(f, 0.0) for f in features(word, self.model.prefixes)
                )
                known[word] = value
            out.append(value)
        return out

    def batch(self, texts: list[str | None]) -> list[tuple[float, list[dict]]]:
        if not self.model.trained:
            return [(0.0, [])] * len(texts)
        unary: list[float] = []
        first, of_text = [0], [0]
        lowered = [(t or "").lower() for t in texts]
        # Lowering may change lengths; offsets must be those of the text itself.
        for i, text in enumerate(texts):
            if text and len(lowered[i]) != len(text):
                lowered[i] = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for text in lowered:
            for line in text.split("\n"):
                tokens = TOKEN.findall(line)
                if tokens:
                    unary += self._unary(tokens)
                    first.append(len(unary))
            of_text.append(len(unary))
        p = marginals(np.array(unary), np.array(first), self.model.moves)
        chain_start = np.zeros(len(p) + 1, bool)
        chain_start[first] = True
        out: list[tuple[float, list[dict]]] = []
        for i, (a, b) in enumerate(zip(of_text[:-1], of_text[1:])):
            if a == b:
                out.append((0.0, []))
                continue
            own = p[a:b]
            hot = np.flatnonzero(own >= 0.5)
            if not len(hot):
                out.append((float(own.max()), []))
                continue
            # A span ends where the next hot token is no neighbour, or in another line.
            breaks = (np.diff(hot) > 1) | chain_start[a + hot[1:]]
            groups = np.split(hot, np.flatnonzero(breaks) + 1)
            where = [m.span() for m in TOKEN.finditer(lowered[i])]
            spans, miss = [], 1.0
            for g in groups:
                top = float(own[g].max())
                miss *= 1 - top
                spans.append({"start": where[g[0]][0], "end": where[g[-1]][1], "score": top})
            out.append((1 - miss, spans))
        return out


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with ``score`` and ``spans``: structs of start, end (code points), score."""
    spark = documents.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(model)
    columns = documents.columns
    at = place(columns, "text")
    rows = positional(documents)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                found = scorer.batch(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.array([f[0] for f in found], pa.float64()),
                        pa.array([f[1] for f in found], kind),
                    ],
                    names=[*batch.schema.names, "score", "spans"],
                )

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    done = rows.mapInArrow(
        predict,
        f"{kinds}, score double, spans array<struct<start:bigint,end:bigint,score:double>>",
    )
    return done.toDF(*columns, "score", "spans")
