"""Toxicity by a subsequence string kernel, a support vector machine and Nystroem landmarks.

Words are compared by their common subsequences of three characters, which may have gaps: each
counts by ``DECAY`` to the number of characters passed over, so insults with inserted or
replaced characters stay close to the plain ones. Landmarks span the feature space (Nystroem);
a linear machine with squared hinge loss is trained there, and since the kernel is a product of
explicit subsequence weights, the machine collapses into one weight per subsequence.

Labels belong to texts, and the machine is trained on them: a text's vector is the mean of the
kernel vectors of its worst words, as the machine of the turn before ranks them, and its label is
the one given. A toxic text has ordinary words too, so the first ranking must come from somewhere:
it is that of a machine for words, whose first labels are mined from runs of characters that only
toxic texts have, in more texts than chance would give. A text's score is a logistic function of
its worst words' margins, fitted on the same bounded sample of labelled texts, near copies left out.

Null and empty texts have no words and get the score of a clean text; a text may be as long as a
row can be. Repeated rows give repeated results, a null id is kept and takes no label, further
columns are kept; without labels, as for an empty table of them, every score is 0.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import common

DECAY = 0.6
GAPS = ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2))
CODES = 38
LONGEST = 24
LANDMARKS = 180
#: Labelled texts of each label that the machine is fitted on, at most.
SAMPLE = {1: 700, 0: 1400}
#: How often texts are ranked anew by the machine that they trained.
TURNS = 2
PREDICT = 0.7
#: How many of a text's worst words its score looks at.
WORST = 4
#: Of a telling run's texts so many are toxic for each clean one, at odds by chance below these.
PURE = 1
CHANCE = 0.01

#: Accented letters that count alike; other languages' words differ by them, so they aren't folded into plain ones.
_ACCENTS = ("éë", "èê", "àáâãäå", "ç", "ñ", "ìíîï", "òóôõö", "ùúûü", "ýÿ")
_LOOKALIKES = dict(zip("013457@$", "oleastas", strict=True))
_CODE = {chr(97 + i): i + 1 for i in range(26)}
_CODE |= {k: _CODE[v] for k, v in _LOOKALIKES.items()} | {"^": 28}
_CODE |= {k: 29 + i for i, alike in enumerate(_ACCENTS) for k in alike}
_TABLE = bytes(_CODE.get(chr(b), 27) for b in range(256))
EDGE = ".,;:!?\"'()[]{}«»“”"


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of pieces of at most LONGEST characters, their lengths, and the word of each piece."""
    pieces, owner = [], []
    for i, word in enumerate(words):
        word = "^" + word
        for at in range(0, max(1, len(word) - LONGEST // 2), LONGEST // 2):
            pieces.append(word[at : at + LONGEST])
            owner.append(i)
    grid = np.zeros((len(pieces), LONGEST), np.int64)
    lengths = np.array([len(p) for p in pieces], np.int64)
    flat = np.frombuffer("".join(pieces).encode("latin-1", "replace").translate(_TABLE), np.uint8)
    grid[np.arange(LONGEST) < lengths[:, None]] = flat
    return grid, lengths, np.array(owner, np.int64)


def _norms(lengths: np.ndarray) -> np.ndarray:
    total = sum(DECAY ** (2 * (a + b - 2)) * np.maximum(0, lengths - a - b) for a, b in GAPS)
    return np.sqrt(np.maximum(total, 1e-9))


def products(words: list[str], weights: np.ndarray) -> np.ndarray:
    """The product of each word's normalised subsequence vector with each column of ``weights``; the best piece counts."""
    grid, lengths, owner = coded(words)
    out = np.zeros((len(grid), weights.shape[1]))
    for a, b in GAPS:
        index = (grid[:, : LONGEST - a - b] * CODES + grid[:, a : LONGEST - b]) * CODES + grid[:, a + b :]
        index[grid[:, a + b :] == 0] = 0
        for j in range(index.shape[1]):
            live = np.flatnonzero(index[:, j])
            out[live] += DECAY ** (a + b - 2) * weights[index[live, j]]
    out /= _norms(lengths)[:, None]
    best = np.full((len(words), weights.shape[1]), -np.inf)
    np.maximum.at(best, owner, out)
    return best


def vectors(words: list[str]) -> np.ndarray:
    """Explicit normalised subsequence weights of words, one column each: the mean of a long word's pieces."""
    grid, lengths, owner = coded(words)
    out = np.zeros((CODES**3, len(words)))
    share = 1 / (_norms(lengths) * np.bincount(owner, minlength=len(words))[owner])
    for a, b in GAPS:
        for j in range(LONGEST - a - b):
            live = np.flatnonzero(grid[:, j + a + b])
            index = (grid[live, j] * CODES + grid[live, j + a]) * CODES + grid[live, j + a + b]
            np.add.at(out, (index, owner[live]), DECAY ** (a + b - 2) * share[live])
    return out


def words_of(text: str) -> set[str]:
    """The text's different words in lower case, without punctuation at their ends; lone letters in a row make one."""
    split = text.lower().split()
    words = {w.strip(EDGE) for w in set(split)}
    if sum(len(w) == 1 for w in words) >= 4:
        run: list[str] = []
        for w in (*split, "--"):
            bare = w.strip(EDGE)
            if len(bare) == 1:
                run.append(bare)
                continue
            if len(run) >= 4:
                words.add("".join(run))
            run = []
    return {w for w in words if len(w) > 2}


def fit_machine(features: np.ndarray, labels: np.ndarray, cost: float = 30.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by Newton's method; classes weigh the same. Labels: 1 and -1."""
    cost = np.where(labels > 0, cost * max(1.0, (labels < 0).sum() / max(1, (labels > 0).sum())), cost)
    x = np.hstack([features, np.ones((len(features), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6

    def loss(w: np.ndarray) -> float:
        return float(0.5 * w @ ridge @ w + (cost * np.maximum(0, 1 - labels * (x @ w)) ** 2).sum())

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        active = labels * (x @ w) < 1
        xa = x[active]
        ca = 2 * cost[active]
        step = np.linalg.solve(ridge + (xa.T * ca) @ xa, (xa.T * ca) @ labels[active]) - w
        rate = 1.0
        while rate > 1e-3 and loss(w + rate * step) > now:
            rate /= 2
        better = loss(w + rate * step)
        if better > now * (1 - 1e-5):
            break
        w, now = w + rate * step, better
    return w[:-1], float(w[-1])


def spread(words: list[str], most: int) -> list[str]:
    """Some of the words, each as unlike the ones before it as can be."""
    picked = [words[0]]
    near = products(words, vectors(picked))[:, 0]
    while len(picked) < min(most, len(words)):
        at = int(near.argmin())
        if near[at] > 0.9:
            break
        picked.append(words[at])
        near = np.maximum(near, products(words, vectors(picked[-1:]))[:, 0])
    return picked


class Model:
    """A weight per subsequence, a bias, and the logistic function of a text's worst words."""

    def __init__(self, weights: np.ndarray, bias: float, curve: np.ndarray):
        self.weights, self.bias, self.curve = weights.astype(np.float64), bias, curve

    def margins(self, words: list[str]) -> np.ndarray:
        return products(words, self.weights[:, None])[:, 0] + self.bias if words else np.empty(0)

    def text_score(self, worst: list[float]) -> float:
        z = self.curve @ np.array([*worst, 1.0])
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _worst(margins: Iterable[float]) -> list[float]:
    """The WORST largest margins, within -2 and 2."""
    top = heapq.nlargest(WORST, margins)
    return [min(2.0, max(-2.0, m)) for m in top] + [-2.0] * (WORST - len(top))


def _runs(word: str) -> set[str]:
    word = "^" + word
    return {word[i : i + n] for n in (4, 5) for i in range(len(word) - n + 1)} | {word + "$"}


def _unlike(bags: list[tuple[set[str], int]]) -> list[tuple[set[str], int]]:
    """The bags without near copies of earlier ones, whose words would seem toxic together.

    Bags are near copies when two neighbours among the five least hashes of their long words are the same.
    """
    kept, seen = [], set()
    for bag, y in bags:
        least = sorted(zlib.crc32(w.encode("utf-8", "replace")) for w in bag if len(w) > 8)[:5]
        pairs = list(zip(least, least[1:]))
        if seen.isdisjoint(pairs):
            kept.append((bag, y))
        seen.update(pairs)
    return kept


def _bad_words(bags: list[tuple[set[str], int]], share: float) -> set[str]:
    """Words with telling runs, and more often in toxic texts than in clean ones.

    A run (or whole word) is telling if most texts that have it are toxic and the odds that so
    many are, were it unrelated to the label, are below CHANCE over the number of runs (by a
    bound on the binomial tail). First come runs that no clean text has; their words are then
    left out, so that runs which only resemble those words tell nothing in the second turn.
    """
    share = min(max(share, 1e-3), 0.999)
    toxic, clean = Counter(w for b, y in bags if y for w in b), Counter(w for b, y in bags if not y for w in b)

    def odds(t: int, c: int) -> float:
        q = t / (t + c)
        return (t + c) * (q * math.log(share / q) + ((1 - q) * math.log((1 - share) / (1 - q)) if c else 0.0))

    bad: set[str] = set()
    for pure in (True, False):
        t, c = Counter(), Counter()
        for bag, y in bags:
            (t if y else c).update({r for w in bag if w not in bad for r in _runs(w)})
        limit = math.log(CHANCE / max(1, len(t)))
        telling = {r for r, n in t.items() if (c[r] == 0 if pure else n > PURE * c[r]) and odds(n, c[r]) < limit}
        if pure and not telling:  # too few texts for odds: the most frequent runs that no clean text has
            most = max((n for r, n in t.items() if not c[r]), default=0)
            telling = {r for r, n in t.items() if not c[r] and n == most}
        bad |= {w for w, n in toxic.items() if n > clean[w] and not telling.isdisjoint(_runs(w))}
    return bad


def train(texts: Iterable[tuple[str | Iterable[str], int]], rounds: int = 3, seed: int = 7) -> Model | None:
    """A model from labelled texts, or labelled bags of their words; None without both labels."""
    rng = np.random.default_rng(seed)
    bags = _unlike([(words_of(t) if isinstance(t, str) else set(t), y) for t, y in texts])
    toxic, clean = Counter(w for b, y in bags if y for w in b), Counter(w for b, y in bags if not y for w in b)
    if not any(y for _, y in bags) or not clean:
        return None
    share = sum(y for _, y in bags) / len(bags)
    bad = sorted(_bad_words(bags, share))
    negatives = sorted(set(clean) - set(bad))
    sample = [negatives[i] for i in rng.permutation(len(negatives))[:4000]] + [w for w, _ in clean.most_common(500)]
    model = None
    for _ in range(rounds):
        if not bad:
            return None
        sample = sorted(set(sample) - set(bad))
        marks = spread(bad, LANDMARKS * 2 // 3) + [sample[i] for i in rng.permutation(len(sample))[: LANDMARKS // 3]]
        basis = vectors(marks)
        values, axes = np.linalg.eigh(basis.T @ basis)
        root = axes[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
        words = bad + sample
        labels = np.array([1.0] * len(bad) + [-1.0] * len(sample))
        known_words = products(words, basis) @ root
        w, bias = fit_machine(known_words, labels)
        model = Model(basis @ (root @ w), bias, np.zeros(WORST + 1))
        hard = model.margins(negatives)
        sample = sample + [negatives[i] for i in np.argsort(-hard)[:2000]]
        more = set(bad)
        known = sorted(w for w, n in toxic.items() if n >= 3 and n > 3 * clean[w])
        more |= {w for w, m in zip(known, model.margins(known), strict=True) if m > 0.3} if known else set()
        bad = sorted(more)
    # The texts themselves, by the kernel vectors of their worst words.
    said = np.array([1.0 if y else -1.0 for _, y in bags])
    for _ in range(TURNS):
        worst = []
        for bag, _ in bags:
            words = sorted(bag)
            margins = model.margins(words)
            worst.append([words[i] for i in np.argsort(-margins, kind="stable")[:WORST]])
        flat = sorted({w for ws in worst for w in ws})
        place = {w: i for i, w in enumerate(flat)}
        features = products(flat, basis) @ root
        pooled = np.array([features[[place[w] for w in ws]].mean(axis=0) if ws else np.zeros(features.shape[1]) for ws in worst])
        w, bias = fit_machine(np.vstack([known_words, pooled]), np.concatenate([labels, said]))
        model = Model(basis @ (root @ w), bias, np.zeros(WORST + 1))
    x = np.array([[*_worst(model.margins(sorted(b))), 1.0] for b, _ in bags])
    y = np.array([float(y) for _, y in bags])
    curve = np.zeros(WORST + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-4)) @ x / len(x) + 1e-3 * np.eye(WORST + 1), x.T @ (p - y) / len(x) + 1e-3 * curve)
        curve = curve - step
    model.curve = curve
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[tuple[str, ...], int]]:
    """The words and label of at most SAMPLE texts of each label, by the order of a hash of their id; texts are read whole."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    picked = None
    for label, most in SAMPLE.items():
        some = labels.where(F.col("toxic") == label).join(known.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.union(some)
    ids = {r.doc_id: r.toxic for r in picked.collect()}
    if not ids:
        return []
    chosen = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, toxic int")
    rows = known.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, toxic in common.arrow_rows(batches, "text", "toxic"):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(words_of(text))], pa.list_(pa.string())), pa.array([toxic], pa.int32())], ["words", "toxic"])

    return sorted((tuple(r.words), r.toxic) for r in rows.mapInArrow(run, "words array<string>, toxic int").collect())


def score(df: DataFrame, model: Model | None, column: str = "toxic_score") -> DataFrame:
    """``df`` with a ``column`` of scores (0 to 1), in place of one of that name."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    df = df.drop(column)
    schema = df.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        known: dict[str, float] = {}
        for batch in batches:
            scores = []
            for block in common.arrow_blocks([batch], "text", text="text"):
                bags = [words_of(t or "") for (t,) in block]
                if own is None:
                    scores += [0.0] * len(bags)
                    continue
                if len(known) > common.KEEP:
                    known.clear()
                new = sorted({w for b in bags for w in b if w not in known})
                for at in range(0, len(new), 20_000):
                    some = new[at : at + 20_000]
                    known.update(zip(some, own.margins(some).tolist(), strict=True))
                scores += [own.text_score(_worst(map(known.__getitem__, b))) for b in bags]
            yield batch.append_column(column, pa.array(scores, pa.float64()))

    return df.mapInArrow(run, type(schema)([*schema.fields]).add(column, "double"))
