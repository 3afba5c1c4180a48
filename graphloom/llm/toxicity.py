"""Toxicity by weak supervision.

Voters look at a document's words: a lexicon of insults, lexicons of words and of word
beginnings induced from labelled rows (each applied to rows that did not shape it), and
patterns of capitals and exclamation marks.  A generative model takes the true class as
hidden and the votes, the noisy label among them, as made from it: each voter's votes
depend on the class and, where voters are correlated within the classes, on the vote of one
other, along the tree that explains most of the correlation.  Accuracies, correlations and
the posterior class of each row are estimated together.  A linear classifier on hashed words and word beginnings is trained on the model's posterior
classes and scores every document; the score of 0.5 stands where, on rows that were not
fitted on, calling documents toxic agrees best with their labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import _tokens
from graphloom.llm._spans import free_name

#: Labelled rows on which lexicons, label model and classifier are fitted: a bounded sample by hash.
TRAIN_ROWS = 8000
#: Features that the classifier keeps, and that one labelled row is learned from at most (the least hashes).
FEATURES, ROW_FEATURES = 4096, 4096
PREFIXES = (4, 5, 6, 7)
#: Common insults in English.
INSULTS = (
    "bastard clown coward creep degenerate disgusting dumb fool garbage hate hateful idiot idiotic imbecile jerk kill loser lowlife moron moronic "
    "parasite pathetic pig scum scumbag shut stupid trash ugly useless vermin vile worthless"
).split()
_MODEL = pa.schema([("marks", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64())])
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature) of every word and word beginning, and each document's number of words."""
    raw = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _WORD[raw]
    start = np.flatnonzero(~inside[:-1] & inside[1:])
    end = np.flatnonzero(inside[:-1] & ~inside[1:])
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(at, start, side="right") - 1
    rolling = _tokens.Rolling(_tokens._SYMBOL[_tokens._LOWER[raw]])
    # Half of a hash tells features apart well enough, and takes half the driver's memory.
    half = lambda x: (x >> np.uint64(32)).astype(np.uint32)
    docs, marks = [doc], [half(rolling.of(start, end))]
    for p in PREFIXES:
        long = end - start > p
        docs.append(doc[long])
        marks.append(half(_tokens.mix(rolling.of(start[long], start[long] + p) + np.uint64(p))))
    return np.concatenate(docs), np.concatenate(marks), np.bincount(doc, minlength=len(texts))


def _shouts(text: bytes) -> int:
    """1 for mostly capitals, 2 for three exclamation marks or more, or their sum."""
    upper, lower = sum(map(text.count, _UPPER)), sum(map(text.count, _LOWER))
    return (upper > lower) + 2 * (text.count(b"!") >= 3)


_UPPER = [bytes([c]) for c in b"AEIOUNRST"]
_LOWER = [bytes([c]) for c in b"aeiounrst"]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def held_out(doc_id) -> F.Column:
    """Rows whose label is never learned from: crc32 of the doc_id's text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class LabelModel:
    """Hidden classes behind votes (1 toxic, -1 clean, 0 abstains), by expectation and maximisation.

    ``parent[j]`` is the voter on whose vote that of ``j`` depends beside the class, or -1.
    ``table[j]`` has the chances of ``j``'s votes by class and the parent's vote, and
    ``correlation`` the mutual information of voters within the classes, in nats.
    """

    #: Correlations of less are taken for chance.
    LEAST = 0.01

    def __init__(self, votes: np.ndarray, start: np.ndarray, rounds: int = 25):
        """start: a first guess of each row's chance to be toxic."""
        seen, q = votes + 1, start.astype(float)
        m = votes.shape[1]
        self.parent = [-1] * m
        for turn in range(rounds):
            self.prior = float(np.clip(q.mean(), 1e-4, 1 - 1e-4))
            if turn % 5 == 0:
                self.correlation = np.array([[self._information(seen[:, i], seen[:, j], q) if i != j else 0.0 for j in range(m)] for i in range(m)])
                self.parent = self._tree(self.correlation)
            self.table = [self._chances(seen[:, j], seen[:, p] if p >= 0 else None, q) for j, p in enumerate(self.parent)]
            q = self.posterior(votes)

    @staticmethod
    def _joint(x: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Chances of pairs of votes, by class."""
        count = lambda w: np.bincount(x * 3 + y, weights=w, minlength=9).reshape(3, 3) + 1 / 9
        both = np.stack([count(1 - q), count(q)])
        return both / both.sum(axis=(1, 2), keepdims=True)

    def _information(self, x: np.ndarray, y: np.ndarray, q: np.ndarray) -> float:
        p = self._joint(x, y, q)
        gain = (p * np.log(p / (p.sum(axis=2, keepdims=True) * p.sum(axis=1, keepdims=True)))).sum(axis=(1, 2))
        return float((1 - self.prior) * gain[0] + self.prior * gain[1])

    def _tree(self, information: np.ndarray) -> list[int]:
        """Parents along the tree of most information, without its weak branches."""
        m = len(information)
        parent, inside = [-1] * m, {0}
        while len(inside) < m:
            i, j = max(((i, j) for i in sorted(inside) for j in range(m) if j not in inside), key=lambda e: information[e])
            parent[j] = i if information[i, j] >= self.LEAST else -1
            inside.add(j)
        return parent

    def _chances(self, x: np.ndarray, given: np.ndarray | None, q: np.ndarray) -> np.ndarray:
        if given is None:
            given = np.zeros(len(x), dtype=int)
        p = self._joint(given, x, q)
        return p / p.sum(axis=2, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) + np.zeros(len(votes))
        for j, p in enumerate(self.parent):
            ratio = np.log(self.table[j][1]) - np.log(self.table[j][0])
            odds += ratio[votes[:, p] + 1 if p >= 0 else 0, votes[:, j] + 1]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Classifier:
    """A linear model on the presence of hashed features, as sorted hashes and their weights."""

    def __init__(self, marks: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(marks)
        self.marks, self.weights, self.bias = marks[order], weights[order], bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for lo, hi in _tokens.chunks(texts):
            doc, mark, _ = _features(texts[lo:hi])
            if len(self.marks) and len(mark):
                at = np.minimum(np.searchsorted(self.marks, mark), len(self.marks) - 1)
                hit = self.marks[at] == mark
                pair = np.unique(doc[hit] * len(self.marks) + at[hit])
                out[lo:hi] += np.bincount(pair // len(self.marks), weights=self.weights[pair % len(self.marks)], minlength=hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _fit_linear(rows: np.ndarray, cols: np.ndarray, n: int, width: int, q: np.ndarray, rounds: int = 300, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adam; deterministic."""
    w = np.zeros(width + 1)
    w[-1] = np.log(np.clip(q.mean(), 1e-3, 1 - 1e-3) / (1 - np.clip(q.mean(), 1e-3, 1 - 1e-3)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=w[cols], minlength=n) + w[-1], -30, 30)))
        gap = (p - q) / n
        g = np.append(np.bincount(cols, weights=gap[rows], minlength=width) + decay * w[:-1], gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _insult_marks() -> np.ndarray:
    return np.sort(_features([w.encode() for w in INSULTS])[1][: len(INSULTS)])


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier:
    """Fit on at most ``rows`` labelled rows that are not held out, in one task; without any, the insults alone score."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    given = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    # A doc_id may have many rows.
    given = given.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(rows)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for t, y, i in zip(_texts(batch), batch.column("toxic").to_pylist(), batch.column("doc_id").to_pylist()):
                _, mark, words = _features([t])
                out.append((i, y, int(words[0]), _shouts(t), np.unique(mark)[:ROW_FEATURES].copy()))
        model = _fitted(out)
        yield pa.RecordBatch.from_pylist([{"marks": model.marks.astype(np.int64), "weights": model.weights.astype(float), "bias": model.bias}], _MODEL)

    # The sample and its many arrays stay with a worker; the driver gets a row for the model.
    got = given.coalesce(1).mapInArrow(_tokens.tidy(fit), "marks array<long>, weights array<double>, bias double").toArrow().to_pylist()
    return Classifier(np.array(got[0]["marks"], dtype=np.uint32), np.array(got[0]["weights"]), got[0]["bias"]) if got else _fitted([])


def _fitted(sample: list[tuple]) -> Classifier:
    """The classifier for rows of doc_id, label, number of words, shouts and features; empties the list."""
    sample.sort(key=lambda x: (x[0], x[2]))
    y, words, shouts = (np.array([x[k] for x in sample], dtype=np.int64) for k in (1, 2, 3))
    if not len(y) or y.min() == y.max():
        marks = _insult_marks()
        return Classifier(marks, np.full(len(marks), 2.0), -1.0)
    sets = [x[4] for x in sample]
    sample.clear()
    names = np.concatenate(sets)
    names.sort()
    # Features of three rows or more; a row has each once.
    third = names[2:] == names[:-2] if len(names) > 2 else np.empty(0, dtype=bool)
    names = np.unique(names[2:][third])
    rows_, cols_ = [], []
    for i, s in enumerate(sets):
        at = np.searchsorted(names, s)
        ok = at < len(names)
        ok[ok] = names[at[ok]] == s[ok]
        cols_.append(at[ok].astype(np.int32))
        rows_.append(np.full(int(ok.sum()), i, dtype=np.int32))
    del sets, s
    row, col = np.concatenate(rows_), np.concatenate(cols_)
    del rows_, cols_
    n, width = len(y), len(names)

    # Lexicons of two folds, each for the other one's rows.
    fold = np.arange(n) % 2
    votes = [np.where(_hits(row, col, n, np.isin(names, _insult_marks())), 1, 0)]
    strong = []
    for f in (0, 1):
        pos, neg = (np.bincount(col[((fold != f) & (y == label))[row]], minlength=width) for label in (1, 0))
        share = max(1.0, float((y[fold != f] == 1).sum())) / max(1.0, float((y[fold != f] == 0).sum()))
        lift = np.log((pos + 0.5) / (neg + 0.5)) - np.log(share)
        strong.append((pos, lift))
    for least, above in ((2, 2.0), (3, 2.5), (6, 3.0)):
        hit = np.zeros(n, dtype=bool)
        for f in (0, 1):
            pos, lift = strong[f]
            hit |= (fold == f) & _hits(row, col, n, (pos >= least) & (lift > above))
        votes.append(np.where(hit, 1, np.where(words >= 3, -1, 0)))
    votes += [np.where(shouts & bit, 1, 0) for bit in (1, 2)]
    votes.append(np.where(y == 1, 1, -1))
    votes = np.stack(votes, axis=1)
    model = LabelModel(votes, np.where(y == 1, 0.8, 0.1))
    q = model.posterior(votes)

    total = np.bincount(col, minlength=width)
    toxic = np.bincount(col, weights=q[row], minlength=width)
    expected = total * q.mean()
    chi = (toxic - expected) ** 2 / (expected * (1 - total / (n + 1)) + 1e-9)
    best = np.sort(np.lexsort((names, -chi))[:FEATURES])
    to = np.full(width, -1)
    to[best] = np.arange(len(best))
    inside = to[col] >= 0
    row, col = row[inside], to[col[inside]]
    w, bias = _fit_linear(row, col, n, len(best), q)
    return Classifier(names[best], w, bias - _threshold(row, col, n, len(best), q, y))


def _threshold(row: np.ndarray, col: np.ndarray, n: int, width: int, q: np.ndarray, y: np.ndarray) -> float:
    """The log odds from which calling rows toxic agrees best (F1) with labels of rows that were not fitted on."""
    fold, odds = np.arange(n) % 2, np.zeros(n)
    for f in (0, 1):
        place = np.cumsum(fold != f) - 1
        mine = fold[row] != f
        w, bias = _fit_linear(place[row[mine]], col[mine], int((fold != f).sum()), width, q[fold != f])
        odds[fold == f] = (np.bincount(row, weights=w[col], minlength=n) + bias)[fold == f]
    order = np.argsort(-odds, kind="stable")
    right = np.cumsum(y[order] == 1)
    f1 = 2 * right / (np.arange(1, n + 1) + (y == 1).sum())
    best = int(np.argmax(f1))
    above, below = odds[order[best]], odds[order[min(best + 1, n - 1)]]
    return float(np.clip((above + below) / 2, -3, 3))


def _hits(row: np.ndarray, col: np.ndarray, n: int, chosen: np.ndarray) -> np.ndarray:
    return np.bincount(row[chosen[col]], minlength=n) > 0


def score(docs: DataFrame, model: Classifier, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, 0 to 1, in place of one of that name; null texts score as empty ones."""
    names = [c for c in docs.columns if c.lower() != name.lower()]
    schema = docs.select(*names).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(_texts(batch)))], [*names, name])

    return docs.select(*names).mapInArrow(_tokens.tidy(run), schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): ``doc_id, held_out, score, predicted``.

    Repeated rows, null doc_ids and null texts keep their rows; labels without a document,
    or of null, are not used; other columns are not read.
    """
    model = learn(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; columns of any name stay."""
    name = free_name("toxicity", docs.columns)
    return score(docs, learn(docs, labels), name).where(F.col(name) < 0.5).select(*docs.columns)
