"""Toxicity by weak supervision.

Many voters look at a text: a general lexicon, words and word beginnings that labelled toxic texts have far more often
than others, and patterns of address and shouting.  A generative label model estimates each voter's rates in both
classes and the voters' correlations within them by expectation maximisation; correlated voters share their say.  Its
posterior labels train a regularised linear classifier over the votes and the density of hits, which scores any text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import byte_texts, lean, staged, table, text_slices
from siltstone.llm.decontaminate import words_of
from siltstone.llm.quality import fold, training_labels

SHORT, LONG = 4, 9  # bytes of the word beginnings that may vote
BLOCK = 4096  # rows whose votes the driver holds as numbers
OFTEN = 3  # words with a mark from which its second voter votes
LEXICON = {
    "insult": "idiot moron imbecile loser stupid dumb fool jerk clown cretin",
    "contempt": "pathetic worthless disgusting garbage trash scum filth vermin parasite pig",
    "hostility": "hate kill die destroy punch beat hurt shut despise loathe",
    "obscenity": "damn crap hell bastard bitch ass asshole shit fuck fucking",
}
_LEXICON = {name: frozenset(w.encode() for w in words.split()) for name, words in LEXICON.items()}
PATTERNS = {
    "you_are": re.compile(rb"\byou(?:'re| are| re) (?:an? |such an? |all |just )?(?:idiot|moron|loser|stupid|dumb|fool|pathetic|worthless|disgusting|trash|scum|clown)", re.I),
    "go_away": re.compile(rb"\b(?:shut up|go (?:away|die|to hell)|get lost|hate you|nobody likes)\b", re.I),
    "shouting": re.compile(rb"(?:\b[A-Z]{3,}\b[^A-Za-z]{1,3}){4}|!{3,}"),
    "starred": re.compile(rb"\b[A-Za-z]\*{2,}[A-Za-z]?\b"),
}


def _marks(word: bytes) -> list[bytes]:
    """What a word may vote by: itself (with an end sign) and its beginnings."""
    return [word + b"$", *(word[:k] for k in range(SHORT, min(LONG, len(word)) + 1))]


class Voters:
    def __init__(self, marks: list[bytes]):
        self.marks = marks
        self.number = {m: i for i, m in enumerate(marks)}
        self.gate = {m[:SHORT] if not m.endswith(b"$") else m[:-1][:SHORT] for m in marks}
        self.names = [*(m.decode("utf-8", "replace") for m in marks), *(f"{OFTEN} {m.decode('utf-8', 'replace')}" for m in marks), *LEXICON, *PATTERNS]

    def __call__(self, text: bytes) -> tuple[np.ndarray, int, int]:
        """Votes, hits and words of a text."""
        words = words_of(text)
        votes = np.zeros(len(self.names), bool)
        count = np.zeros(len(self.marks), np.int64)
        hits, gate, number = 0, self.gate, self.number
        for w in [w for w in words if w[:SHORT] in gate]:
            found = [number[m] for m in _marks(w) if m in number]
            if found:
                hits += 1
                count[found] += 1
        k = len(count)
        votes[:k], votes[k : 2 * k] = count > 0, count >= OFTEN
        own = set(words)
        for i, name in enumerate(LEXICON, 2 * k):
            votes[i] = not own.isdisjoint(_LEXICON[name])
        for i, name in enumerate(PATTERNS, 2 * k + len(LEXICON)):
            votes[i] = PATTERNS[name].search(text) is not None
        return votes, hits, len(words)


def features(votes: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([votes.astype(float), np.log1p(hits), np.log1p(1000.0 * hits / np.maximum(words, 1)), votes.any(axis=1), np.ones(len(votes))])


class Cast:
    """Votes, hits and words of many texts; a slice of it is the matrix of their features, so all of it is never held as numbers."""

    def __init__(self, votes: np.ndarray, hits: np.ndarray, words: np.ndarray):
        self.parts = votes, hits, words

    def __len__(self) -> int:
        return len(self.parts[0])

    def __getitem__(self, rows: slice) -> np.ndarray:
        return features(*(p[rows] for p in self.parts))


def _slices(n: int):
    return (slice(at, at + BLOCK) for at in range(0, n, BLOCK))


def label_model(votes: np.ndarray, start: np.ndarray, prior: float, label: np.ndarray, trust: float = 0.97, rounds: int = 12, strength: float = 50.0):
    """Posterior of class 1 for each row of votes, the voters' rates in both classes and their correlations.

    The rows' own labels are one more voter, right with probability ``trust`` (one half: no voter).  Without it the
    posteriors drift towards what the voters have in common: held-out accuracy at sf0.1 is then 0.948 instead of 0.993,
    recall 0.73 instead of 0.94.  ``start`` (2 x voters) holds the rates to begin with; ``strength`` rows of them stay
    in each update.  Votes that
    were cast together are divided by one plus what they correlate within the classes (their design effect), and so
    are those that were not cast: one voter alone has its full say, ten that always agree have little more than one.
    """
    k = votes.shape[1]
    rates, rho = start.copy(), np.zeros((k, k))
    if not len(votes):
        return np.zeros(0), rates, rho
    # Rows that vote alike have one posterior: sums go over the different ones, each as often as it comes.
    rows, back, n = np.unique(np.packbits(np.column_stack([votes, label == 1]), axis=1), axis=0, return_inverse=True, return_counts=True)
    r = np.full(len(rows), prior)
    for _ in range(rounds):
        yes, no = np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0])) / (1 + rho.sum(axis=1))
        total, one, two = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
        for at in _slices(len(rows)):
            v = np.unpackbits(rows[at], axis=1)[:, : k + 1].astype(float)
            v, own = v[:, :k], v[:, k]
            base = np.log(prior / (1 - prior)) + (2 * own - 1) * np.log(trust / (1 - trust))
            together = 1 + ((v @ rho) * v).sum(axis=1) / np.maximum(v.sum(axis=1), 1)
            r[at] = 1 / (1 + np.exp(-np.clip(base + v @ yes / together + (1 - v) @ no, -30, 30)))
            for y, weight in ((0, (1 - r[at]) * n[at]), (1, r[at] * n[at])):
                total[y] += weight.sum()
                one[y] += weight @ v
                two[y] += (v * weight[:, None]).T @ v
        fresh = np.zeros((k, k))
        for y in (0, 1):
            rates[y] = (one[y] + strength * start[y]) / (total[y] + strength)
            side = np.outer(rates[y], one[y])
            cov = (two[y] - side - side.T + total[y] * np.outer(rates[y], rates[y])) / (total[y] + strength)
            sd = np.sqrt(rates[y] * (1 - rates[y])) + 1e-9
            fresh = np.maximum(fresh, np.clip(cov / np.outer(sd, sd), 0, 1))
        np.fill_diagonal(fresh, 0)
        rho = np.where(fresh > 0.1, fresh, 0)
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
    return r[back.ravel()], rates, rho


def linear_model(x, target: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression on soft labels with a squared penalty (Newton steps; the last column is the bias).

    ``x`` is a matrix, or what gives one for each slice.
    """
    k = x[:0].shape[1]
    w = np.zeros(k)
    pull = np.full(k, penalty)
    pull[-1] = 1e-3
    for _ in range(rounds if len(x) else 0):
        square, slope = np.diag(pull), -pull * w
        for at in _slices(len(x)):
            part = x[at]
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            square += (part * (p * (1 - p) + 1e-9)[:, None]).T @ part
            slope += part.T @ (target[at] - p)
        step = np.linalg.solve(square, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Toxicity:
    def __init__(self, voters: Voters, weights: np.ndarray):
        self.voters, self.weights = voters, weights

    def scores(self, texts: list[bytes]) -> np.ndarray:
        got = [self.voters(t) for t in texts]
        if not got:
            return np.zeros(0)
        x = features(*(np.array(c) for c in zip(*got, strict=True)))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


_COUNTS = pa.schema([("mark", pa.binary()), ("toxic", pa.int64()), ("clean", pa.int64())])
_COUNTS_DDL = "mark binary, toxic long, clean long"


def _count(batches):
    """Texts of each class that have a mark, counted by batch."""
    for whole in batches:
        for batch in text_slices(whole, 0, 8 << 20):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(batch.column(1).to_pylist(), byte_texts(batch, 0), strict=True):
                counts[y].update({m for w in set(words_of(text)) for m in _marks(w)})
            for y, count in enumerate(counts):
                n, none = pa.array(count.values(), pa.int64()), pa.array(np.zeros(len(count), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.binary()), *((none, n) if y == 0 else (n, none))], schema=_COUNTS)


def _cast_votes(held):
    schema = pa.schema([("label", pa.int64()), ("votes", pa.binary()), ("hits", pa.int64()), ("words", pa.int64())])

    def run(batches):
        voters = held.value
        for whole in batches:
            for batch in text_slices(whole, 0, 8 << 20):
                got = [voters(t) for t in byte_texts(batch, 0)]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([np.packbits(v).tobytes() for v, _, _ in got], pa.binary()), pa.array([h for _, h, _ in got], pa.int64()), pa.array([n for _, _, n in got], pa.int64())], schema=schema)

    return run


def evidence(counts: DataFrame, n_toxic: int, n_clean: int, odds: float) -> DataFrame:
    """``mark, weight`` of the marks that toxic texts surely have ``odds`` times as often as others: two deviations off either count."""
    sure = (F.col("toxic") - 2 * F.sqrt("toxic")) / (n_toxic + 1) / ((F.col("clean") + 2 * F.sqrt("clean") + 3) / (n_clean + 1))
    return counts.withColumn("sure", sure).filter(F.col("sure") >= odds).select("mark", (F.col("toxic") * F.log("sure")).alias("weight"))


def choose_marks(weights: dict[bytes, float], most: int) -> list[bytes]:
    """The marks with most evidence; what begins with a chosen one is left out."""
    chosen: list[bytes] = []
    for m in sorted(weights, key=lambda m: (-round(weights[m], 6), len(m), m)):
        bare = m.rstrip(b"$")
        if not any(bare.startswith(c.rstrip(b"$")) for c in chosen):
            chosen.append(m)
        if len(chosen) == most:
            break
    return chosen


def fit(labelled: DataFrame, voters: int = 200, odds: float = 3.0) -> Toxicity:
    """Fit on the rows of ``(text, label)``, which the driver takes the votes of (some 30 bytes a row); see ``training_sample``.

    Every mark of these rows is counted in both classes; the driver gets those with evidence enough.  ``voters`` is the
    model's size: at most so many of them vote; at sf0.1 some 25 have evidence enough.  Without toxic or clean rows, the
    general voters and even rates are all there is.
    """
    sc = labelled.sparkSession.sparkContext
    rows = labelled.select("text", "label")
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = rows.mapInArrow(lean(_count), _COUNTS_DDL).groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    own = Voters(choose_marks({bytes(r.mark): r.weight for r in evidence(counts, n_toxic, n_clean, odds).collect()}, voters))
    cast = rows.mapInArrow(_cast_votes(sc.broadcast(own)), "label long, votes binary, hits long, words long").collect()
    k = len(own.names)
    votes = np.unpackbits(np.frombuffer(b"".join(r.votes for r in cast), np.uint8).reshape(len(cast), -(-k // 8)), axis=1)[:, :k].astype(bool)
    hits, words = np.array([r.hits for r in cast], np.int64), np.array([r.words for r in cast], np.int64)
    label = np.array([r.label for r in cast], np.int64)
    start = np.stack([(votes[label == y].sum(axis=0) + 0.5 * (1 + y)) / ((label == y).sum() + 10) for y in (0, 1)])
    start = np.clip(start, 1e-5, 1 - 1e-5)
    prior = float(np.clip((n_toxic + 1) / (n_toxic + n_clean + 2), 0.01, 0.99))
    posterior, _, _ = label_model(votes, start, prior, label)
    return Toxicity(own, linear_model(Cast(votes, hits, words), posterior))


def _scores(held):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        model = held.value
        for whole in batches:
            for batch in text_slices(whole, 1, 8 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(byte_texts(batch, 1)))], schema=schema)

    return run


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for each row, repeated ones too; null texts are scored as empty ones; other columns aren't read."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(lean(_scores(held)), "doc_id long, score double")


def training_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = 60_000) -> DataFrame:
    """``(text, label)`` of at most ``sample_rows`` labelled documents, from all folds but that with crc32(doc_id) mod 5 = 0.

    The bound holds for the labels that train, in the order of a hash of their ids, and so for what is broadcast to
    find their texts (16 bytes a row); scores cover all documents.
    """
    drawn = training_labels(labels, "toxic", fold(F.col("doc_id"), 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return staged(d.join(F.broadcast(drawn), "doc_id").select("text", "label"), "labelled")


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Toxicity:
    return fit(training_sample(docs, labels))


def op10_toxicity_weak(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, repeated ones too; null texts are scored as empty ones, null ids are not held out; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
