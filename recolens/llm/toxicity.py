"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens (runs of letters) are tagged toxic or not.  Token labels come from the
document labels of a bounded sample: a greedy cover picks the few word and
affix markers that explain the toxic documents and are absent from the clean
ones; their occurrences in toxic documents are the labelled tokens.  The CRF
(hashed word, affix and neighbour features; two states) is fitted on windows
of that sample by gradients of its forward-backward marginals.

Scoring tags every whole text: exact marginals by forward-backward over the
full token chain, spans where they reach one half, and a document score from
the strongest marginal and the expected number of toxic tokens.

Defined results: a null or empty text, or one without letters, scores as a
document without toxic tokens; without both kinds of labelled rows the score is
the smoothed share of toxic labels; label rows with null id or null label teach
nothing, conflicting ones count as toxic; a null id is not held out; repeated
rows are scored each; an empty table gives an empty result.  The sample is bounded by
documents and characters and is all that the driver holds.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recolens.llm.frames import text_rows, written

#: Bound of the training sample: documents of each label, characters of one, and of all of a label.
SAMPLE_DOCS, SAMPLE_CHARS, TOTAL_CHARS = 2000, 30_000, 4_000_000
#: Bound of the training windows of each kind, and their tokens.
WINDOWS, WINDOW_TOKENS = 6000, 64
FEATURES = 1 << 18
#: Tokens of one padded group in forward-backward.
GROUP_TOKENS = 400_000

_LETTERS = re.compile(r"[^\W\d_]+")
_NONE = -12.0  # log-odds of a document without any token


def markers_of(word: str) -> list[str]:
    """The word and its affixes, as they may mark a toxic token."""
    out = ["=" + word]
    for n in (3, 4, 5):
        if len(word) > n:
            out += ["^" + word[:n], word[-n:] + "$"]
    return out


def features_of(word: str) -> list[int]:
    """Hashed features: the token's own (first), then as left and as right neighbour."""
    names = [*markers_of(word), "^" + word[:2], "<" + word, ">" + word]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in names]


@dataclass
class Model:
    weights: np.ndarray  # of hashed features, for the toxic state
    chain: np.ndarray    # log weights: start toxic, then [from][to] of the two states
    head: np.ndarray     # bias, weight of the strongest log-odds, weight of log(1 + expected tokens)


# ------------------------------------------------------------ the chain

def forward_backward(odds: np.ndarray, lengths: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the toxic state per token, and log-odds of the chain's left side.

    ``odds`` is (token, sequence), padded at the end of each sequence.  With two
    states a message is one number, its log-odds."""
    start, ((t00, t01), (t10, t11)) = chain[0], chain[1:].reshape(2, 2)
    left, right = np.empty_like(odds), np.zeros_like(odds)
    m = np.full(odds.shape[1], start)
    for t in range(len(odds)):
        left[t] = m + odds[t]
        m = np.logaddexp(t01, t11 + left[t]) - np.logaddexp(t00, t10 + left[t])
    for t in range(len(odds) - 2, -1, -1):
        after = right[t + 1] + odds[t + 1]
        right[t] = np.where(t + 1 < lengths, np.logaddexp(t10, t11 + after) - np.logaddexp(t00, t01 + after), 0.0)
    return left + right, left


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def train_chain(words: list[np.ndarray], labels: list[np.ndarray], table: np.ndarray, own: int,
                epochs: int = 4, batch: int = 256, rate: float = 0.3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """AdaGrad on the log-likelihood of label windows; ``table`` is features by word code."""
    rng = np.random.default_rng(seed)
    weights, chain = np.zeros(FEATURES), np.array([-2.0, 0.0, -2.0, 0.0, 0.0])
    g_w, g_c = np.full(FEATURES, 1e-2), np.full(5, 1.0)
    empty = len(table) - 1
    for _ in range(epochs):
        order = rng.permutation(len(words))
        for part in (order[i:i + batch] for i in range(0, len(order), batch)):
            lengths = np.array([len(words[i]) for i in part])
            code = np.full((int(lengths.max()), len(part)), empty)
            y = np.zeros(code.shape)
            for j, i in enumerate(part):
                code[:lengths[j], j], y[:lengths[j], j] = words[i], labels[i]
            there = np.arange(len(code))[:, None] < lengths
            feats = _token_features(code, table, own)
            odds = weights[feats].sum(axis=-1)
            total, left = forward_backward(odds, lengths, chain)
            p = sigmoid(total)
            error = np.where(there, p - y, 0.0)
            grad = np.bincount(feats.ravel(), weights=np.repeat(error.ravel(), feats.shape[-1]),
                               minlength=FEATURES) / len(part) + 1e-6 * weights
            pair = _pair_error(odds, left, total, y, there, chain)
            step = np.concatenate([[error[0].sum()], pair]) / len(part)
            g_w += grad ** 2
            g_c += step ** 2
            weights -= rate * grad / np.sqrt(g_w)
            chain -= rate * step / np.sqrt(g_c)
    return weights, chain


def _token_features(code: np.ndarray, table: np.ndarray, own: int) -> np.ndarray:
    """Own features of each token, then its neighbours' (rows are tokens)."""
    none = np.full_like(code[:1], len(table) - 1)
    before, after = np.concatenate([none, code[:-1]]), np.concatenate([code[1:], none])
    return np.concatenate([table[code][..., :own], table[before][..., own:own + 1],
                           table[after][..., own + 1:own + 2]], axis=-1)


def _pair_error(odds, left, total, y, there, chain) -> np.ndarray:
    """Expected minus observed transitions, by [from][to]."""
    if len(odds) < 2:
        return np.zeros(4)
    t = chain[1:].reshape(2, 2)
    right = total[1:] - left[1:] + odds[1:]
    logs = np.stack([np.zeros_like(right) + t[0, 0], t[0, 1] + right, t[1, 0] + left[:-1],
                     t[1, 1] + left[:-1] + right])
    expected = np.exp(logs - np.logaddexp.reduce(logs, axis=0))
    a, b = y[:-1], y[1:]
    seen = np.stack([(1 - a) * (1 - b), (1 - a) * b, a * (1 - b), a * b])
    return np.where(there[1:], expected - seen, 0.0).sum(axis=(1, 2))


# ------------------------------------------------------------- training

def find_markers(docs: list[np.ndarray], labels: list[int], words: list[str]) -> np.ndarray:
    """Which ``words`` are markers of toxic documents: by a greedy cover of the toxic ones,
    then whole words common among toxic documents and (nearly) absent from clean ones.

    ``docs`` are word codes; markers are numbered in the order of their names, each worked
    out once for a distinct word."""
    of_word = [markers_of(w) for w in words]
    names = sorted({m for ms in of_word for m in ms})
    place = {m: i for i, m in enumerate(names)}
    codes = [np.array([place[m] for m in ms], dtype=np.int32) for ms in of_word]
    toxic, of_clean, n_clean = [], np.zeros(len(names), np.int64), 0
    for doc, label in zip(docs, labels, strict=True):
        held = np.unique(np.concatenate([codes[w] for w in np.unique(doc)])) if len(doc) else np.zeros(0, np.int32)
        if label:
            toxic.append(held)
        else:
            of_clean[held] += 1
            n_clean += 1
    count = lambda held: np.bincount(np.concatenate(held), minlength=len(names)) if held else of_clean * 0
    of_toxic, share, least = count(toxic), 20 * len(toxic) / max(n_clean, 1), max(2, len(toxic) // 200)
    chosen = np.zeros(len(names), bool)
    open_docs, cover = toxic, of_toxic
    while open_docs and len(names):
        gain = np.where(cover > 0, cover - share * of_clean, -np.inf)
        best = int(gain.argmax())
        if gain[best] < least:
            break
        chosen[best] = True
        open_docs = [d for d in open_docs if best not in d]
        cover = count(open_docs)
    often = max(3, len(toxic) // 50)
    whole = np.array([m[0] == "=" for m in names], bool)
    chosen |= whole & (of_toxic >= often) & (of_clean * share <= of_toxic / 5)
    return np.array([chosen[c].any() for c in codes], bool)


def tokens(text: str) -> list[str]:
    return _LETTERS.findall(text)


def fit(sample: list[tuple[str, int]], seed: int = 7) -> Model:
    """Fit on (text, toxic 0/1) rows; repeated texts teach once."""
    rows = sorted(set(sample))
    n_toxic = sum(label for _, label in rows)
    prior = float(np.log((n_toxic + 0.5) / (len(rows) - n_toxic + 0.5)))
    none = Model(np.zeros(FEATURES), np.zeros(5), np.array([prior, 0.0, 0.0]))
    if not 0 < n_toxic < len(rows):
        return none
    number: dict[str, int] = {}
    coded = [np.array([number.setdefault(w.lower(), len(number)) for w in tokens(text)], dtype=np.int64) for text, _ in rows]
    labels = [label for _, label in rows]
    marked = find_markers(coded, labels, list(number))
    if not marked.any():
        return none
    table, own = feature_table(list(number))
    rng = np.random.default_rng(seed)
    kinds: tuple[list, list] = ([], [])
    for codes, label in zip(coded, labels, strict=True):
        y = marked[codes] * float(label) if len(codes) else np.zeros(0)
        for i in range(0, len(codes), WINDOW_TOKENS):
            part = slice(i, i + WINDOW_TOKENS)
            kinds[int(y[part].any())].append((codes[part], y[part]))
    chosen = [w for kind in kinds for w in (kind[i] for i in rng.permutation(len(kind))[:WINDOWS])]
    weights, chain = train_chain([w for w, _ in chosen], [y for _, y in chosen], table, own, seed=seed)
    model = Model(weights, chain, np.array([prior, 0.0, 0.0]))
    words = list(number)
    x = np.array([document_features(m) for at in range(0, len(coded), 500)
                  for m in tag([[words[c] for c in d] for d in coded[at:at + 500]], model)])
    model.head = _logistic(x, np.array(labels, float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Newton steps for a small, lightly penalised logistic regression; both classes weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (share * (p - y)) + 0.01 * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    return w


def feature_table(words: list[str]) -> tuple[np.ndarray, int]:
    """Hashed features by word code, own ones first, then as left and as right
    neighbour; missing places and the last row are feature 0, which has no weight."""
    feats = [features_of(w) for w in words]
    own = 8
    table = np.zeros((len(words) + 1, own + 2), np.int64)
    for i, f in enumerate(feats):
        table[i, :len(f) - 2] = f[:-2]
        table[i, own:] = f[-2:]
    return table, own


# -------------------------------------------------------------- scoring

def tag(docs: list[list[str]], model: Model) -> list[np.ndarray]:
    """Log-odds of the toxic state for every token of every document (lower-cased words)."""
    number: dict[str, int] = {}
    codes = [np.array([number.setdefault(w, len(number)) for w in d], dtype=np.int64) for d in docs]
    weights = model.weights.copy()
    weights[0] = 0.0
    table, own = feature_table(list(number))
    score = weights[table]
    alone, as_left, as_right = score[:, :own].sum(axis=1), score[:, own], score[:, own + 1]
    out: list[np.ndarray] = [np.zeros(0)] * len(docs)
    order = sorted((i for i in range(len(docs)) if len(codes[i])), key=lambda i: len(codes[i]))
    while order:
        longest = len(codes[order[-1]])
        group: list[int] = []
        while order and (not group or (len(group) + 1) * longest <= GROUP_TOKENS
                         and 3 * len(codes[order[-1]]) >= 2 * longest):
            group.append(order.pop())
        lengths = np.array([len(codes[i]) for i in group])
        odds = np.zeros((longest, len(group)))
        for j, i in enumerate(group):
            c = codes[i]
            odds[:len(c), j] = alone[c]
            odds[1:len(c), j] += as_left[c[:-1]]
            odds[:len(c) - 1, j] += as_right[c[1:]]
        total, _ = forward_backward(odds, lengths, model.chain)
        for j, i in enumerate(group):
            out[i] = total[:lengths[j], j].copy()
    return out


def document_features(marginal_odds: np.ndarray) -> tuple[float, float]:
    if not len(marginal_odds):
        return _NONE, 0.0
    return max(_NONE, min(-_NONE, float(marginal_odds.max()))), float(np.log1p(sigmoid(marginal_odds).sum()))


def spans(text: str, marginal_odds: np.ndarray) -> list[dict]:
    """Character offsets of runs of tokens whose marginal is one half or more."""
    out: list[dict] = []
    hits = np.flatnonzero(marginal_odds >= 0)
    if not len(hits):
        return out
    places = [m.span() for m in _LETTERS.finditer(text)]
    probability = sigmoid(marginal_odds)
    for run in np.split(hits, np.flatnonzero(np.diff(hits) > 1) + 1):
        out.append({"start": places[run[0]][0], "end": places[run[-1]][1],
                    "probability": float(probability[run].max())})
    return out


def _scored(model: Model):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                texts = batch.column(1).slice(at, 2000).to_pylist()
                odds = tag([[w.lower() for w in tokens(t)] for t in texts], model)
                x = np.array([(1.0, *document_features(o)) for o in odds])
                yield pa.record_batch([batch.column(0).slice(at, 2000), pa.array(sigmoid(x @ model.head)),
                                       pa.array([spans(t, o) for t, o in zip(texts, odds, strict=True)],
                                                pa.list_(span))], schema=schema)
    return run


def filter_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below one half."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                odds = tag([[w.lower() for w in tokens(t or "")] for t in part.column(at).to_pylist()], model)
                x = np.array([(1.0, *document_features(o)) for o in odds])
                yield part.filter(pa.array(x @ model.head < 0))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: crc32 of the id's text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS,
                    sample_chars: int = SAMPLE_CHARS, total_chars: int = TOTAL_CHARS) -> list[tuple[str, int]]:
    """(text, toxic) of at most ``sample_docs`` labelled ids of each kind, none held out,
    by a hash of the id.  An id gives one text, the one of the smallest hash; texts of more
    than ``sample_chars`` and those beyond ``total_chars`` of a kind in all are left out."""
    known = (labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    picked = [known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
              for kind in (0, 1)]
    rows = text_rows(docs).where(F.length("text") <= sample_chars)
    one_each = written(rows.join(F.broadcast(picked[0].unionAll(picked[1])), "doc_id").groupBy("doc_id", "toxic")
                       .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "toxicity-sample")
    left, chosen = [total_chars, total_chars], []
    for r in one_each.select("doc_id", "toxic", F.length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.n <= left[r.toxic]:
            left[r.toxic] -= r.n
            chosen.append(r.doc_id)
    return [(r.text, r.toxic) for r in one_each.where(F.col("doc_id").isin(chosen)).select("text", "toxic").collect()]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every document."""
    model = fit(training_sample(docs, labels))
    return (text_rows(docs).mapInArrow(
        _scored(model), "doc_id long, score double, spans array<struct<start: long, end: long, probability: double>>")
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans"))
