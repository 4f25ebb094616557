"""Quality rules: a linear-chain CRF labels each line as content or boilerplate.

Base rules count words, symbols, repeated lines and repeated words. A document that passes them is kept if Viterbi decoding of
its line sequence leaves a great enough share of its words in content lines.

Labels come by document, lines have none, so they are drawn from how lines stand in documents of both labels: a line of a rejected
document that looks like those of kept ones is content, one of a kept document that looks like those of rejected ones is
boilerplate (``line_labels``). The CRF learns these sequences, which change within a document. The share that keeps a document is
that which tells the sample's labels apart best.

Defined cases: a null or empty text has no words, so it fails the base rules. Without labelled rows the model has zero weights
and takes every line as content. Ties in decoding go to content. Equal rows get equal results; a null doc_id stays null.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame

from textloom.llm import common

MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 50, 50, 0.5
#: Chances of content at which a line of a kept and of a rejected document counts as content.
LIKE_REJECTED, LIKE_KEPT, ROUNDS = 0.2, 0.5, 3
#: Labelled documents that the model is fitted on, at most.
SAMPLE = 3000
SYMBOLS = b"[#*$%&|<>]"[1:-1]
UPPER, LOWER, DIGITS, SHOUT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?"
WHITE = b" \t\n\x0b\x0c\r"
N_FEATURES = 13
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_content_lines long, content_share double, kept boolean"


@dataclass(frozen=True)
class LineCrf:
    """Two labels, 0 boilerplate and 1 content; log-linear emissions and transitions."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros((N_FEATURES, 2)))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    least: float = MIN_CONTENT  # share of words in content lines that keeps a document

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest label sequence of the lines x; of equal ones that with more content at its end."""
        e = x @ self.emit
        if not len(e):
            return np.zeros(0, np.int8)
        (s00, s01), (s10, s11) = self.step.tolist()
        rows = e.tolist()
        a, b = rows[0][0] + self.start[0], rows[0][1] + self.start[1]
        back = []
        for e0, e1 in rows[1:]:
            to0, to1 = b + s10 >= a + s00, b + s11 >= a + s01
            back.append((to0, to1))
            a, b = (b + s10 if to0 else a + s00) + e0, (b + s11 if to1 else a + s01) + e1
        y = int(b >= a)
        path = [y]
        for two in reversed(back):
            y = int(two[y])
            path.append(y)
        return np.array(path[::-1], np.int8)


def count_in(line: bytes, these: bytes) -> int:
    return len(line) - len(line.translate(None, these))


def line_features(lines: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """A row of features for each line with a word, and the line's number of words."""
    seen: set[bytes] = set()
    out, words = [], []
    for line in lines:
        w = line.split()
        n = len(w)
        chars = sum(map(len, w))
        up, low = count_in(line, UPPER), count_in(line, LOWER)
        sym, digits, shout = count_in(line, SYMBOLS), count_in(line, DIGITS), line.count(b"!!")
        last = w[-1][-1:]
        out.append((1, sym > 0.02 * chars, sym > 0.12 * chars, up > 0.5 * (up + low) and up > 3, up > 0.2 * (up + low), shout > 0, digits > 0.15 * chars, n <= 3, n >= 12, last in b".!?:;\"'" and bool(last), line in seen, len(set(w)) < 0.6 * n, low + up < 0.4 * chars))
        seen.add(line)
        words.append(n)
    return np.array(out, np.float64).reshape(-1, N_FEATURES), words


def repeated_words(h: np.ndarray) -> int:
    """Word positions inside a window of three words that occurs twice or more."""
    if len(h) < 4:
        return 0
    win = common.shingle_hashes(h, 3)
    order = np.argsort(win, kind="stable")
    same = win[order][1:] == win[order][:-1]
    twice = np.zeros(len(win), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(h), bool)
    for k in range(3):
        hit[k : k + len(win)] |= twice
    return int(hit.sum())


def judged(rows: Iterable[tuple], crf: LineCrf) -> Iterator[tuple]:
    for doc_id, text in rows:
        words = text.split()  # ASCII white space only
        white = count_in(text, WHITE)
        points = len(text) - count_in(text, bytes(range(0x80, 0xC0)))
        lines = [x for x in text.split(b"\n") if x.strip()]
        repeat = repeated_words(common.word_hashes(text.translate(common.SPACE))[0])
        n = len(words)
        failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
        x, counts = line_features(lines)
        y = crf.decode(x)
        share = float(np.dot(y, counts)) / n if n else 0.0
        yield doc_id, n, points - white, count_in(text, SYMBOLS), len(lines) - len(set(lines)), repeat, failed, len(lines), int(y.sum()), share, not failed and share >= crf.least


def fit_crf(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, rounds: int = 120) -> LineCrf:
    """Maximum likelihood on at most bound labelled documents, with labels of lines drawn from those of documents."""
    sample = common.labelled_sample(docs, labels, "quality", bound)

    def features(rows: Iterable[tuple]) -> Iterator[tuple]:
        for doc_id, y, text in rows:
            x, words = line_features([z for z in text.split(b"\n") if z.strip()])
            yield doc_id, y, len(x), x.astype(np.int8).tobytes(), words

    # At most bound rows of N_FEATURES bytes a line.
    got = common.map_docs(sample, features, "doc_id long, y int, n int, x binary, words array<int>", "doc_id", "y").collect()
    got = sorted((r for r in got if r.n), key=lambda r: (r.doc_id, r.x))
    if len({r.y for r in got}) < 2:
        return LineCrf()
    docs_x = [np.frombuffer(bytes(r.x), np.int8).reshape(-1, N_FEATURES).astype(np.float64) for r in got]
    y = np.array([int(r.y > 0) for r in got])
    crf = _maximised(docs_x, y, line_labels(docs_x, y), rounds)
    return replace(crf, least=best_share(crf, docs_x, [np.array(r.words) for r in got], y))


def line_labels(docs_x: list[np.ndarray], y: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A label for each line: a model of single lines is fitted to the labels so far, at first those of the documents, and relabels them.

    A rejected document keeps the boilerplate line that is least like content, a kept one the line that is most like it.
    """
    lengths = np.array([len(x) for x in docs_x])
    flat, doc = np.concatenate(docs_x), np.repeat(np.arange(len(y)), lengths)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    each = (np.array([0.5 / max(1, (y == k).sum()) for k in (0, 1)])[y] / lengths)[doc]
    gold = y[doc].astype(float)
    for _ in range(rounds):
        w, seen = np.zeros(flat.shape[1]), np.full(flat.shape[1], 1e-8)
        for _ in range(200):
            g = flat.T @ ((gold - 1 / (1 + np.exp(-flat @ w))) * each) - 1e-4 * w
            seen += g * g
            w += 0.5 * g / np.sqrt(seen)
        p = 1 / (1 + np.exp(-flat @ w))
        gold = np.where(y[doc] == 1, p >= LIKE_REJECTED, p >= LIKE_KEPT).astype(float)
        for k, pick in ((0, np.minimum), (1, np.maximum)):
            end = pick.reduceat(p, first)[doc] == p
            gold[end & (y[doc] == k)] = k
    return np.split(gold.astype(int), first[1:])


def best_share(crf: LineCrf, docs_x: list[np.ndarray], words: list[np.ndarray], y: np.ndarray) -> float:
    """The least share of content that keeps a document: that of the best mean accuracy over both labels, of equal ones the smallest."""
    share = np.array([np.dot(crf.decode(x), w) / max(1, w.sum()) for x, w in zip(docs_x, words, strict=True)])
    grid = np.linspace(0.05, 0.95, 19)
    right = [((share >= t) & (y == 1)).sum() / (y == 1).sum() + ((share < t) & (y == 0)).sum() / (y == 0).sum() for t in grid]
    return float(grid[int(np.argmax(right))])


def _maximised(docs_x: list[np.ndarray], y: np.ndarray, labels: list[np.ndarray], rounds: int, rate: float = 0.5, l2: float = 1e-3) -> LineCrf:
    """Gradient ascent with per-weight steps on the log-likelihood of the labels, by forward and backward sums over all documents at once."""
    order = np.argsort([-len(x) for x in docs_x], kind="stable")
    docs_x, y, labels = [docs_x[i] for i in order], y[order], [labels[i] for i in order]
    lengths = np.array([len(x) for x in docs_x])
    total, longest = lengths.sum(), lengths.max()
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.concatenate(docs_x)
    gold = np.zeros((len(flat), 2))
    gold[np.arange(len(flat)), np.concatenate(labels)] = 1
    live = [int((lengths > t).sum()) for t in range(longest)]
    weight = np.array([0.5 / max(1, (y == k).sum()) for k in (0, 1)])[y] * len(y)  # both labels count alike
    each = np.repeat(weight / lengths, lengths)[:, None]
    emit, step, start = np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)
    sums = [np.full(p.shape, 1e-8) for p in (emit, step, start)]
    for _ in range(rounds):
        e = flat @ emit
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[first] = e[first] + start
        for t in range(1, longest):
            i = first[: live[t]] + t
            alpha[i] = np.logaddexp(alpha[i - 1][:, :1] + step[0], alpha[i - 1][:, 1:] + step[1]) + e[i]
        for t in range(longest - 2, -1, -1):
            i = first[: live[t + 1]] + t
            ahead = beta[i + 1] + e[i + 1]
            beta[i] = np.stack([np.logaddexp(step[k, 0] + ahead[:, 0], step[k, 1] + ahead[:, 1]) for k in (0, 1)], 1)
        end = first + lengths - 1
        z = np.repeat(np.logaddexp(alpha[end, 0], alpha[end, 1]), lengths)[:, None]
        p = np.exp(alpha + beta - z)
        g_emit = flat.T @ ((gold - p) * each)
        g_start = ((gold - p)[first] * each[first]).sum(0)
        inner = np.ones(len(flat), bool)
        inner[first] = False
        j = np.flatnonzero(inner)
        pair = np.exp(alpha[j - 1][:, :, None] + step[None] + (e[j] + beta[j])[:, None, :] - z[j][:, :, None])
        true = gold[j - 1][:, :, None] * gold[j][:, None, :]
        g_step = ((true - pair) * each[j][:, :, None]).sum(0)
        for w, g, s in ((emit, g_emit, sums[0]), (step, g_step, sums[1]), (start, g_start, sums[2])):
            g = g / len(y) - l2 * w
            s += g * g
            w += rate * g / np.sqrt(s)
    return LineCrf(emit, step, start)


def quality(docs: DataFrame, crf: LineCrf) -> DataFrame:
    """One row per document: the base counts, the decoded share of content and the verdict. No shuffle."""
    return common.map_docs(common.as_docs(docs), lambda rows: judged(rows, crf), SCHEMA, "doc_id")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return quality(docs, fit_crf(docs, common.table(spark, sf_dir, "labels")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of docs that the rules keep; the verdict stands beside the row, so nothing is joined."""
    crf = fit_crf(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return common.filtered(docs, lambda text: next(judged([(None, text)], crf))[-1])
