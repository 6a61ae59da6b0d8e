"""Personal data: base patterns, and a skip-chain conditional random field over the tokens around them."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

KINDS = ("email", "ip", "card", "phone")
#: Marginal probability from which a token is an entity, and rounds of message passing.
SURE, ROUNDS = 0.6, 10

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
#: A look behind keeps long digit runs linear; a match can't begin inside a run that it could have begun.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
#: Only tried where a token begins, so that a run without white space is read once.
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
#: The word before a token; longer ones count by their end.
_BEFORE = re.compile(r"([^\x20\x09-\x0D0-9@]{1,40})[\x20\x09-\x0D]+\Z")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from each at sign: the run of local characters before it can't hold
    one, so it starts where that run starts, or where the match before ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        after = _DOMAIN.match(text, at + 1) if start < at else None
        if after:
            yield start, after.end()
            done = after.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, by start, then kind."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---------------------------------------------------------------- the field

#: Label 0 is none; label k + 1 is KINDS[k].
LABELS = len(KINDS) + 1
_SHAPES = 14
#: Buckets of the word before a token; 0 is none. Counts that a bucket's or a pair's say is held back by,
#: and how much log odds a word, a neighbour, a shape and alike tokens may have.
WORDS, SHRINK = 1024, 20.0
MOST_WORD, MOST_CHAIN, MOST_SHAPE, LEAST_ALIKE, MOST_ALIKE = 2.0, 2.0, 3.0, 0.5, 4.0
#: Pairs of alike tokens with one label that count before any is seen, against one with two.
ALIKE = 20.0


def _shape(token: str, joined: bool) -> int:
    """What a token looks like, as bits."""
    digits = "".join(_DIGITS.findall(token))
    n, dots = len(digits), token.count(".")
    plain = token.strip(".,;:!?\"'()[]")
    bits = (
        "@" in token, "@" in token and "." in token.rpartition("@")[2].strip("."), n == 0, 1 <= n <= 4, 5 <= n <= 9, 10 <= n <= 13, 14 <= n <= 19, n > 19,
        dots >= 3 and bool(_IP.search(token)), "+" in token, "(" in token or ")" in token, any(c.isalpha() for c in token), plain.isdigit() and n >= 14 and luhn(digits), joined,
    )
    return sum(b << i for i, b in enumerate(bits))


def _alike(token: str) -> str | None:
    """What repeated or similar tokens share: their address, their last seven digits, or, with three to
    six digits, the whole token."""
    if "@" in token:
        return token.lower().strip(".,;:!?\"'()[]<>")
    digits = "".join(_DIGITS.findall(token))
    return digits[-7:] if len(digits) >= 7 else token.strip(".,;:!?\"'[]<>") if len(digits) >= 3 else None


def _word(text: str, start: int, after: int) -> int:
    """The bucket of the word before ``start`` (but not before ``after``), 0 if there is none."""
    m = _BEFORE.search(text, max(after, start - 48), start)
    word = m[1].strip(".,;:!?\"'()[]<>").lower() if m else ""
    return zlib.crc32(word.encode()) % (WORDS - 1) + 1 if word else 0


def graph(text: str, spans: list[tuple[int, int, int]]):
    """Tokens that hold a digit or an at sign: places, shapes, words before and base labels; chain edges
    with whether one white space parts them; skip edges between one token and the next that is alike.
    Neighbours that are alike and don't touch have the skip edge only."""
    place, shape, word, label, chain, skip = [], [], [], [], [], []
    last: dict[str, int] = {}
    at = 0
    for k, m in enumerate(_TOKEN.finditer(text)):
        joined = bool(place) and m.start() - place[-1][1] == 1
        while at < len(spans) and spans[at][2] <= m.start():
            at += 1
        inside = [x for x in spans[at : at + 4] if x[0] < m.end() and x[2] > m.start()]
        word.append(_word(text, m.start(), place[-1][1] if place else 0))
        place.append((m.start(), m.end()))
        shape.append(_shape(m[0], joined))
        label.append(inside[0][1] + 1 if inside else 0)
        key = _alike(m[0])
        tied = key is not None and key in last and not (joined and last[key] == k - 1)
        if tied:
            skip.append((last[key], k))
        if k and not (tied and last[key] == k - 1):
            chain.append((k - 1, k, int(joined)))
        if key is not None:
            last[key] = k
    return place, shape, word, label, chain, skip


def _tally(batches):
    """Counts that the potentials come from: (what, a, b, c). A token without a base label that is alike
    to one with a label is of unknown label and doesn't count."""
    for batch in batches:
        rows: dict[tuple[str, int, int, int], int] = {}

        def add(*key, rows=rows):
            rows[key] = rows.get(key, 0) + 1

        for text in batch.column(0):
            text = text.as_py()
            _, shape, word, label, chain, skip = graph(text, base_spans(text))
            tied = list(label)
            for i, j in skip + skip[::-1]:
                tied[i] = tied[j] = tied[i] or tied[j]
            known = [bool(y) or not t for y, t in zip(label, tied, strict=True)]
            for s, w, y, sure in zip(shape, word, label, known, strict=True):
                if sure:
                    add("shape", s, y, 0)
                    add("word", w, y, 0)
            for i, j, near in chain:
                if known[i] and known[j]:
                    add("chain", label[i], label[j], near)
            for i, j in skip:
                if known[i] and known[j]:
                    add("skip", int(label[i] == label[j]), 0, 0)
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]], pa.array(list(rows.values()), pa.int64())], ["what", "a", "b", "c", "n"])


class Field:
    """Log potentials: a softmax of shapes, the word before a token, chain tables by nearness, one weight
    for alike tokens."""

    def __init__(self, counts: list[tuple[str, int, int, int, int]]):
        shapes = sorted({a for what, a, *_ in counts if what == "shape"})
        seen = np.zeros((len(shapes), LABELS))
        chain = np.zeros((2, LABELS, LABELS))
        same = [1.0, ALIKE]
        word = np.zeros((WORDS, LABELS))
        for what, a, b, c, n in counts:
            if what == "shape":
                seen[shapes.index(a), b] += n
            elif what == "chain":
                chain[c, a, b] += n
            elif what == "word":
                word[a, b] += n
            else:
                same[a] += n
        bits = self.bits(np.array(shapes, np.int64))
        self.weight = np.zeros((bits.shape[1], LABELS))
        total = max(seen.sum(), 1.0)
        for _ in range(400):  # gradient steps on the mean log likelihood, with a small ridge
            p = self._softmax(bits @ self.weight)
            self.weight += 4.0 * (bits.T @ (seen - p * seen.sum(axis=1, keepdims=True)) / total - 1e-5 * self.weight)
        # how much likelier two labels are side by side than apart
        first, second = (chain.sum(axis=k, keepdims=True) + 1.0 for k in (2, 1))
        apart = first / first.sum(axis=1, keepdims=True) * (second / second.sum(axis=2, keepdims=True))
        joint = (chain + SHRINK * apart) / (chain.sum(axis=(1, 2), keepdims=True) + SHRINK)
        self.chain = np.clip(np.log(joint / apart), -MOST_CHAIN, MOST_CHAIN)
        self.skip = float(np.clip(np.log(same[1] / same[0]), LEAST_ALIKE, MOST_ALIKE)) * np.eye(LABELS)
        usual = (word.sum(axis=0) + 1) / (word.sum() + LABELS)
        self.word = np.clip(np.log((word + SHRINK * usual) / (word.sum(axis=1, keepdims=True) + SHRINK) / usual), -MOST_WORD, MOST_WORD)
        self.word[0] = 0

    @staticmethod
    def bits(shape: np.ndarray) -> np.ndarray:
        b = ((shape[:, None] >> np.arange(_SHAPES)) & 1).astype(float)
        return np.column_stack([np.ones(len(shape)), b])

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def own(self, shape: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log potentials of single tokens. What a shape says against a label is bounded, so that an alike
        token can say more."""
        own = self.bits(shape) @ self.weight
        return np.maximum(own - own.max(axis=1, keepdims=True), -MOST_SHAPE) + self.word[word]

    def marginals(self, shape: np.ndarray, word: np.ndarray, fixed: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Loopy sum-product over all edges at once; tokens with a base label are held to it."""
        own = self.own(shape, word)
        own[fixed > 0] = -12.0
        own[fixed > 0, fixed[fixed > 0]] = 12.0
        table = np.exp(np.concatenate([self.chain, self.skip[None]]))
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        pot = np.concatenate([table[kind], table[kind].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        msg = np.zeros((len(src), LABELS))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, dst, msg)
            out = belief[src] - msg[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("el,elm->em", out, pot) + 1e-30)
            msg = 0.5 * msg + 0.5 * (new - new.max(axis=1, keepdims=True))
        belief = own.copy()
        np.add.at(belief, dst, msg)
        return self._softmax(belief)


_TRIM = ".,;:!?\"'[]<>"


def _added(text: str, place, label, kind_of) -> list[tuple[int, int, int]]:
    """Spans of tokens that the field gives one kind and no base pattern touches; tokens in a row are
    one span only as parts of a number."""
    out: list[tuple[int, int, int]] = []
    run: list[int] = []

    def close():
        if run:
            s, e = place[run[0]][0], place[run[-1]][1]
            while s < e and text[s] in _TRIM:
                s += 1
            while e > s and text[e - 1] in _TRIM:
                e -= 1
            if s < e:
                out.append((s, kind_of[run[0]] - 1, e))
        run.clear()

    for k in range(len(place)):
        if kind_of[k] == 0 or label[k] > 0:
            close()
            continue
        own = kind_of[k] <= 2 or len(_DIGITS.findall(text[place[k][0] : place[k][1]])) >= 10
        if run and (own or kind_of[run[-1]] != kind_of[k] or place[k][0] - place[run[-1]][1] != 1):
            close()
        run.append(k)
    close()
    return out


def learn(docs: DataFrame, *, text_col: str = "text") -> Field:
    """Potentials from all texts that hold a digit or an at sign. Counts are taken on the executors and
    summed; the driver gets one row for each shape and label."""
    some = docs.select(F.col(f"`{text_col}`").alias("text")).where(F.col("text").rlike("[0-9@]"))
    got = some.mapInArrow(trimmed(_tally), "what string, a long, b long, c long, n long").groupBy("what", "a", "b", "c").agg(F.sum("n").alias("n")).collect()
    return Field(sorted((r.what, r.a, r.b, r.c, r.n) for r in got))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added for every row.

    Base spans are the patterns' matches; the field adds tokens that it takes for personal data
    because of what is next to them or alike elsewhere in the text, such as a number that is
    written out in full somewhere else. Added spans never overlap base ones. Null and empty texts
    have no span; repeated rows are rows of their own; an empty table gives no rows.
    """
    field = field or learn(docs, text_col=text_col)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            counts, digest, every, added = np.zeros((4, n), np.int64), [], [], np.zeros(n, np.int64)
            held, shape, word, fixed, a, b, kind, at = {}, [], [], [], [], [], [], 0
            for r, text in enumerate(batch.column(1)):
                text = text.as_py()
                if not text or not _ANY.search(text):
                    continue
                spans = base_spans(text)
                place, s, w, y, chain, skip = graph(text, spans)
                held[r] = (text, spans, place, y, at)
                shape += s
                word += w
                fixed += y
                a += [at + i for i, *_ in chain] + [at + i for i, _ in skip]
                b += [at + j for _, j, _ in chain] + [at + j for _, j in skip]
                kind += [near for *_, near in chain] + [2] * len(skip)
                at += len(place)
            if at:
                p = field.marginals(np.array(shape, np.int64), np.array(word, np.int64), np.array(fixed), *[np.array(x, np.int64) for x in (a, b, kind)])
                best = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0)
            for r in range(n):
                base, more = [], []
                if r in held:
                    text, base, place, y, k = held[r]
                    more = [x for x in _added(text, place, y, best[k : k + len(place)]) if not any(s < x[2] and e > x[0] for s, _, e in base)]
                for _, k, _ in base:
                    counts[k, r] += 1
                added[r] = len(more)
                say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                digest.append(hashlib.sha256(say(base).encode()).hexdigest())
                every.append(say(sorted(base + more)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts], pa.array(digest, pa.string()), pa.array(every, pa.string()), pa.array(added)], [*names])

    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    spec = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    # a text without a digit or an at sign has no span, so it needn't travel to Python
    text = F.when(F.col(f"`{text_col}`").rlike("[0-9@]"), F.col(f"`{text_col}`"))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(trimmed(run), spec)
