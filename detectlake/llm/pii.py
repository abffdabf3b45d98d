"""Personal data: fixed patterns, and a skip-chain conditional random field (CRF) that adds to them.

The CRF labels the tokens that hold a digit or an at sign. Neighbours in a run of such tokens share
potentials, and so do distant tokens of equal text, of equal shape, or of equal letters and digits, each
linked to its next occurrence, so that links are linear in tokens. Tokens that a pattern covers are held to
its kind, and loopy belief propagation, in sweeps from end to end, carries that to what repeats or resembles
them anywhere in the document. Weights are learnt by pseudo-likelihood from a bounded sample in which the
patterns give the labels; there, mentions are repeated in broken forms that no pattern matches, and forms are
masked, so that words around a token and its links carry weight. A token is added if its kind is nearly
sure. Spans found by the patterns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import mul, truediv

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
#: About so many documents with candidate tokens are learnt from, by the order of a hash, and at most so many of
#: their tokens; a document with more than a fiftieth of them isn't learnt from.
SAMPLE_DOCS, SAMPLE_TOKENS = 2_000, 100_000
#: Added tokens need this probability.
SURE = 0.95
#: Messages that change by less than this share aren't sent again; after so many rounds without an end, steps are halved.
TOLERANCE, PATIENCE = 1e-6, 16

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits, as one would have begun before it
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK, _REST = re.compile(r"[0-9@]"), re.compile(r"\S*")
_HEAD, _TAIL = re.compile(r"[A-Za-z0-9+(]"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789)")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at signs: the longest local part before one and domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all pattern matches, by kind and start."""
    found = [(0, *x) for x in emails(text)] if "@" in text else []
    if not re.search("[0-9]", text):
        return found
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def short(name: str, most: int) -> str:
    """The name itself, or a digest of all of it if it is longer."""
    return name if len(name) <= most else "#" + hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def shape(token: str) -> str:
    """Runs of letters as a, of digits as their length, other signs as they are; a digest beyond 24 characters."""
    return short(re.sub(r"[0-9]+", lambda m: f"{len(m[0])};", re.sub(r"[^\W\d_]+", "a", token)), 24)


def bucket(n: int) -> int:
    return next(i for i, top in enumerate((0, 1, 2, 3, 4, 7, 11, 15, 19, 40, 1 << 60)) if n <= top)


#: Links: neighbours, equal texts, equal shapes, equal letters and digits. Cores shorter than this link nothing.
LINKS, CORE = 4, 4
#: The features of a token that don't come from its form.
AROUND = ("bias", "run", "before", "after")


@dataclass
class Document:
    """The candidate tokens of a text: spans, features (names), links (from, to, type) and pattern labels."""

    spans: list[tuple[int, int]] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    links: list[tuple[int, int, int]] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)


def core(token: str) -> str:
    """Letters and digits, lower-cased, of what stands before an at sign, written as a sign or in brackets."""
    return re.sub(r"[\W_]", "", re.split(r"@|[(\[]at[)\]]", token, maxsplit=1)[0].lower())


def near_word(text: str, start: int, end: int, last: bool) -> str:
    """The letters of the last, or first, word in a stretch of text; words with digits count as one."""
    found = text[max(0, start) : end].split()
    word = (found[-1] if last else found[0]) if found else ""
    return "0" if re.search("[0-9]", word) else re.sub(r"[\W_]", "", word.lower())[:12]


def marked_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens between white space with a digit or an at sign, without signs around them; linear in any text."""
    done = 0
    while m := _MARK.search(text, done):
        start, end = m.start(), _REST.match(text, m.end()).end()
        while start > done and not text[start - 1].isspace():
            start -= 1
        done = end
        head = _HEAD.search(text, start, end)
        while end > start and text[end - 1] not in _TAIL:
            end -= 1
        if head and head.start() < end:
            yield head.start(), end


def candidates(text: str, base: list[tuple[int, int, int]]) -> Document:
    doc, last = Document(), [{}, {}, {}]
    covered = sorted((s, e, k + 1) for k, s, e in base)
    at, end_before = 0, -9
    for start, end in marked_tokens(text):
        token, i = text[start:end], len(doc.spans)
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        doc.labels.append(next((k for s, e, k in covered[at : at + 4] if s < end and e > start), 0))
        form, digits, run = shape(token), sum(c.isdigit() for c in token), start - end_before <= 2
        doc.spans.append((start, end))
        around = [f"run {run}", f"before {near_word(text, start - 30, start, True)}", f"after {near_word(text, end, end + 30, False)}"]
        doc.features.append(["bias", f"shape {form}", f"digits {bucket(digits)}", f"length {bucket(len(token))}", f"dots {bucket(token.count('.'))}", f"at {token.count('@') > 0}", f"plus {token[0] == '+'}", f"dash {bucket(token.count('-'))}", f"only {digits == len(token)}", *around])
        linked = set()
        if i and run:
            doc.links.append((i - 1, i, 0))
            linked.add(i - 1)
        own = core(token)
        for kind, key in enumerate((short(token, 200), form, short(own, 200) if len(own) >= CORE else None)):
            if key is None:
                continue
            if (j := last[kind].get(key)) is not None and j not in linked:
                doc.links.append((j, i, kind + 1))
                linked.add(j)
            last[kind][key] = i
        end_before = end
    return doc


#: How a mention of each kind is broken: all its forms, from the text that a pattern matched.
BROKEN = (
    lambda m: [m.split("@")[0], m.replace("@", "(at)"), m.replace("@", " @ ")],
    lambda m: [m.replace(".", "[.]"), m.replace(".", "-")],
    lambda m: [".".join(re.sub("[^0-9]", "", m)[i : i + 4] for i in range(0, 20, 4)).rstrip("."), "/".join(re.sub("[^0-9]", "", m)[i : i + 4] for i in range(0, 20, 4)).rstrip("/")],
    lambda m: [m.lstrip("+"), re.sub(r"[^0-9]+", "/", m.lstrip("+")), m],
)


def with_broken(text: str, base: list[tuple[int, int, int]], seed: int) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with some mentions repeated behind it in forms that no pattern matches, and all spans.

    Each stands between the words that it stood between; a phone number may also stand whole in front of an
    address, which its pattern takes for more of its digits.
    """
    parts, spans, at = [text], list(base), len(text)
    address = next((text[s:e] for k, s, e in base if k == 1), "192.0.2.17")
    for n, (kind, start, end) in enumerate(base[:40]):
        forms = BROKEN[kind](text[start:end])
        form = forms[(seed + n) % len(forms)]
        before, after = text[max(0, start - 30) : start].split()[-1:], text[end : end + 30].split()[:1]
        lead = "\n" + "".join(f"{w} " for w in before)
        at += len(lead)
        spans.append((kind, at, at + len(form)))
        if form == text[start:end]:
            spans.append((1, at + len(form) + 1, at + len(form) + 1 + len(address)))
            after = [address, *after]
        parts += [lead, form, "".join(f" {w}" for w in after)]
        at += sum(map(len, parts[-2:]))
    return "".join(parts), spans


@dataclass(frozen=True)
class Crf:
    """Weights by feature and label, and of links by type (label by label)."""

    index: dict[str, int]
    weights: np.ndarray
    links: np.ndarray

    def unary(self, doc: Document) -> np.ndarray:
        out = np.zeros((len(doc.spans), LABELS))
        for i, names in enumerate(doc.features):
            out[i] = self.weights[[self.index[f] for f in names if f in self.index]].sum(0)
        return out

    def marginals(self, doc: Document) -> np.ndarray:
        """Label probabilities by sum-product messages over the links; what a pattern covers has its label for sure."""
        unary = self.unary(doc)
        p = np.exp(unary - unary.max(1, keepdims=True))
        for i, label in enumerate(doc.labels):
            if label:
                p[i] = np.eye(LABELS)[label]
        if doc.links:
            p = np.array(self.swept(p.tolist(), doc.links))
        return p / p.sum(1, keepdims=True)

    def swept(self, local: list[list[float]], links: list[tuple[int, int, int]]) -> list[list[float]]:
        """Beliefs (not normed) of tokens after messages have gone forward and backward until they stay.

        A sweep takes the tokens in order, so that a message crosses the document in it, however many links
        it has; tokens that have heard nothing new are passed over. On chains two sweeps are exact. Should
        messages of a document with loops swing, steps that get shorter bring them to rest.
        """
        pair = np.exp(self.links - self.links.max((1, 2), keepdims=True))
        # for each kind of link and label of the receiver, the weights of the sender's labels
        weights = pair.transpose(0, 2, 1).tolist(), pair.tolist()
        sends: tuple[list, list] = [[] for _ in local], [[] for _ in local]
        for e, (a, b, kind) in enumerate(links):
            sends[0][a].append((e, b, weights[0][kind]))
            sends[1][b].append((e, a, weights[1][kind]))
        message = [[1.0] * LABELS] * len(links), [[1.0] * LABELS] * len(links)

        def belief(i: int) -> list[float]:
            out = local[i]
            for way in (0, 1):
                for e, _, _ in sends[1 - way][i]:
                    out = list(map(mul, out, message[way][e]))
            return out

        todo = bytearray(b"\1") * len(local), bytearray(b"\1") * len(local)
        orders, rounds = (range(len(local)), range(len(local) - 1, -1, -1)), 0
        while any(todo[0]) or any(todo[1]):
            step = 0.5 ** (rounds // PATIENCE)
            rounds += 1
            for way in (0, 1):
                for i in orders[way]:
                    if not todo[way][i]:
                        continue
                    todo[way][i] = 0
                    if not sends[way][i]:
                        continue
                    own = belief(i)
                    for e, to, columns in sends[way][i]:
                        old, rest = message[way][e], list(map(truediv, own, message[1 - way][e]))
                        new = [sum(map(mul, rest, c)) for c in columns]
                        top = max(new)
                        new = [x / top for x in new]
                        if step < 1:
                            new = [x**step * y ** (1 - step) for x, y in zip(new, old, strict=True)]
                        if any(abs(x - y) > TOLERANCE * y for x, y in zip(new, old, strict=True)):
                            message[way][e] = new
                            todo[0][to] = todo[1][to] = 1
                            todo[way][i] |= step < 1
        return [belief(i) for i in range(len(local))]

    def added(self, doc: Document) -> list[tuple[int, int, int]]:
        """(kind, start, end) of tokens that no pattern has and that are nearly sure to be of a kind."""
        if not doc.spans or all(doc.labels):
            return []
        p = self.marginals(doc)
        out: list[tuple[int, int, int]] = []
        for i, best in enumerate(p.argmax(1).tolist()):
            if best and not doc.labels[i] and p[i, best] >= SURE:
                start, end = doc.spans[i]
                if out and out[-1][0] == best - 1 and start - out[-1][2] <= 1:
                    start = out.pop()[1]
                out.append((best - 1, start, end))
        return out


def fit(docs: list[Document], steps: int = 200, rate: float = 0.5, ridge: float = 3e-3) -> Crf | None:
    """Weights by pseudo-likelihood: each token's label given its features and its neighbours' labels.

    All documents are gone over twice, the second time with the forms of every other token masked.
    """
    if not any(any(d.labels) for d in docs):
        return None
    index: dict[str, int] = {"masked": 0}
    rows, labels, links, base = [], [], [], 0
    for masked in (False, True):
        for d in docs:
            for i, names in enumerate(d.features):
                hide = masked and (i + base) % 2
                rows.append([0 if hide and f.split(" ")[0] not in AROUND else index.setdefault(f, len(index)) for f in names])
            labels += d.labels
            links += [(a + base, b + base, k) for a, b, k in d.links]
            base += len(d.spans)
    x, y = np.array(rows), np.array(labels)
    a, b, kind = np.array(links, dtype=np.int64).reshape(-1, 3).T
    target = np.eye(LABELS)[y]
    weights, pair = np.zeros((len(index), LABELS)), np.zeros((LINKS, LABELS, LABELS))
    squares = [np.full_like(weights, 1e-6), np.full_like(pair, 1e-6)]
    for _ in range(steps):
        z = weights[x].sum(1)
        np.add.at(z, b, pair[kind, y[a]])
        np.add.at(z, a, pair[kind, :, y[b]])
        p = np.exp(z - z.max(1, keepdims=True))
        off = (p / p.sum(1, keepdims=True) - target) / len(y)
        flat = np.stack([np.bincount(x.ravel(), np.repeat(off[:, k], x.shape[1]), len(index)) for k in range(LABELS)], 1)
        both = np.zeros_like(pair)
        np.add.at(both, (kind, y[a]), off[b])
        np.add.at(both.transpose(0, 2, 1), (kind, y[b]), off[a])
        agree = np.eye(LABELS, dtype=bool)
        for k in range(1, LINKS):  # distant links share one weight for agreement
            both[k] = np.where(agree, both[k][agree].mean(), 0.0)
        for w, g, s in ((weights, flat + ridge * weights / 10, squares[0]), (pair, both + ridge * pair, squares[1])):
            s += g**2
            w -= rate * g / np.sqrt(s)
    return Crf(index, weights, pair)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_tokens: int = SAMPLE_TOKENS) -> Crf | None:
    """A CRF learnt from about ``sample_docs`` documents with candidate tokens; None if no pattern matches there.

    They are chosen by a hash of id and text and taken in its order, so that another partitioning learns the
    same. Those with more than ``sample_tokens / 50`` tokens aren't learnt from, and the last ones neither if
    tokens would be more than ``sample_tokens``: both bound what is learnt from, not what is tagged.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").where(F.col("text").rlike("[0-9@]"))
    every = max(1, rows.count() // sample_docs)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                base = base_spans(text)
                doc = candidates(*with_broken(text, base, h)) if base else candidates(text, base)
                if 0 < len(doc.spans) <= sample_tokens // 50:
                    parts = ((h, pa.int64()), (len(doc.spans), pa.int64()), (doc.features, pa.list_(pa.list_(pa.string()))), ([list(k) for k in doc.links], pa.list_(pa.list_(pa.int64()))), (doc.labels, pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in parts], ["h", "n", "features", "links", "labels"])

    schema = "h long, n long, features array<array<string>>, links array<array<long>>, labels array<long>"
    picked = materialise(rows.where(F.pmod("h", F.lit(every)) == 0).mapInArrow(tokens, schema), "tokens")
    last, total = None, 0
    for r in picked.select("h", "n").orderBy("h", "n").limit(2 * sample_docs).collect():
        total += r.n
        if total > sample_tokens:
            break
        last = r.h
    out = picked.where(F.col("h") <= last).orderBy("h", "n").limit(2 * sample_docs).collect() if last is not None else []
    return fit([Document([(0, 0)] * r.n, r.features, [tuple(k) for k in r.links], r.labels) for r in out])


def find_spans(text: str, crf: Crf | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The patterns' spans and all spans, each by kind and start."""
    base = base_spans(text)
    if crf is None or not re.search("[0-9@]", text):
        return base, base
    more = crf.added(candidates(text, base))
    return base, sorted(base + more) if more else base


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, crf: Crf | None) -> DataFrame:
    """doc_id, counts of the patterns' spans by kind, base_sha256 and spans for each row.

    Null text counts as empty; offsets are code points; repeated rows get a row each; an empty table gives
    none. Texts of any length are read whole. Other columns aren't read.
    """

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t.as_py() or "", crf) for t in batch.column(1)]
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([written(every) for _, every in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tag, schema)


def redacted(text: Column, crf: Crf | None) -> Column:
    """The text with each span replaced by its kind in square brackets; overlapping spans as one."""

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        out, done = [], 0
        for start, end, kind in sorted((s, e, k) for k, s, e in find_spans(value, crf)[1]):
            if start >= done:
                out += [value[done:start], f"[{KINDS[kind].upper()}]"]
            done = max(done, end)
        return "".join([*out, value[done:]]) if out else value

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(clean)

    return redact(text)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_pii(docs, train(docs))
