"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers; those spans always stay. The field then
labels the other tokens that hold a digit or an @, or that share a key with a token in which a pattern saw an entity:
neighbours share transition potentials, and distant tokens that are the same or alike (same digits, same letters and
digits, or the local part of an address) share agreement potentials, one for each kind of likeness. Loopy message passing
carries a label from the places where a pattern saw an entity to its other mentions in the document, such as a card
number written without its grouping, or the name before the @ of an address.

The field is trained piecewise: each factor is fit alone, by maximum likelihood, to the patterns' labels over the whole
corpus. For factors that are tables that has a closed form in counts: tokens by shape and label, neighbouring labels
over chance, and the odds that alike tokens agree. The counts are a table of some thousand cells, whatever the input.
What patterns don't label says nothing about tokens that are in the field for their likeness alone: these have a uniform
factor of their own and no neighbours, and aren't counted.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textbatch import as_strings

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # the last is `other`
OTHER = len(KINDS)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Inside a run of digits no match begins that would not begin at the run's start, so only starts of runs are tried.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
EVIDENCE = "[0-9@]"
ROUNDS = 12
DAMPING = 0.5
#: A mention is added if it is other than `other` with this probability.
SURE = 0.9
KEY_CHARS = 4
#: What alike tokens may share: digits, letters and digits, or the local part of an address.
LIKENESS = 3
#: An agreement potential is held to this range: alike tokens always pull, and never beyond doubt.
PULL = (1.0, 4.0)
#: Pseudo-counts of alike tokens that disagree and that agree.
ALIKE = (1.0, 50.0)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A search that looks at every character once: each @ is grown to the left, then its domain is matched."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        floor = at + 1
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost and non-overlapping per kind, failing matches dropped."""
    out = [(0, s, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


@dataclass
class Graph:
    """The evidence tokens of many documents and the edges among them."""

    doc: list[int] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    shape: list[int] = field(default_factory=list)
    seen: list[int] = field(default_factory=list)  # the label that a pattern gave, or OTHER
    evident: list[bool] = field(default_factory=list)  # in the field for what it holds, not for its likeness alone
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)
    likeness: list[int] = field(default_factory=list)  # of each skip edge, one of LIKENESS

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        spans = sorted((s, e, k) for k, s, e in base)
        longest, at = max((e - s for s, e, _ in spans), default=0), 0
        tokens, known = [], set()
        for m in TOKEN.finditer(text):
            while at < len(spans) and spans[at][0] + longest <= m.start():
                at += 1
            label, k = OTHER, at
            while k < len(spans) and spans[k][0] < m.end():
                if spans[k][1] > m.start():
                    label = min(label, spans[k][2])
                k += 1
            evident = label != OTHER or any("0" <= c <= "9" or c == "@" for c in m[0])
            if label != OTHER:
                known |= keys(m[0])
            tokens.append((m, label, evident))
        last, before, seen = -2, {}, {}
        for position, (m, label, evident) in enumerate(tokens):
            if not evident and not known:
                continue
            own = keys(m[0])
            if not evident and not own & known:
                continue
            node = len(self.doc)
            self.doc.append(doc)
            self.start.append(m.start())
            self.end.append(m.end())
            self.shape.append(shape(m[0]))
            self.seen.append(label)
            self.evident.append(evident)
            if evident and last == position - 1:
                self.chain.append((node - 1, node))
            last = position if evident else last
            for key in sorted(own):
                # Each mention is tied to the one before and to the last that a pattern saw: two edges a mention at most.
                for other in {x[key] for x in (before, seen) if key in x}:
                    self.skip.append((other, node))
                    self.likeness.append(0 if key[0] == "d" else 2 if ("@" in m[0]) != ("@" in text[self.start[other] : self.end[other]]) else 1)
                before[key] = node
                if label != OTHER:
                    seen[key] = node


def shape(token: str) -> int:
    """A token's shape as one of 1120 cells: how many digits and dots, and whether it has @, +, letters, - or brackets."""
    digits = sum("0" <= c <= "9" for c in token)
    size = 0 if not digits else 1 if digits < 4 else 2 if digits < 8 else 3 if digits < 12 else 4 if digits < 16 else 5 if digits < 20 else 6
    flags = ("@" in token, "+" in token, any(c.isalpha() for c in token), "-" in token, "(" in token)
    return (size * 5 + min(4, token.count("."))) * 32 + sum(x << i for i, x in enumerate(flags))


def keys(token: str) -> set[str]:
    """What makes tokens alike: their digits, their letters and digits, and the local part of an address."""
    out = {"d" + "".join(c for c in token if "0" <= c <= "9"), "w" + "".join(c for c in token.lower() if c.isalnum())}
    if "@" in token:
        out.add("w" + "".join(c for c in token.partition("@")[0].lower() if c.isalnum()))
    return {x for x in out if len(x) > KEY_CHARS}


@dataclass
class Potentials:
    unary: dict[int, np.ndarray]
    prior: np.ndarray
    chain: np.ndarray
    skip: np.ndarray  # the pull of each likeness


def potentials(counts: list[tuple[str, int, int, int]]) -> Potentials:
    """Log-ratios with add-one smoothing from (what, a, b, n)."""
    shapes: dict[int, np.ndarray] = {}
    pairs, agree = np.ones((LABELS, LABELS)), np.tile(ALIKE, (LIKENESS, 1))
    for what, a, b, n in counts:
        if what == "u":
            shapes.setdefault(a, np.ones(LABELS))[b] += n
        elif what == "t":
            pairs[a, b] += n
        else:
            agree[a, b] += n

    def lift(x: np.ndarray) -> np.ndarray:
        x = x + x.T
        p = x / x.sum()
        return np.clip(np.log(p / np.outer(p.sum(1), p.sum(0))), -3, 3)

    total = sum(shapes.values(), np.ones(LABELS))
    # Agreement only: alike tokens pull each other's labels together and say nothing else.
    pull = np.clip(np.log(agree[:, 1] / agree[:, 0]), *PULL)
    return Potentials({k: np.log(v / v.sum()) for k, v in shapes.items()}, np.log(total / total.sum()), lift(pairs), pull)


def infer(graph: Graph, model: Potentials) -> np.ndarray:
    """Label probabilities of every node by damped sum-product message passing over all documents' edges at once."""
    n = len(graph.doc)
    flat = np.zeros(LABELS)
    belief = np.array([model.unary.get(x, model.prior) if sure else flat for x, sure in zip(graph.shape, graph.evident, strict=True)]).reshape(n, LABELS)
    seen = np.array(graph.seen, np.int64)
    belief[np.arange(n), seen] += np.where(seen != OTHER, 12.0, 0.0)  # a pattern's finding is as good as certain
    edges = np.array(graph.chain + graph.skip, np.int64).reshape(-1, 2)
    if len(edges):
        psi = np.concatenate([np.broadcast_to(model.chain, (len(graph.chain), LABELS, LABELS)), model.skip[np.array(graph.likeness, np.int64)][:, None, None] * np.eye(LABELS)])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        messages = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS):
            total = belief + np.stack([np.bincount(target, weights=messages[:, k], minlength=n) for k in range(LABELS)], 1)
            out = (total[source] - messages[back])[:, :, None] + psi
            top = out.max(1, keepdims=True)
            out = np.log(np.exp(out - top).sum(1)) + top[:, 0]
            out -= out.max(1, keepdims=True)
            messages = DAMPING * messages + (1 - DAMPING) * out
        belief = belief + np.stack([np.bincount(target, weights=messages[:, k], minlength=n) for k in range(LABELS)], 1)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(texts: dict[int, str], base: dict[int, list[tuple[int, int, int]]], graph: Graph, p: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """(kind, start, end) of tokens that no pattern saw, but that are surely mentions of an entity that one did see."""
    tied = np.arange(len(graph.doc))  # which nodes hang together by skip edges, with whom
    for i, j in graph.skip:
        a, b = _root(tied, i), _root(tied, j)
        tied[max(a, b)] = min(a, b)
    known = {(_root(tied, i), x) for i, x in enumerate(graph.seen) if x != OTHER}
    out: dict[int, list[tuple[int, int, int]]] = {}
    for i, doc in enumerate(graph.doc):
        label = int(p[i, :OTHER].argmax())
        if graph.seen[i] == OTHER and p[i, OTHER] <= 1 - SURE and (_root(tied, i), label) in known:
            token = texts[doc][graph.start[i] : graph.end[i]]
            left = len(token) - len(token.lstrip("\"'<([{|*#%&$.,;:!?-"))
            right = len(token.rstrip("\"'>)]}|*#%&$.,;:!?-"))
            if left < right:
                out.setdefault(doc, []).append((label, graph.start[i] + left, graph.start[i] + right))
    return out


def _root(tied: np.ndarray, i: int) -> int:
    while tied[i] != i:
        tied[i] = tied[tied[i]]
        i = tied[i]
    return int(i)


def _graphs(text: pa.Array) -> tuple[dict[int, str], dict[int, list[tuple[int, int, int]]], Graph]:
    graph, texts, base = Graph(), {}, {}
    for i in pc.indices_nonzero(pc.match_substring_regex(text, EVIDENCE)).to_pylist():
        texts[i] = text[i].as_py()
        base[i] = base_spans(texts[i])
        graph.add(i, texts[i], base[i])
    return texts, base, graph


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        _, _, graph = _graphs(as_strings(batch.column(0)))
        counts.update(("u", a, b) for a, b, sure in zip(graph.shape, graph.seen, graph.evident, strict=True) if sure)
        counts.update(("t", graph.seen[i], graph.seen[j]) for i, j in graph.chain)
        counts.update(("s", k, int(graph.seen[i] == graph.seen[j])) for k, (i, j) in zip(graph.likeness, graph.skip, strict=True) if min(graph.seen[i], graph.seen[j]) != OTHER and graph.evident[i] and graph.evident[j])
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), *[pa.array([k[i] for k in counts], pa.int32()) for i in (1, 2)], pa.array(list(counts.values()), pa.int64())], ["what", "a", "b", "n"])


def fit(docs: DataFrame, text_col: str = "text") -> Potentials:
    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(_count, "what string, a int, b int, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    return potentials(sorted((r["what"], r["a"], r["b"], r["n"]) for r in counts.collect()))  # at most 1120 * 5 + 31 rows


def spell(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Potentials | None = None) -> DataFrame:
    """Finds personal data in every whole text, with potentials from docs itself unless a model is given.

    Returns doc_id, n_email, n_ip, n_card, n_phone (pattern spans), base_sha256 (of those), spans (pattern spans, then the
    field's, whose kinds end in +; by kind, then start) and n_added. A null text is empty and has none; an empty table
    gives an empty result; repeated rows are alike; the field never looks beyond a document; other columns are ignored.
    """
    model = model or fit(docs, text_col)
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = as_strings(batch.column(1))
            n = len(text)
            texts, base, graph = _graphs(text)
            added = added_spans(texts, base, graph, infer(graph, model)) if graph.skip else {}
            counts, digest, spans, more = np.zeros((n, len(KINDS)), np.int64), [empty] * n, [""] * n, np.zeros(n, np.int64)
            for i, found in base.items():
                for k, _, _ in found:
                    counts[i, k] += 1
                plain = [(KINDS[k], s, e) for k, s, e in found]
                extra = [(KINDS[k] + "+", s, e) for k, s, e in sorted(added.get(i, []))]
                digest[i], spans[i], more[i] = hashlib.sha256(spell(plain).encode()).hexdigest(), spell(plain + extra), len(extra)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[:, k]) for k in range(len(KINDS))], pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(more)], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
