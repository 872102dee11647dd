"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four patterns, each read in time proportional to the text. The field then labels tokens (runs without white space that hold a digit
or an @; any other is no entity by definition) as none, email, ip, card or phone. Its potentials: a token's form and the word before it; the labels of
tokens that follow each other; and skip edges between distant tokens of one document that are equal or similar: the same letters and digits, the same last
seven digits, or one being the name before the other's @. Equal tokens are joined to their next like, so edges grow with the tokens and not with pairs.
Tokens of base spans are observed. Loopy sum-product messages carry their labels along the edges, a fixed number of rounds for all documents of a slice
at once, and a token whose marginal for an entity reaches `sure` becomes a span of the method, next to the base ones.

Weights are fitted by pseudo-likelihood on the driver, on tokens of at most SAMPLE_DOCS texts of at most SAMPLE_CHARS characters, the first by a hash of their
id, with the base patterns as labels. Each token is also seen without the marks that its pattern asks for, so that its neighbours have to tell. The skip
weights have a prior above 0, as labels repeat. Everything else covers whole texts of all rows.

Edge cases: null and empty texts have no span; a null id is kept; equal rows give a row each; an empty table gives an empty result, and a sample without tokens
the prior's weights; other columns are ignored. Digits of any number are read (parts of an ip may have leading zeros).
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

KINDS = ["email", "ip", "card", "phone"]
#: Sample of the fit, its rounds, and rounds of messages.
SAMPLE_DOCS, SAMPLE_CHARS, FIT_ROUNDS, ROUNDS = 1000, 16_384, 150, 10
#: Score of an observed label over the others, prior of the skip weights, and the least marginal of a span.
OBSERVED, SKIP_PRIOR, SURE = 12.0, 2.5, 0.9

LOCAL, DOMAIN = r"[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
EMAIL_HERE = re.compile(rf"{LOCAL}@{DOMAIN}")
EMAIL_NEXT = re.compile(rf"(?<![A-Za-z0-9._%+-]){LOCAL}@{DOMAIN}")
NUMBERS = re.compile(r"[0-9]++((?:\.[0-9]++){3})?+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
TAIL = re.compile(r"[^\x20\x09-\x0D]*")
WHITE = frozenset("\x20\x09\x0a\x0b\x0c\x0d")
#: Words before a token that speak for a kind.
CUES = [re.compile(p) for p in ("mail", "^ip|host|server|addr", "card|visa|account", "tel|phone|call|fax|mobil")]


def emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    while text.find("@", end) >= 0:
        # A match may begin right where the last one ended; any other begins where a run of such characters does.
        m = EMAIL_HERE.match(text, end) or EMAIL_NEXT.search(text, end)
        if not m:
            break
        out.append(m.span())
        end = m.end()
    return out


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda part: len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255
    return [m.span() for m in NUMBERS.finditer(text) if m[1] and all(map(small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The base spans of each kind, by start."""
    if not MARK.search(text):
        return [[], [], [], []]
    return [emails(text), ips(text), cards(text), phones(text)]


def digest_form(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans) for a, b in sorted(found))


def tokens_of(text: str) -> list[tuple[int, int]]:
    """The runs without white space that hold a digit or an @."""
    out, end = [], 0
    while m := MARK.search(text, end):
        start = m.start()
        while start > end and text[start - 1] not in WHITE:
            start -= 1
        end = TAIL.match(text, m.start()).end()
        out.append((start, end))
    return out


#: Forms of a token; those of MARKS are what the base patterns ask for and are left out of a fit's second look.
FORMS = 30
MARKS = [0, 1, 2, 3, 14]


def form(token: str, before: str) -> list[int]:
    """The forms that a token has, as numbers below FORMS."""
    n, dots = len(digits_of(token)), token.count(".")
    letters = any(c.isalpha() for c in token)
    flags = [
        "@" in token, token[0] == "+", dots == 3 and not letters and n > 3, 13 <= n <= 19, letters, letters and n > 0, "-" in token, "(" in token or ")" in token,
        "/" in token or ":" in token, "_" in token, dots == 1, dots > 1, "%" in token or "$" in token or "€" in token, "," in token[:-1], n >= 9 and not letters, len(token) > 20,
    ]
    out = [k for k, f in enumerate(flags) if f]
    out.append(16 + sum(n > edge for edge in (0, 1, 2, 3, 4, 6, 8, 12, 19)))
    return out + [26 + k for k, cue in enumerate(CUES) if cue.search(before)]


class Field:
    """The tokens of some texts as one graph: forms, labels of the base spans, chain edges and skip edges of two strengths."""

    def __init__(self, texts: list[str], spans: list[list[list[tuple[int, int]]]]) -> None:
        self.places: list[tuple[int, int, int]] = []
        rows, columns, labels, chain, alike, similar = [], [], [], [], [], []
        for k, (text, found) in enumerate(zip(texts, spans)):
            seen: dict[tuple, int] = {}
            tokens = tokens_of(text) if text else []
            flat = sorted((a, b, 1 + kind) for kind, own in enumerate(found) for a, b in own)
            at, last = 0, -10
            for start, end in tokens:
                i = len(self.places)
                token = text[start:end]
                while at < len(flat) and flat[at][1] <= start:
                    at += 1
                hits = [kind for a, b, kind in flat[at : at + 4] if a < end and b > start]
                labels.append(min(hits) if hits else 0)
                self.places.append((k, start, end))
                held = form(token, text[max(0, start - 12) : start].rstrip().rpartition(" ")[2].lower())
                rows += [i] * len(held)
                columns += held
                if start - last <= 3 and not text[last:start].strip("\x20\x09\x0a\x0b\x0c\x0d"):
                    chain.append((i - 1, i))
                last = end
                bare = re.sub(r"[^\w@]+", "", token).lower()
                digits = digits_of(token)
                keys = [(0, bare)] if len(bare) > 3 else []
                if len(digits) >= 7 and "@" not in token:
                    keys.append((1, digits[-7:]))
                if len(name := re.sub(r"[^\w]+", "", token.partition("@")[0]).lower()) > 3:
                    keys.append((2, name))
                for key in keys:
                    if (j := seen.get(key)) is not None:
                        (alike if key[0] == 0 else similar).append((j, i))
                    seen[key] = i
        n = len(self.places)
        self.forms = np.zeros((n, FORMS), np.float32)
        self.forms[rows, columns] = 1
        self.labels = np.array(labels, np.int64)
        pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
        self.edges = [pairs(chain), pairs(sorted(set(alike))), pairs(sorted(set(similar) - set(alike)))]


class Weights(NamedTuple):
    """form: of each form and label; chain: of a label and the next; open: of a label beside a token that is none; skip: of equal labels, by kind of edge."""

    form: np.ndarray
    chain: np.ndarray
    open: np.ndarray
    skip: np.ndarray


N = len(KINDS) + 1


def prior() -> Weights:
    return Weights(np.zeros((FORMS, N)), np.zeros((N, N)), np.zeros((2, N)), np.full((2, N), SKIP_PRIOR))


def bounds(field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Whether a token has no chain edge before it, and none after it."""
    n, chain = len(field.labels), field.edges[0]
    before, after = np.ones(n), np.ones(n)
    before[chain[:, 1]] = after[chain[:, 0]] = 0
    return before, after


def fitted(field: Field) -> Weights:
    """Weights of the greatest pseudo-likelihood: each token's label given its forms and the labels of its neighbours."""
    w = prior()
    n = len(field.labels)
    if not n:
        return w
    plain = field.forms.copy()
    plain[:, MARKS] = 0
    forms, gold = np.concatenate([field.forms, plain]), np.concatenate([field.labels] * 2)
    one = np.eye(N)[field.labels]
    before, after = (np.concatenate([x] * 2) for x in bounds(field))
    prev, following = np.zeros((n, N)), np.zeros((n, N))
    prev[field.edges[0][:, 1]] = one[field.edges[0][:, 0]]
    following[field.edges[0][:, 0]] = one[field.edges[0][:, 1]]
    prev, following = np.concatenate([prev] * 2), np.concatenate([following] * 2)
    near = np.zeros((2, n, N))
    for k, edges in enumerate(field.edges[1:]):
        np.add.at(near[k], edges[:, 0], one[edges[:, 1]])
        np.add.at(near[k], edges[:, 1], one[edges[:, 0]])
    near = np.concatenate([near] * 2, axis=1)
    want, grown = np.eye(N)[gold], [np.full_like(x, 1e-6) for x in w]
    for _ in range(FIT_ROUNDS):
        score = forms @ w.form + prev @ w.chain + following @ w.chain.T + before[:, None] * w.open[0] + after[:, None] * w.open[1] + (near * w.skip[:, None, :]).sum(axis=0)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        off = (want - p / p.sum(axis=1, keepdims=True)) / len(gold)
        steps = [forms.T @ off, prev.T @ off + off.T @ following, np.stack([before @ off, after @ off]), (near * off[None]).sum(axis=1)]
        for x, centre, step, g in zip(w, prior(), steps, grown):
            step -= 1e-4 * (x - centre)
            g += step * step
            x += 0.3 * step / np.sqrt(g)
    return w


def marginals(field: Field, w: Weights) -> np.ndarray:
    """Each token's label probabilities after ROUNDS rounds of messages along all edges, both ways."""
    before, after = bounds(field)
    node = field.forms @ w.form + before[:, None] * w.open[0] + after[:, None] * w.open[1]
    seen = field.labels > 0
    node[seen, field.labels[seen]] += OBSERVED
    tables = [w.chain, w.chain.T, np.diag(w.skip[0]), np.diag(w.skip[1])]
    chain, alike, similar = field.edges
    source = np.concatenate([chain[:, 0], chain[:, 1], alike[:, 0], alike[:, 1], similar[:, 0], similar[:, 1]])
    target = np.concatenate([chain[:, 1], chain[:, 0], alike[:, 1], alike[:, 0], similar[:, 1], similar[:, 0]])
    sizes = [len(chain), len(chain), 2 * len(alike), 2 * len(similar)]
    ends = np.cumsum([0, *sizes])
    back = np.concatenate([np.r_[s + m : s + 2 * m, s : s + m] for s, m in ((0, len(chain)), (ends[2], len(alike)), (ends[3], len(similar)))]).astype(np.int64)
    message = np.zeros((len(source), N))
    belief = node.copy()
    for _ in range(ROUNDS if len(source) else 0):
        out = belief[source] - message[back]
        new = np.empty_like(message)
        for t, (a, b) in enumerate(zip(ends, ends[1:])):
            part = out[a:b]
            for y in range(N):
                new[a:b, y] = np.logaddexp.reduce(part + tables[t][:, y], axis=1)
        message = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
        belief = node.copy()
        for y in range(N):
            belief[:, y] += np.bincount(target, message[:, y], len(node))
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def core(text: str, start: int, end: int) -> tuple[int, int]:
    """A token's place without the punctuation around it."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
        end -= 1
    return start, end


def added_spans(texts: list[str], spans: list, w: Weights, sure: float = SURE) -> list[list[list[tuple[int, int]]]]:
    """The method's own spans of each kind: tokens outside the base spans whose entity is sure; neighbours of one kind make one span, but for emails and ips."""
    out: list = [[[], [], [], []] for _ in texts]
    field = Field(texts, spans)
    if not len(field.labels):
        return out
    p = marginals(field, w)
    best = p[:, 1:].argmax(axis=1) + 1
    good = (field.labels == 0) & (p[np.arange(len(p)), best] >= sure)
    joined, last = set(field.edges[0][:, 1].tolist()), -1
    for i in np.flatnonzero(good).tolist():
        k, start, end = field.places[i]
        start, end = core(texts[k], start, end)
        kind = int(best[i])
        found = out[k][kind - 1]
        if end > start:
            if kind > 2 and i in joined and last == i - 1 and best[last] == kind and found:
                found[-1] = (found[-1][0], end)
            else:
                found.append((start, end))
            last = i
    return out


def fit(docs: DataFrame) -> Weights:
    """Weights from the bounded sample of (doc_id, text)."""
    short = docs.where((F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]"))
    marked = short.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("by_id"), F.xxhash64("text").alias("by_text"), "text")
    # First the hashes alone: each task sends the driver so many numbers, and only the chosen texts follow, each once.
    chosen = marked.select("by_id", "by_text").orderBy("by_id", "by_text").limit(SAMPLE_DOCS).distinct().collect()
    if not chosen:
        return fitted(Field([], []))
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "by_id long, by_text long"))
    rows = marked.join(wanted, ["by_id", "by_text"]).groupBy("by_id", "by_text").agg(F.min("text").alias("text")).orderBy("by_id", "by_text").collect()
    texts = [r["text"] for r in rows]
    return fitted(Field(texts, [base_spans(t) for t in texts]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """doc_id, base and added: the spans of each kind (kind, start, end) in code points, of the patterns and of the field."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    w = fit(docs)
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    flat = lambda spans: [{"kind": k, "start": a, "end": b} for k, own in enumerate(spans) for a, b in own]

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, w, sure)
            return {"doc_id": batch.column("doc_id"), "base": pa.array([flat(s) for s in base], span), "added": pa.array([flat(s) for s in added], span)}

        return step

    struct = "array<struct<kind:int,start:long,end:long>>"
    return map_texts(docs, ["doc_id", "text"], "text", f"doc_id long, base {struct}, added {struct}", make)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    written = lambda spans: F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    every = F.concat("base", "added")
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


QUERIES = {"op11_pii": op11_pii}
ORACLE_SQL: dict[str, str] = {}
