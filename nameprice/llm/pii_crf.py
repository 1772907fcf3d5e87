"""Personal data by base patterns and a semi-Markov conditional random field.

Base spans (email, ip, card, phone) come from fixed patterns and are always
reported. Around digits and address signs lie *islands* of text, and there a
semi-Markov CRF looks for spans that the patterns miss (an address written with
"(at)" or " @ ", a number without its country code, a card number dotted in fours). It
scores whole candidate segments, up to `MAX_TOKENS` tokens (`MAX_ADDRESS` with an address
sign; at least seven digits, four octets or an address sign), by features of the
entire span (digit groups, Luhn sum, octets, separators, edges) and one dynamic
programme per island chooses boundaries and types jointly: a token is outside, or
it belongs to exactly one segment of one type. Segments that win by
`MIN_SCORE` and touch no base span are added.

The model is trained by maximum likelihood (forward-backward over segments) on a
bounded sample: `SAMPLE_DOCS` documents that hold digits or an address sign, those
with the smallest hashes of doc_id, up to `SAMPLE_CHARS` characters each. Gold
segments are base spans and rewritten copies of them; dates, version numbers
and handles stand in as decoys. Predictions read whole
texts; work is linear in a text's length (an island longer than `MAX_ISLAND` goes on
as another one).

Defined cases: null text counts as empty: no spans. Repeated rows and null
doc_ids give a row each. Without base spans in the sample the model adds nothing.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameprice.llm.common import worker_udf

# FIXED VALUES: kinds in report order and their patterns (see the query's contract)
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMERIC = re.compile(r"[0-9][0-9 .-]*")

SAMPLE_DOCS = 300
SAMPLE_CHARS = 8192
OVERSAMPLE = 16
MAX_TOKENS = 16
MAX_ADDRESS = 48
MIN_SCORE = 1.0
ISLAND = re.compile(
    r"(?:[A-Za-z0-9._%+()\[\]-]*[0-9@][A-Za-z0-9._%+@()\[\]-]*"
    r"|[A-Za-z0-9._%+-]+ ?(?:[(\[]at[)\] ]|@)[A-Za-z0-9.()\[\]-]*)"
    r"(?: (?:[A-Za-z0-9._%+()\[\]-]*[0-9@][A-Za-z0-9._%+@()\[\]-]*|[(\[](?:at|dot)[)\]]"
    r"|(?<=[\])@] )[A-Za-z0-9.-]+))*")
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
MAX_LEAD, MAX_ISLAND = 80, 4096
DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
DECOYS = ("2024-01-02 12:33:44", "1.2.3.4.5", "12:33:44 2024-11-30", "1234567",
          "hello @user", "lunch @ noon")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[(\[](?:at|dot)[)\]]|.", re.S)
JOINER = re.compile(r" ?(?:@|[(\[]at[)\]]) ?")
DOT = re.compile(r" ?(?:\.|[(\[]dot[)\]]) ?")
DIGITS = re.compile(r"[0-9]+")
OCTETS = re.compile(r"[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}")
OUTPUT = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches; each address sign is looked at once, so runs cost linear time."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, done))
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the fixed patterns by kind."""
    ips, cards = [], []
    for m in NUMERIC.finditer(text):
        a, b = m.span()
        if b - a < 7:
            continue
        for x in IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                   for p in x.group().split(".")):
                ips.append(x.span())
        for x in CARD.finditer(text, a, b):
            digits = x.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(x.span())
    phones = [x.span() for x in PHONE.finditer(text)
              if 8 <= sum(c.isdigit() for c in x.group()) <= 15]
    return {"email": emails(text), "ip": ips, "card": cards, "phone": phones}


# ---- candidate segments and their features -------------------------------------------

FEATURES = (
    "bias", "digits<7", "digits7-9", "digits10-11", "digits12-15", "digits16", "digits17-19",
    "digits>19", "luhn", "one group", "two groups", "three groups", "four groups", "five groups",
    "more groups", "octets", "fours", "tail 3-4", "plus", "parenthesis", "unbalanced",
    "one joiner", "more joiners", "letters", "domain", "dots only", "dashes only", "blanks only",
    "dots four groups", "date", "cut left", "joined left", "cut right", "letters no joiner", "long")
PLACE = {name: i for i, name in enumerate(FEATURES)}


def features(text: str, start: int, end: int) -> np.ndarray:
    span = text[start:end]
    groups = DIGITS.findall(span)
    digits = "".join(groups)
    n = len(digits)
    joiners = JOINER.findall(span)
    letters = any(c.isalpha() for c in span)
    hit = ["bias"]
    if not letters:          # digit counts say nothing about a span with a name in it
        hit.append("digits<7" if n < 7 else "digits7-9" if n < 10 else "digits10-11" if n < 12
                   else "digits12-15" if n < 16 else "digits16" if n == 16
                   else "digits17-19" if n < 20 else "digits>19")
        names = ("one group", "two groups", "three groups", "four groups", "five groups")
        hit.append(names[len(groups) - 1] if 0 < len(groups) <= 5 else "more groups")
    if not letters and 13 <= n <= 19 and luhn(digits):
        hit.append("luhn")
    if not letters and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        hit.append("octets")
    if not letters and len(groups) >= 4 and all(len(g) == 4 for g in groups):
        hit.append("fours")
    if not letters and len(groups) >= 3 and len(groups[-1]) == 4 and len(groups[-2]) == 3:
        hit.append("tail 3-4")
    if span[0] == "+":
        hit.append("plus")
    if "(" in span and not letters:
        hit.append("parenthesis")
    if span.count("(") != span.count(")") or span.count("[") != span.count("]"):
        hit.append("unbalanced")
    if joiners:
        hit.append("one joiner" if len(joiners) == 1 else "more joiners")
        labels = DOT.split(JOINER.split(span)[-1])
        if len(labels) > 1 and labels[-1].isalpha() and 2 <= len(labels[-1]) <= 6:
            hit.append("domain")
    elif letters:
        hit.append("letters no joiner")
    if letters:
        hit.append("letters")
    seps = {c for c in span if not c.isalnum()}
    if seps == {"."}:
        hit.append("dots only")
    if seps == {"-"}:
        hit.append("dashes only")
    if seps == {" "}:
        hit.append("blanks only")
    if len(groups) == 4 and not letters and "." in seps and not seps - set(".[]"):
        hit.append("dots four groups")
    if DATE.search(span):
        hit.append("date")
    if start and text[start - 1].isalnum():
        hit.append("cut left")
    elif start and text[start - 1] in "._%+-":
        hit.append("joined left")
    if end < len(text) and text[end].isalnum():
        hit.append("cut right")
    if end - start > 40:
        hit.append("long")
    out = np.zeros(len(FEATURES))
    for name in hit:
        out[PLACE[name]] = 1.0
    return out


class Lattice:
    """Tokens of an island, its candidate segments and their features."""

    def __init__(self, text: str, start: int, end: int):
        spans = [m.span() for m in TOKEN.finditer(text, start, end)]
        self.n = len(spans)
        self.cuts = [a for a, _ in spans] + [end]
        number = np.cumsum([0] + [b - a if text[a].isdigit() else 0 for a, b in spans])
        sign = np.cumsum([0] + [text[a] == "@" or text[a:b] in ("(at)", "[at]") for a, b in spans])
        first = [text[a].isalnum() or text[a] in "+(" for a, _ in spans]
        last = [text[a].isalnum() for a, _ in spans]
        places = [(i, j) for i in range(self.n) if first[i]
                  for j in range(i + 1, min(self.n, i + MAX_ADDRESS) + 1)
                  if last[j - 1] and (sign[j] > sign[i] or j - i <= MAX_TOKENS and (
                      number[j] - number[i] >= 7 or number[j] - number[i] >= 4
                      and OCTETS.fullmatch(text, self.cuts[i], self.cuts[j])))]
        self.at = places
        self.rows = np.array([features(text, self.cuts[i], self.cuts[j]) for i, j in places]
                             ) if places else np.zeros((0, len(FEATURES)))
        self.ending: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (_, j) in enumerate(places):
            self.ending[j].append(k)

    def best(self, weights: np.ndarray) -> list[tuple[int, int, int]]:
        """Best segmentation: (kind, start, end) of its segments."""
        scores = self.rows @ weights.T
        kind, top = scores.argmax(axis=1), scores.max(axis=1) - MIN_SCORE
        value, back = [0.0] * (self.n + 1), [-1] * (self.n + 1)
        for j in range(1, self.n + 1):
            value[j] = value[j - 1]
            for k in self.ending[j]:
                v = value[self.at[k][0]] + top[k]
                if v > value[j]:
                    value[j], back[j] = v, k
        out, j = [], self.n
        while j > 0:
            if back[j] < 0:
                j -= 1
                continue
            i = self.at[back[j]][0]
            out.append((int(kind[back[j]]), self.cuts[i], self.cuts[j]))
            j = i
        return out[::-1]

    def gradient(self, weights: np.ndarray, gold: list[tuple[int, int]]) -> np.ndarray:
        """Gradient of the log-likelihood; gold: (segment number, kind)."""
        scores = self.rows @ weights.T
        top = scores.max(axis=1)
        z = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        ahead = np.zeros(self.n + 1)
        for j in range(1, self.n + 1):
            terms = [ahead[j - 1]] + [ahead[self.at[k][0]] + z[k] for k in self.ending[j]]
            ahead[j] = np.logaddexp.reduce(terms)
        after = np.full(self.n + 1, -np.inf)
        after[self.n] = 0.0
        for j in range(self.n, 0, -1):
            after[j - 1] = np.logaddexp(after[j - 1], after[j])
            for k in self.ending[j]:
                i = self.at[k][0]
                after[i] = np.logaddexp(after[i], after[j] + z[k])
        starts = np.array([i for i, _ in self.at])
        ends = np.array([j for _, j in self.at])
        share = np.exp(ahead[starts] + z + after[ends] - ahead[self.n])
        kinds = np.exp(scores - z[:, None]) * share[:, None]
        out = -(kinds.T @ self.rows)
        for k, t in gold:
            out[t] += self.rows[k]
        return out


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and address signs; other text is only scanned for those."""
    done, sign = 0, TRIGGER.search(text)
    while sign:
        at = start = sign.start()
        floor = max(done, at - MAX_LEAD)
        while start > floor and not text[start - 1].isspace():
            start -= 1
        if text[at] in "([@" and start == at and start - 1 > floor:     # "name (at) host", "name @ host"
            start -= 1
            while start > floor and not text[start - 1].isspace():
                start -= 1
        m = ISLAND.search(text, start, at + MAX_ISLAND)
        if m and m.end() > at:
            yield m.span()
        done = max(at + 1, m.end() if m else 0)
        sign = TRIGGER.search(text, done)


# ---- training ------------------------------------------------------------------------

def rewrites(kind: str, span: str) -> list[str]:
    """Other ways to write the same datum that the patterns do not match."""
    digits = DIGITS.findall(span)
    if kind == "email":
        name, host = span.split("@", 1)
        return [f"{name} @ {host}", f"{name}[at]{host}", f"{name} (at) {host}",
                f"{name} [at] {host.replace('.', ' [dot] ')}"]
    if kind == "ip":
        return ["[.]".join(digits)]
    if kind == "card":
        number = "".join(digits)
        fours = [number[i:i + 4] for i in range(0, len(number), 4)]
        return [".".join(fours)] if len(number) == 16 else []
    if len(digits) == 4:
        _, a, b, c = digits
        return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"]
    return []


def _examples(text: str) -> Iterator[tuple[Lattice, list[tuple[int, int]]]]:
    """Islands of a text with gold segments, and rewritten copies of them."""
    found = [(KINDS.index(kind), a, b) for kind, spans in base_spans(text).items() for a, b in spans]

    def example(t: str, start: int, end: int, gold: list[tuple[int, int, int]]):
        lattice = Lattice(t, start, end)
        where = {(lattice.cuts[i], lattice.cuts[j]): k for k, (i, j) in enumerate(lattice.at)}
        chosen, done = [], -1
        for kind, a, b in sorted(gold, key=lambda g: (g[1], -g[2])):
            if a >= done and (a, b) in where:
                chosen.append((where[a, b], kind))
                done = b
        return lattice, chosen

    for start, end in islands(text):
        inside = [g for g in found if start <= g[1] and g[2] <= end]
        yield example(text, start, end, inside)
        for kind, a, b in inside:
            lead, tail = text[max(0, a - 12):a], text[b:b + 12]
            for decoy in DECOYS:
                yield from (example(lead + decoy, s, e, []) for s, e in islands(lead + decoy)
                            if s >= len(lead))
            for new in rewrites(KINDS[kind], text[a:b]):
                t = lead + new + tail
                cover = [(s, e) for s, e in islands(t) if s <= len(lead) and e >= len(lead) + len(new)]
                for s, e in cover[:1]:
                    yield example(t, s, e, [(kind, len(lead), len(lead) + len(new))])


def train(texts: list[str], steps: int = 60, rate: float = 0.3, decay: float = 0.002,
          most: int = 600) -> np.ndarray:
    """Weights (kind x feature) by maximum likelihood with adaptive steps."""
    weights = np.zeros((len(KINDS), len(FEATURES)))
    data = []
    for text in texts:
        data += [(lattice, gold) for lattice, gold in _examples(text) if len(lattice.at)]
        if len(data) >= most:
            break
    data = [x for x in data[:most] if x[0].n <= 200]
    if not any(gold for _, gold in data):
        weights[:, PLACE["bias"]] = -1e6
        return weights
    mean, spread = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        slope = sum(lattice.gradient(weights, gold) for lattice, gold in data) - decay * weights
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope ** 2
        weights += rate * (mean / (1 - 0.9 ** step)) / (
            np.sqrt(spread / (1 - 0.99 ** step)) + 1e-8)
    return weights


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> np.ndarray:
    """Train on a bounded sample of documents that hold digits or an address sign.

    Rows whose hashed doc_id lies below a threshold, about `OVERSAMPLE` times the
    sample, are looked at, so tasks send the driver a bounded number of rows however
    many there are. Rows without a doc_id are not learned from.
    """
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    share = min(1.0, OVERSAMPLE * sample_docs / max(1, docs.count()))
    seen = docs.where(F.col("doc_id").isNotNull() & (place <= min(2 ** 63 - 1, int(share * 2 ** 63)))) \
        .where(F.col("text").rlike("[0-9]{3}|@")).select(
        F.substring("text", 1, SAMPLE_CHARS).alias("text"), place.alias("place"), "doc_id")
    return train([r["text"] for r in seen.orderBy("place", "doc_id", "text").limit(sample_docs).collect()])


# ---- prediction ----------------------------------------------------------------------

def added_spans(text: str, base: dict[str, list[tuple[int, int]]],
                weights: np.ndarray) -> list[Span]:
    """Segments the model finds beside the base spans."""
    taken = sorted(s for spans in base.values() for s in spans)
    out, at = [], 0
    for start, end in islands(text):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        covered = sum(min(b, end) - max(a, start) for a, b in taken[at:at + 8] if a < end)
        if end - start - covered < 7:
            continue
        near = [s for s in taken[at:] if s[0] < end]
        for kind, a, b in Lattice(text, start, end).best(weights):
            if not any(x < b and a < y for x, y in near):
                out.append((KINDS[kind], a, b))
    return out


def report(text: str, weights: np.ndarray) -> tuple:
    """(base counts by kind, digest of base spans, all spans)."""
    base = base_spans(text)
    spans = [(k, a, b) for k in KINDS for a, b in base[k]]
    more = spans + added_spans(text, base, weights)
    more.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    listed = [",".join(f"{k}:{a}:{b}" for k, a, b in s) for s in (spans, more)]
    return (*(len(base[k]) for k in KINDS), hashlib.sha256(listed[0].encode()).hexdigest(), listed[1])


def found(text: Column, weights: np.ndarray) -> Column:
    """struct(n_email, n_ip, n_card, n_phone, base_sha256, spans) of a text column."""
    @worker_udf(OUTPUT)
    def find(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([report(t or "", weights) for t in texts], columns=[
            "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
    return find(text)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    return docs.select("doc_id", found(F.col("text"), learn(docs)).alias("p")).select("doc_id", "p.*")
