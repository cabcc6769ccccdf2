"""Personal data: exact base patterns, and further spans from a skip-chain conditional random field.

Base spans are the e-mail addresses, IPv4 addresses, payment cards (Luhn) and
international phone numbers that fixed patterns find, leftmost and without
overlap for each kind.  They always stay.

The field adds what patterns miss: numbers with a digit too many or few next to a
cue, repeated mentions without their cue, secrets.  Its variables are the tokens
with a digit, an at sign or a capital within a word (``hunterSecretKey``);
spelled-out and spaced-out addresses and secrets in small letters only are not
found.  Neighbours share a potential.  Distant tokens that are equal, or differ in
case and digits only, share the skip potential through one hub for each such
group: any two mentions are two edges apart, at a cost linear in their number.
Skip potentials see what stands at their ends: a cue before any mention of a group
speaks for its kind on every edge of it, so it decides for all, however many.  Loopy belief propagation runs over
each document as a whole until its messages settle.

Weights are fitted here by pseudo-likelihood on sentences that a seeded
generator writes around invented names and numbers; nothing is downloaded.

Edge cases: null and empty texts have no spans; texts of any length are worked
on whole, in time linear in their length; repeated rows give equal results; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in their order and the base patterns.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS, "secret")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number starts where no digit stands before it: a start inside it would fail or match in the same way.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of local part, at sign, domain: each at sign is met once, so long runs of letters cost nothing extra."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL_SET:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append((begin, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind in the order of KINDS."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- the field ----

#: A token: what stands between spaces, without marks around it.
_TOKEN = re.compile(r"[^\s\"'<>\[\]{},;:=()]+")
#: What makes a token a variable of the field.
_MAYBE = re.compile(r"[0-9@]|(?<=[a-z])[A-Z]")
_SOLID = re.compile(r"[^\W_]")
# Cue words before personal data, by kind.
CUES = {
    "email": "email e-mail mail contact address write courriel correo".split(),
    "ip": "ip host server address client addr".split(),
    "card": "card visa mastercard amex credit debit payment carte tarjeta karte".split(),
    "phone": "phone tel telephone call mobile cell fax telefon telefono".split(),
    "secret": "password passwd pwd token secret key apikey api_key passwort clave".split(),
}
_CUE_OF = {w: kind for kind, words in CUES.items() for w in words}
N_LABELS = len(LABELS)
#: Messages have settled when none changes by more; loops that never settle end after so many rounds.
SETTLED, BP_ROUNDS = 1e-4, 300


def shape(token: str) -> str:
    """Digits as 0, letters as a or A, runs shortened; other characters as they are."""
    out = []
    for c in token[:80]:
        k = "0" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.islower() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def skip_key(token: str) -> str:
    """Tokens with the same key share a hub: equal ones, whatever the case of letters and the digits."""
    return re.sub(r"[0-9]", "0", token.lower()) if len(token) > 3 else ""


def token_features(token: str, before: tuple[str, str]) -> list[str]:
    digits = sum("0" <= c <= "9" for c in token)
    out = [
        "shape=" + shape(token), f"digits={min(digits, 20)}", f"length={min(len(token) // 4, 12)}", f"dots={min(token.count('.'), 4)}",
        f"at={'@' in token}", f"plus={token[:1] == '+'}", f"mixed={digits > 2 and any(c.isalpha() for c in token) and len(token) > 11}",
        f"camel={not digits and len(token) > 7}", "bias",
    ]
    if digits == len(token) and 12 <= digits <= 19:
        out.append(f"luhn={luhn(token)}")
    if token.count(".") == 3 and digits == len(token) - 3:
        out.append(f"quad={all(p and len(p) <= 3 and int(p) <= 255 for p in token.split('.'))}")
    for k, word in enumerate(before):
        cue = _CUE_OF.get(word.lower())
        if cue:
            out.append(f"cue{k}={cue}")
    return out


class Document:
    """The variables of one text: tokens that may be personal data, then a hub for each group of mentions; chain and skip edges."""

    def __init__(self, text: str) -> None:
        self.spans: list[tuple[int, int]] = []
        self.features: list[list[str]] = []
        self.chain: list[tuple[int, int]] = []
        last_end, done = -10, 0
        where: dict[str, list[int]] = defaultdict(list)
        cued: dict[str, set[int]] = defaultdict(set)
        for hit in _MAYBE.finditer(text):
            if hit.start() < done:
                continue
            a = hit.start()
            while a > done and not (text[a - 1].isspace() or text[a - 1] in "\"'<>[]{},;:=()"):
                a -= 1
            end = _TOKEN.match(text, a).end()
            done = a + len(text[a:end].rstrip(".!?"))
            token = text[a:done]
            if not _SOLID.search(token):
                continue
            before = re.findall(r"[^\s:=\"']+", text[max(0, a - 40) : a])[-2:]
            before = ("", "", *before)[-2:]
            i = len(self.spans)
            self.spans.append((a, done))
            self.features.append(token_features(token, (before[1], before[0])))
            if i and a - last_end <= 2:
                self.chain.append((i - 1, i))
            last_end = done
            key = skip_key(token)
            if key:
                where[key].append(i)
                for word in before:
                    if word.lower() in _CUE_OF:
                        cued[key].add(LABELS.index(_CUE_OF[word.lower()]))
        #: Mentions by group; those of one alone have no hub.
        self.groups = [g for g in where.values() if len(g) > 1]
        n = len(self.spans)
        self.skips = [(i, n + k) for k, group in enumerate(self.groups) for i in group]
        #: For each group, the labels for which there is a cue before a mention.
        self.cues = [np.isin(np.arange(N_LABELS), list(cued[key])) for key, g in where.items() if len(g) > 1]


class Field:
    """Weights of a skip-chain field over LABELS."""

    def __init__(self) -> None:
        self.unary: dict[str, np.ndarray] = {}
        self.chain = np.zeros((N_LABELS, N_LABELS))
        self.skip = np.zeros((N_LABELS, N_LABELS))
        #: What a cue of a label in the group adds to a skip edge between two ends of that label.
        self.told = np.zeros(N_LABELS)

    def scores(self, document: Document) -> np.ndarray:
        none = np.zeros(N_LABELS)
        own = np.array([sum((self.unary.get(f, none) for f in fs), none) for fs in document.features]).reshape(-1, N_LABELS)
        return np.concatenate([own, np.zeros((len(document.groups), N_LABELS))])


    def pairs(self, document: Document) -> tuple[np.ndarray, np.ndarray]:
        """Edges, and the potentials of each."""
        edges = np.array(document.chain + document.skips, np.int64).reshape(-1, 2)
        chain = np.repeat(self.chain[None], len(document.chain), 0)
        skip = [self.skip + np.diag(self.told * cues) for cues, group in zip(document.cues, document.groups, strict=False) for _ in group]
        return edges, np.concatenate([chain, np.array(skip).reshape(-1, N_LABELS, N_LABELS)])


def propagate(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, rounds: int = BP_ROUNDS) -> np.ndarray:
    """Beliefs (log, up to a constant) after loopy sum-product over edges with potentials ``pair`` (edges x labels x labels)."""
    n, m = len(unary), len(edges)
    if not m:
        return unary
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    potentials = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    messages = np.zeros((2 * m, N_LABELS))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        inner = (belief[source] - messages[back])[:, :, None] + potentials
        top = inner.max(axis=1, keepdims=True)
        new = np.log(np.exp(inner - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        moved = np.abs(new - messages).max()
        messages = 0.5 * messages + 0.5 * new
        if moved < SETTLED:
            break
    belief = unary.copy()
    np.add.at(belief, target, messages)
    return belief


def decode(field: Field, document: Document) -> list[tuple[str, int, int]]:
    if not document.spans:
        return []
    edges, pair = field.pairs(document)
    best = propagate(field.scores(document), edges, pair)[: len(document.spans)].argmax(axis=1)
    return [(LABELS[k], a, b) for k, (a, b) in zip(best, document.spans, strict=True) if k]


def training_texts(n: int = 1000, seed: int = 11) -> list[tuple[str, dict[str, str]]]:
    """Sentences with personal data and look-alikes; each with the label of its special tokens."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ba", "ke", "lo", "mi", "ru", "st", "en", "ti")) for _ in range(r.randrange(1, 4)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    code = lambda k, letters: "".join(r.choice(letters) for _ in range(k))

    def card() -> str:
        head = r.choice("345") + digits(14)
        return head + next(c for c in "0123456789" if luhn(head + c))

    def special(kind: str) -> str:
        if kind == "email":
            return r.choice([f"{word()}.{digits(2)}@{word()}.{r.choice(['com', 'org', 'net'])}", f"{word()}@{word()}", f"{word()}@{word()}.example.com"])
        if kind == "ip":
            return ".".join(str(r.randrange(256)) for _ in range(4))
        if kind == "card":
            return card()
        if kind == "phone":
            return r.choice([f"{digits(3)}-{digits(3)}-{digits(4)}", digits(7), f"{digits(3)}.{digits(3)}.{digits(4)}", f"+{digits(11)}", "0" + digits(9)])
        return r.choice([code(16, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), word() + word().capitalize() + word().capitalize(), code(20, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), code(18, "0123456789abcdef"), code(40, "0123456789abcdef")])

    out = []
    for _ in range(n):
        words, marks, held = [word() for _ in range(r.randrange(6, 30))], {}, []
        for _ in range(r.randrange(0, 4)):
            kind = r.choice(LABELS[1:])
            token = r.choice(held)[1] if held and r.random() < 0.4 else special(kind)
            kind = marks.get(token, kind)
            cued = 1.0 if token.isdigit() or token.isalpha() else 0.9 if kind in ("phone", "secret") else 0.3
            cue = [r.choice(CUES[kind])] if r.random() < cued and token not in marks else []
            marks[token] = kind
            held.append((kind, token))
            at = r.randrange(len(words) + 1)
            words[at:at] = [*cue, token]
            for _ in range(r.choice((0, 1, 3, 8)) if cue and (token.isdigit() or token.isalpha()) else 0):  # again, without the cue
                words.insert(r.choice([k for k in range(len(words) + 1) if not k or words[k - 1].lower() not in _CUE_OF]), token)
        for _ in range(r.randrange(0, 4)):  # numbers that are nobody's
            token = r.choice([digits(r.randrange(1, 9)), f"{r.randrange(9)}.{r.randrange(9)}", f"v{r.randrange(9)}.{r.randrange(9)}", f"{word()}{r.randrange(99)}", "1" + digits(3), digits(16), *(word() + word().capitalize() + r.choice(["", word().capitalize()]) for _ in range(3))])
            if token in marks or (len(token) == 16 and token.isdigit() and luhn(token)):
                continue
            for _ in range(r.choice((1, 1, 1, 3))):
                words.insert(r.randrange(len(words) + 1), token)
        out.append((" ".join(words), marks))
    return out


@lru_cache(maxsize=2)
def fitted(n: int = 1000, seed: int = 11, epochs: int = 30, rate: float = 0.3, l2: float = 1e-3) -> Field:
    """A field fitted by pseudo-likelihood: each label given its neighbours' true labels."""
    field = Field()
    examples = []
    for text, marks in training_texts(n, seed):
        d = Document(text)
        gold = [LABELS.index(marks.get(text[a:b], "other")) for a, b in d.spans]
        around = defaultdict(list)
        for i, j in d.chain:
            around[i].append(("chain", gold[j], False))
            around[j].append(("chain", gold[i], True))
        for group, cues in zip(d.groups, d.cues, strict=True):  # a hub has the label of its other mentions
            for k, i in enumerate(group):
                around[i].append(("skip", gold[group[k - 1]], cues))
        examples += [(fs, gold[i], around[i]) for i, fs in enumerate(d.features)]
    for fs, _, _ in examples:
        for f in fs:
            field.unary.setdefault(f, np.zeros(N_LABELS))
    order = random.Random(seed)
    for epoch in range(epochs):
        order.shuffle(examples)
        step = rate / (1 + epoch / 6)
        for fs, gold, near in examples:
            s = sum(field.unary[f] for f in fs)
            for kind, other, seen in near:
                if kind == "skip":
                    s = s + field.skip[:, other]
                    s[other] += field.told[other] * seen[other]
                else:
                    s = s + (field.chain[other] if seen else field.chain[:, other])
            p = np.exp(s - s.max())
            g = p / p.sum()
            g[gold] -= 1
            for f in fs:
                field.unary[f] -= step * (g / len(fs) + l2 * field.unary[f])
            for kind, other, seen in near:
                if kind == "skip":
                    field.skip[:, other] -= step * g
                    field.told[other] -= step * g[other] * seen[other]
                elif seen:
                    field.chain[other] -= step * g
                else:
                    field.chain[:, other] -= step * g
    return field


def all_spans(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base spans with those that the field adds where no base span lies."""
    if not _MAYBE.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added, k = [], 0
    for kind, a, b in decode(field, Document(text)):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not any(x < b and a < y for x, y in taken[max(0, k - 1) : k + 4]):
            added.append((kind, a, b))
    order = {kind: i for i, kind in enumerate(LABELS)}
    return base, sorted(base + added, key=lambda s: (s[1], order[s[0]]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) for every row; starts and ends in code points."""
    field = fitted()
    shared = docs.sparkSession.sparkContext.broadcast((field.unary, field.chain, field.skip, field.told))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field()
        own.unary, own.chain, own.skip, own.told = shared.value
        names = ("kind", "start", "end")
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                found = [all_spans(t.as_py() or "", own) for t in part.column(1)]
                columns = [pa.array([[dict(zip(names, s, strict=True)) for s in x[i]] for x in found], kind) for i in (0, 1)]
                yield pa.record_batch([part.column(0), *columns], ["doc_id", "base", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    item = "array<struct<kind string, start long, end long>>".replace("kind string", "kind: string").replace("start long", "start: bigint").replace("end long", "end: bigint")
    return rows.mapInArrow(run, f"doc_id long, base {item}, spans {item}")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans as the first of them."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
