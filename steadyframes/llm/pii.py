"""Personal data by patterns and a linear-chain conditional random field over word shapes.

The field is trained in numpy from EXAMPLES, a small labelled table in which personal data stands in braces. A text
is cut into words at white space and into sequences at line ends and after words that end a sentence. A word's
features come from its shape (letters and digits folded to runs), its length class, and itself where the table has
it; each word also sees its neighbours'. All features are of single words, so their scores are summed once per
distinct word. A sequence in which no word can gain by any label other than "none" needs no decoding: every path
through it scores at most what "none" throughout does. The others are decoded by Viterbi in batches.

Spans of the patterns (the base) always stay. A span of the field is added where it overlaps no kept span, is of a
kind's plausible form (so many digits, a Luhn sum for cards), and has at least MARGIN more score than none.

Defined cases: null and empty texts have no spans; repeated rows give equal results; columns named like an output
are replaced; positions count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from steadyframes.llm.textbytes import LOWER, WHITE, blocks, distinct_spans, held, spans

KINDS = ("email", "ip", "card", "phone")
MARGIN = 2.0

# A small labelled table. {kind:...} marks personal data.
EXAMPLES = """
write to {email:ann.lee@mail.example.org} or call {phone:+44 20 7946 0018} today.
my address is {email:bob_77@corp.example.net}, thanks
mail {email:kim at mail dot example dot com} for the keys
mail {email:jo (at) example (dot) org} please
reach me: {email:sam [at] post [dot] example [dot] net}.
ask {email:li.wei@uni.example.edu}; or {email:x.y@a.example.io}
server {ip:10.0.12.7} answered, then {ip:192.168.1.254} failed
host {ip:172.16.254.1} port 8080
from {ip:8.8.4.4} to {ip:203.0.113.195}.
ping {ip:198.51.100.23} | ok |
card {card:4556737586899855} paid
charge {card:4556 7375 8689 9855} again
number {card:5425-2334-3010-9903} expires 12/27
{card:2221000000000009} {card:4917484589897107} were both used
pay with {card:4000056655665556} , thanks.
old {card:4539578763621486} and new {card:4485275742308327} cards
phone {phone:+1 (212) 555-0143} after nine
phone {phone:+49 30 901820} now
tel {phone:(415) 555-2671} or {phone:+33 1 70 18 99 00}.
call {phone:+1 (646) 555-0199} and {phone:+1 (646) 555-0102}
call me at {phone:(020) 555-8841} , the office is closed
sms {phone:+81 3 1234 5678} | home |
the meeting is at noon at the main hall
meet me at dot point seven in the park
the dot on the map is at home
version 1.2.3 was built on 2021-03-04 at 10:22
room 101 (at the end) costs 45 or 1,250.00 in all
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" then
key abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71 ok
Licensed under the Apache License, Version 2.0.
Copyright (c) 2019 The Authors. All rights reserved.
order 1234567 of 2020 shipped in 3 boxes
id 12345678901234567890 and 99 more
| col | 12 | 345 | 6.5 |
see page 12 - 14 and section 3.4.5
1 2 3 4 5 6 7 8 9 10 11 12
the price rose from 1999 to 2005 by 3.5 %
(see also) the (second) part [of] the text
thonwhing re the of ering, anble. Onre
de la mente que les, Éçan oui
der die einung heit. Und schein
$$$ ### !!! *** %%%
https://example.org/a/b?c=1 is a link
a + b = c and x - y
""".strip()

LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
_MARK = re.compile(r"\{(\w+):([^}]*)\}")
_ENDS = b".!?"

# The base patterns, each after the last match of its kind.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by kind as listed and then by start."""
    out = []
    at, after = text.find("@"), 0
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        after = m.end() if m else at + 1
        if m:
            out.append(("email", start, after))
        at = text.find("@", after)
    at = 0
    while m := _IP.search(text, at):
        # A run of digits that fails as a whole fails from each of its later digits too.
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (x.lstrip("0")[:4] or "0" for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
        at = m.end()
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _parts_ip(s: str) -> bool:
    return bool(_IP.fullmatch(s)) and all(int(p) <= 255 for p in s.split(".") if len(p) < 9) and all(len(p) <= 3 for p in s.split("."))


def plausible(kind: str, s: str) -> bool:
    """Whether a span of the field has its kind's form."""
    if kind == "card":
        d = _digits(s)
        return 13 <= len(d) <= 19 and luhn(d) and all(c in "0123456789 -" for c in s)
    if kind == "phone":
        return 8 <= len(_digits(s)) <= 15 and all(c in "0123456789 +().-" for c in s)
    if kind == "ip":
        return _parts_ip(s)
    words = re.split(r"\s+", s.strip())
    return "@" in s or (len(words) >= 4 and any(w.strip("()[]") == "at" for w in words[1:-1]) and any(w.strip("()[]") == "dot" for w in words[2:-1]))


_SHAPE = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^\x00-\x7F]+")


def shape(word: str) -> str:
    """Runs of capitals, small letters and other letters as X, x, y; of digits as d and their number (9 at most, 16 to 19 apart)."""

    def fold(m):
        c, n = m[0][0], len(m[0])
        if c.isdigit() and c.isascii():
            return f"d{n}" if n <= 4 or 16 <= n <= 19 else "d+"
        return "X" if "A" <= c <= "Z" else "x" if c.isascii() else "y"

    return _SHAPE.sub(fold, word)


def _bare(word: str) -> str:
    return word.strip(".,;:!?|\"'").lower()


class Field:
    """Weights of the field: of a word's features for its own label, the next word's and the one's before; and between labels."""

    def __init__(self):
        self.known = {}
        self.lexicon: set[str] = set()
        self.features: dict[str, int] = {}
        lines = []
        for line in EXAMPLES.split("\n"):
            words, labels = [], []
            at = 0
            for m in [*_MARK.finditer(line), None]:
                plain = line[at : m.start() if m else len(line)]
                if plain and words and not plain[0].isspace():  # punctuation that sticks to the span
                    stuck, _, plain = plain.partition(" ")
                    words[-1] += stuck
                words += plain.split()
                labels += ["O"] * (len(words) - len(labels))
                if m:
                    inner = m[2].split()
                    words += inner
                    labels += [f"B-{m[1]}"] + [f"I-{m[1]}"] * (len(inner) - 1)
                    at = m.end()
            lines.append((words, [LABELS.index(x) for x in labels]))
        self.lexicon = {b for words, _ in lines for w in words if (b := _bare(w)).strip("()[]") in ("at", "dot")}
        for words, _ in lines:
            for w in words:
                for f in self.names(w):
                    self.features.setdefault(f, len(self.features))
        n = len(self.features) + 2
        self.edge = n - 2  # beyond the ends of a sequence; n - 1: a feature that the table lacks
        self.weights = np.zeros((3, n, len(LABELS)))
        self.between = np.zeros((len(LABELS), len(LABELS)))
        self._forbid = np.zeros_like(self.between)
        for j, to in enumerate(LABELS):
            if to[0] == "I":
                for i, of in enumerate(LABELS):
                    if of[2:] != to[2:] or of == "O":
                        self._forbid[i, j] = -1e4
        self._train(lines)

    def names(self, word: str) -> list[str]:
        s, b = shape(word), _bare(word)
        out = ["*", f"s{s}", f"b{shape(b)}", f"k{''.join(sorted(set(re.sub(r'[0-9]', '', s))))}", f"d{min(len(_digits(word)), 20) if _digits(word) else 0}"]
        if b in self.lexicon:
            out.append(f"w{b}")
        return out

    def ids(self, word: str) -> list[int]:
        return [self.features.get(f, len(self.features) + 1) for f in self.names(word)]

    def _train(self, lines, steps: int = 300, rate: float = 0.1, decay: float = 0.01) -> None:
        """Adam on the mean log-likelihood, by the forward-backward recursions over all lines at once."""
        longest, L, count = max(len(w) for w, _ in lines), len(LABELS), len(lines)
        n = self.weights.shape[1]
        hot = np.zeros((3, count, longest, n))
        gold = np.zeros((count, longest), int)
        mask = np.zeros((count, longest), bool)
        for k, (words, labels) in enumerate(lines):
            ids = [[self.edge], *[self.ids(w) for w in words], [self.edge]]
            for t in range(len(words)):
                for side, off in enumerate((1, 0, 2)):
                    hot[side, k, t, ids[t + off]] = 1
            gold[k, : len(words)], mask[k, : len(words)] = labels, True
        params = [self.weights, self.between]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        gold_hot = np.eye(L)[gold] * mask[..., None]
        for step in range(1, steps + 1):
            e = sum(hot[s] @ self.weights[s] for s in range(3))
            a = self.between + self._forbid
            forward, backward = np.zeros((count, longest, L)), np.zeros((count, longest, L))
            forward[:, 0] = e[:, 0] + self._first()
            for t in range(1, longest):
                x = _lse(forward[:, t - 1, :, None] + a[None], 1) + e[:, t]
                forward[:, t] = np.where(mask[:, t, None], x, forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                x = _lse(a[None] + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
                backward[:, t] = np.where(mask[:, t + 1, None], x, 0)
            z = _lse(forward[:, -1], 1)
            p = np.exp(np.minimum(forward + backward - z[:, None, None], 0)) * mask[..., None]
            grads = [np.stack([np.einsum("ktn,ktl->nl", hot[s], gold_hot - p) for s in range(3)]), np.zeros((L, L))]
            for t in range(1, longest):
                q = np.exp(np.minimum(forward[:, t - 1, :, None] + a[None] + (e[:, t] + backward[:, t])[:, None, :] - z[:, None, None], 0)) * mask[:, t, None, None]
                grads[1] += np.einsum("ki,kj->ij", gold_hot[:, t - 1], gold_hot[:, t]) - q.sum(0)
            for par, g, (m1, m2) in zip(params, grads, moments, strict=True):
                g = g / count - decay / count * par
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                par += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)

    def _first(self) -> np.ndarray:
        return np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])

    def scores(self, word: str) -> np.ndarray:
        """What a word adds to the labels of itself, of the word after it and of the word before it: 3 x labels."""
        s, b = shape(word), _bare(word)
        key = (s, shape(b), b if b in self.lexicon else "", min(len(_digits(word)), 20))
        got = self.known.get(key)
        if got is None:
            got = np.stack([self.weights[side][self.ids(word)].sum(0) for side in range(3)])
            if len(s) <= 256:  # longer shapes are worked out each time, to bound memory
                if len(self.known) > 200_000:
                    self.known.clear()
                self.known[key] = got
        return got


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def viterbi(emit: np.ndarray, lengths: np.ndarray, field: Field) -> np.ndarray:
    """Best labels of padded sequences (count x longest x labels); beyond a sequence's end the label is O."""
    a = field.between + field._forbid
    count, longest, L = emit.shape
    back = np.zeros((count, longest, L), np.int8)
    best = emit[:, 0] + field._first()
    for t in range(1, longest):
        x = best[:, :, None] + a[None]
        back[:, t] = x.argmax(1)
        best = np.where((t < lengths)[:, None], x.max(1) + emit[:, t], best)
    out = np.zeros((count, longest), np.int8)
    label = best.argmax(1)
    rows = np.arange(count)
    for t in range(longest - 1, -1, -1):
        inside = t < lengths
        out[inside, t] = label[inside]
        label = np.where(inside, back[rows, t, label], label) if t else label
    return out


def field() -> Field:
    return held(("field",), Field)


#: Bytes that keep a word plain: letters of all kinds and the punctuation of prose.
_PLAIN = np.zeros(256, bool)
_PLAIN[65:91] = _PLAIN[97:123] = _PLAIN[128:] = True
_PLAIN[[44, 46, 59, 58, 33, 63]] = True


def _word_table(f: Field, data: bytes, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Each word's number in a table of scores. Plain words that the table of examples lacks share rows by shape."""
    plain_bytes = np.concatenate(([0], np.cumsum(~_PLAIN[buf])))
    odd = plain_bytes[ends] > plain_bytes[starts]
    # Short words may be among the words that count by themselves.
    odd |= ((ends - starts) <= 6) & np.isin(LOWER[buf[starts]], [ord(w.strip("([")[0]) for w in f.lexicon])
    tables, index = [], np.zeros(len(starts), np.int64)
    at = np.flatnonzero(odd)
    if len(at):
        first, inverse = distinct_spans(buf, starts[at], ends[at])
        tables += [f.scores(data[s:e].decode()) for s, e in zip(starts[at][first].tolist(), ends[at][first].tolist(), strict=True)]
        index[at] = inverse
    at = np.flatnonzero(~odd)
    if len(at):
        # The shape of a plain word is settled by which classes of bytes follow each other.
        cls = np.zeros(len(buf), np.uint8)
        cls[(buf >= 97) & (buf < 123)] = 1
        cls[(buf >= 65) & (buf < 91)] = 2
        cls[buf >= 128] = 3
        punct = cls == 0
        cls[punct] = buf[punct]
        change = np.ones(len(buf), bool)
        change[1:] = (cls[1:] != cls[:-1]) | (cls[1:] > 3)
        change[starts] = True
        kept = np.flatnonzero(change)
        low, high = np.searchsorted(kept, starts[at]), np.searchsorted(kept, ends[at])
        first, inverse = distinct_spans(cls[kept], low, high)
        tables_at = len(tables)
        tables += [f.scores(data[s:e].decode()) for s, e in zip(starts[at][first].tolist(), ends[at][first].tolist(), strict=True)]
        index[at] = inverse + tables_at
    return np.stack(tables) if tables else np.zeros((0, 3, len(LABELS))), index


def field_spans(f: Field, buf: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """By row: (kind, first byte, end byte) of the field's labels, bytes counted in the block."""
    starts, ends, rows = spans(~WHITE[buf], offsets)
    if not len(starts):
        return {}
    table, index = _word_table(f, buf.tobytes(), buf, starts, ends)
    # Sequences begin with rows, after line ends, and after words that end a sentence.
    begin = np.zeros(len(starts), bool)
    begin[rows[:-1][rows[:-1] < len(starts)]] = True
    lines = np.concatenate(([0], np.cumsum(buf == 10)))
    begin[1:] |= (lines[starts[1:]] > lines[ends[:-1]]) | (np.isin(buf[ends[:-1] - 1], list(_ENDS)) & (ends[:-1] - starts[:-1] > 1))
    edge = np.stack([f.weights[s][f.edge] for s in range(3)])
    # Bound of a word's gain by any label over none, with its neighbours and the moves between labels.
    own, nxt, prev = (table[:, s, 1:].max(1) - table[:, s, 0] for s in range(3))
    last = np.append(begin[1:], True)
    gain = own[index]
    gain[1:] += np.where(begin[1:], (edge[1, 1:].max() - edge[1, 0]), nxt[index[:-1]])
    gain[0] += edge[1, 1:].max() - edge[1, 0]
    gain[:-1] += np.where(begin[1:], edge[2, 1:].max() - edge[2, 0], prev[index[1:]])
    gain[-1] += edge[2, 1:].max() - edge[2, 0]
    slack = 2 * max(0.0, float(f.between.max() - f.between[0, 0]))
    sequence = np.cumsum(begin) - 1
    hot = np.unique(sequence[gain + slack > 0])
    if not len(hot):
        return {}
    lo, hi = np.flatnonzero(begin)[hot], np.flatnonzero(last)[hot] + 1
    out: dict[int, list[tuple[str, int, int]]] = {}
    order = np.argsort(hi - lo, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 512 and (hi - lo)[order[end]] * (end - at) < 100_000:
            end += 1
        some = order[at:end]
        lengths = (hi - lo)[some]
        place = lo[some][:, None] + np.minimum(np.arange(lengths.max()), lengths[:, None] - 1)
        emit = table[index[place], 0]
        emit[:, 1:] += table[index[place[:, :-1]], 1]
        emit[:, 0] += edge[1]
        emit[:, :-1] += table[index[place[:, 1:]], 2]
        final = np.arange(len(some)), lengths - 1
        before = table[index[place[final[0], np.maximum(lengths - 2, 0)]], 1]
        emit[final] = table[index[place[final]], 0] + np.where((lengths > 1)[:, None], before, edge[1]) + edge[2]
        labels = viterbi(emit, lengths, f)
        for k, t in zip(*np.nonzero((labels > 0) & (labels % 2 == 1)), strict=True):
            stop = t + 1
            while stop < lengths[k] and labels[k, stop] == labels[k, t] + 1:
                stop += 1
            over = emit[k, np.arange(t, stop), labels[k, t:stop]].sum() - emit[k, t:stop, 0].sum()
            if over < MARGIN:
                continue
            a, b = int(starts[place[k, t]]), int(ends[place[k, stop - 1]])
            row = int(np.searchsorted(rows, place[k, t], "right") - 1)
            out.setdefault(row, []).append((KINDS[labels[k, t] // 2], a, b))
        at = end
    return out


_TRIM_LEFT, _TRIM_RIGHT = "\"'|,;:([{<=*$#%!&", "\"'|,;:.!?)]}>=*$#%&"


def _trimmed(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """Without the punctuation that sticks to the first and last word."""
    left = _TRIM_LEFT.replace("(", "") if kind == "phone" else _TRIM_LEFT
    while a < b and text[a] in left:
        a += 1
    while a < b and text[b - 1] in _TRIM_RIGHT:
        b -= 1
    return a, b


#: Bytes that any base match holds: a digit or an at sign.
_TELLS = np.zeros(256, bool)
_TELLS[48:58] = _TELLS[64] = True


def find(buf: np.ndarray, offsets: np.ndarray):
    """For each row: base spans and added spans, in code points."""
    f = field()
    added = field_spans(f, buf, offsets)
    tells = np.concatenate(([0], np.cumsum(_TELLS[buf])))
    data = buf.tobytes()
    for r in range(len(offsets) - 1):
        a, b = int(offsets[r]), int(offsets[r + 1])
        own = added.get(r)
        if tells[a] == tells[b] and not own:
            yield [], []
            continue
        text = data[a:b].decode()
        base = base_spans(text) if tells[a] != tells[b] else []
        more: list[tuple[str, int, int]] = []
        for kind, x, y in own or ():
            start = len(data[a:x].decode())
            start, end = _trimmed(kind, text, start, start + len(data[x:y].decode()))
            if start < end and plausible(kind, text[start:end]) and all(end <= s or e <= start for _, s, e in [*base, *more]):
                more.append((kind, start, end))
        yield base, more


def said(spans_: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans_, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def annotate(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """All columns and pii: array of (kind, start, end, base), and redacted: the text with each span as [KIND]."""
    names = ["pii", "redacted"]
    kept = docs.drop(*[c for c in docs.columns if c in names])
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for at, end, buf, offsets in blocks(texts):
                pii, red = [], []
                for r, (base, more) in enumerate(find(buf, offsets)):
                    all_ = sorted([(*s, True) for s in base] + [(*s, False) for s in more], key=lambda x: (x[1], -x[2]))
                    pii.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in all_])
                    t = texts[at + r].as_py()
                    if all_:
                        parts, last = [], 0
                        for kind, s, e, _ in all_:
                            if s >= last:
                                parts += [t[last:s], f"[{kind.upper()}]"]
                            last = max(last, e)
                        t = "".join([*parts, t[last:]])
                    red.append(t)
                own = [c.slice(at, end - at) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(pii, item), pa.array(red, pa.string())], names=[*batch.schema.names, *names])

    extra = StructType.fromDDL("pii array<struct<kind:string,start:long,end:long,base:boolean>>, redacted string")
    return kept.mapInArrow(run, StructType(kept.schema.fields + extra.fields))


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents with every span of personal data replaced by [KIND]."""
    clash = {c: f"__{c}" for c in ("pii", "redacted") if c in docs.columns}
    found = annotate(docs.withColumnsRenamed(clash), text=text).withColumn(text, F.col("redacted")).drop("pii", "redacted")
    return found.withColumnsRenamed({b: a for a, b in clash.items()}).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans: these and the field's."""

    def run(batches):
        for batch in batches:
            out = []
            for _, _, buf, offsets in blocks(batch.column(1)):
                for base, more in find(buf, offsets):
                    out.append((*[sum(k == kind for k, _, _ in base) for kind in KINDS], hashlib.sha256(said(base).encode()).hexdigest(), said([*base, *more])))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
