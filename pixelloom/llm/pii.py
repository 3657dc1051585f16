"""Personal data: fixed patterns, and a linear-chain conditional random field for the forms that they miss.

The field labels words by their shapes and their neighbours' (letters, digits, marks; never the words of a corpus,
except a few cue words). It is trained on the small labelled table below, and decoded by Viterbi over many windows
of words at once in numpy. Only words near a digit, an @, a spelled-out dot or an "at" before a dotted name can be
personal data here, so windows of whole words around those are decoded and every other word is outside by definition: a
linear scan finds them. Words and spans may have any length.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("-", *KINDS)
SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
)
#: Words on either side of a trigger's word that a window takes in; windows decoded at once; the longest words whose
#: features a worker keeps.
REACH, BLOCK, CACHE_CHARS = 12, 4096, 80
#: Words whose features are held at once, and words, with padding, that are decoded at once but for one longer window.
STRETCH, CELLS = 4096, 500_000
STEPS, RATE, RIDGE = 250, 0.1, 0.05

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match never begins inside a run of digits, as the run's beginning would have matched before.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]|\bdot\b|[(\[]at[)\]]|\bat (?=[\w-]{1,63}\.\w)", re.I)
WORD = re.compile(r"\S+")
#: What a spelled-out address must look like inside the words labelled as one: parts joined by dots, an "at", parts.
_DOT, _TOD = r"(?:\.| ?[\[(]?dot[\])]? )", r"(?:\.| [\])]?tod[\[(]? ?)"
AT = re.compile(r" ?(?:\bat\b|[\[(]at[\])]|@) ?", re.I)
AFTER_AT = re.compile(rf"[\w-]+(?:{_DOT}[\w-]+)+", re.I)
BEFORE_AT = re.compile(rf"[\w+-]+(?:{_TOD}[\w+-]+)*", re.I)  # of reversed text

#: The labelled table: one text a line, personal data as {kind:...}.
TABLE = """
call me on {phone:(212) 555-0182} after nine
call {phone:(415) 555-2671} or write
my phone is {phone:212-555-0143} at home
phone: {phone:555-867-5309}
tel. {phone:020 7946 0958} in the office
tel {phone:030 1234 5678} or fax
mobile {phone:06 12 34 56 78} please
mobile {phone:0171 555 2398} today
ring {phone:(0)20 7946 0991} for help
contact: {phone:303.555.0117} now
reach us at {phone:617.555.0199} or by mail
fax {phone:(030) 555-1234}
phone {phone:07911 123456} is mine
call {phone:07700 900123} after six
mobile {phone:07700 900 456} please
tel {phone:01632 960983} in the evening
ring {phone:0161 496 0321} today
phone {phone:030/1234567} at work
phone {phone:0049 30 901820} works too
her number is {phone:312 555 0164} she said
telephone {phone:(800) 555-0134} toll free
write to {email:john dot smith at example dot com} please
mail {email:anna at mail dot org} today
contact {email:info (at) example.org} for more
contact {email:jane.doe (at) example.com} soon
email {email:sales [at] shop [dot] net} now
e-mail {email:support [at] example.com} first
reach {email:peter at firm dot co dot uk} by noon
write {email:mark (at) site (dot) de} or call
write to {email:jane.doe at example.com} please
write to {email:anna.k at mail.firm.org} about it
contact {email:peter.smith at firm.co.uk} by noon
mail {email:sales at shop.net} now
email {email:info at example.org} first
e-mail {email:office at mail.site.de} or call
please write to {email:otto at acme.com} today
you may write to {email:wanda at uni.net} about it
write to {email:lee at blue-sky.co.uk} now
please contact {email:rosa at nord.com} today
you can mail {email:max at wind.de} this week
please write to {email:paul at home dot net} today
mail {email:kim dot berg at firm dot org} for the list
please write me at home.com or call
write to them at work today
read more at example.com today
have a look at example.org please
he works at site.net now
we met at shop.com last year
visit us at www.firm.co.uk now
see us at www.site.org today
find it at www.books.com or call
the server {ip:2001:db8:85a3:0:0:8a2e:370:7334} answered
host {ip:fe80::1ff:fe23:4567:890a} is up
from {ip:2001:db8::1} port 22
address {ip:2001:0db8:0000:0042:0000:8a2e:0370:7334} logged
login from {ip:::ffff:192.0.2.128} failed
node {ip:2001:db8:12::7} lost power
ping {ip:fd00:17:3::25} again
peer {ip:fe80::9c1:44} left
mac 00:1B:44:11:3A:B7 of the card
device 3c:22:fb:90:aa:01 joined
at 08:15:00 the bus and at 23:59:59 the night
card {card:4111.1111.1111.1111} was charged
my card {card:5500.0000.0000.0004} expires soon
visa {card:4012/8888/8888/1881} ok
pay with {card:3400.000000.00009} now
card number {card:4242.4242.4242.4242} is stored
the price was 1,299.00 in 2019 and 2020
on 2024-05-17 at 12:30 we met
version 1.2.3 of 10.4 came out
chapter 12 section 4.5.1 page 303
he was 45 years old in 1998
order 9807915762804490 was shipped
the id 4845168114407329 is not known
number 12345678901 of the list
token = "186661156f3f9905942d70850a01cbf23a" in the file
key 9f86d081884c7d659a2feaa0c55ad015 was lost
sum 123 456 789 in total
between 10 and 20 of 300 people
at 10:45:30 the train left
scores 3-2 and 21-19 were seen
from 1914-1918 and 1939-1945
ratio 16:9 or 4:3
about 50% of 1000 units
the isbn 978-3-16-148410-0 is old
serial 0042-7781-3321 of the box
line 1 line 2 line 3
12 | 34 | 56 | 78 | 90
1.5 2.5 3.5 4.5 5.5
room 101 floor 3 house 27
he is at home and at work
at the dot on the map
the dot is at the end
a dot and a line at the top
look at point 4 at once
section 3 dot 4 is short
population 1 234 567 in 2011
coordinates 52.5200 13.4050
rfc 2616 section 14.9
license version 2.0 of january 2004
under version 3 or later
temperature 20.5 to 25.5
$ 1,000 and 2,500.50
1st 2nd 3rd of may
a1 b2 c3 d4
ss7 and h264 and mp3
path /usr/lib/x86_64 and more
12/31/1999 and 01/02/2003
31.12.1999 and 01.02.2003
x = 3 + 4 * 5
@ home @ work
see @handle for more
phone 5 is new
the mobile 3 costs 99
card 12 of 52
fax 7 of 9
"""
CUES = {"phone", "telephone", "tel", "mobile", "call", "fax", "ring", "number", "card", "visa", "email", "e-mail", "mail", "write", "contact", "at", "dot", "look", "met", "works", "read"}


# Fixed patterns


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain finds them from left to right, in linear time: each @ decides by itself."""
    end = seen = 0
    at = text.find("@")
    while at >= 0:
        start = max(end, seen + len(text[seen:at].rstrip(LOCAL)))
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        seen = max(at + 1, end)
        at = text.find("@", seen)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def patterns(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind by fixed patterns; matches that fail their check are dropped."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = list(emails(text))
    if DIGIT.search(text):
        found["ip"] = [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


# Words and their features


def shape(word: str) -> str:
    """Letters as a, hexadecimal ones with digits as x, digits by number, other characters as they are."""
    hexadecimal = any(c.isdigit() for c in word) and all(c in "0123456789abcdefABCDEF:" for c in word)
    out = re.sub(r"[^\W\d_]+", "x" if hexadecimal else "a", word)
    return re.sub(r"[0-9]+", lambda m: f"{min(len(m[0]), 9)}", out)[:24]


def trim(word: str) -> tuple[int, int]:
    """Where a word begins and ends without the marks around it."""
    start = len(word) - len(word.lstrip(",;\"'<|"))
    end = len(word.rstrip(",;.!?\"'>|:" if not word.endswith("::") else ",;.!?\"'>|"))
    return (start, max(start, end))


def own(word: str) -> tuple[str, ...]:
    """Features of a word by itself."""
    return short_own(word) if len(word) <= CACHE_CHARS else own_features(word)


def own_features(word: str) -> tuple[str, ...]:
    a, b = trim(word)
    core = word[a:b]
    digits = sum(map(str.isdigit, core))
    kinds = "".join(sorted({"d" if c.isdigit() else "a" if c.isalpha() else c for c in core}))[:8]
    lower = core.lower().strip(".:()[]")
    out = [f"s={shape(core)}", f"k={kinds}", f"n={min(digits, 20)}", f"p={sum(not c.isalnum() for c in core)}"]
    if lower in CUES:
        out.append(f"w={lower}")
    if core[:1] in "([":
        out.append("bracket")
    if core.count(":") >= 2 and all(c in "0123456789abcdefABCDEF:." for c in core):
        out.append(f"colons={core.count(':') >= 4 or '::' in core}")
    if 13 <= digits <= 19:
        out.append(f"luhn={luhn(''.join(c for c in core if c in '0123456789'))}")
    return tuple(out)


short_own = lru_cache(200_000)(own_features)


def word_features(words: list[str]) -> list[list[str]]:
    found = [own(w) for w in words]
    out = []
    for i, mine in enumerate(found):
        row = list(mine)
        for step in (-2, -1, 1, 2):
            j = i + step
            row += [f"{step}{f}" for f in found[j][:2] + found[j][4:]] if 0 <= j < len(words) else [f"{step}none"]
        out.append(row)
    return out


# The field


@dataclass
class Field:
    index: dict[str, int]  # feature to row
    weights: np.ndarray  # (feature, label), a last row of zeros
    moves: np.ndarray  # (label, next label)

    def emissions(self, words: list[str]) -> np.ndarray:
        """(word, label); features are made for STRETCH words at a time, with the two on either side that they see."""
        out = []
        for at in range(0, len(words), STRETCH):
            low = max(0, at - 2)
            rows = word_features(words[low : at + STRETCH + 2])[at - low : at - low + STRETCH]
            out += [self.weights[[self.index[f] for f in row if f in self.index]].sum(0) for row in rows]
        return np.stack(out)


def labelled_table(table: str = TABLE) -> list[tuple[list[str], list[int]]]:
    out = []
    for line in table.strip().split("\n"):
        words, labels = [], []
        for piece in re.split(r"(\{\w+:.*?\})(?=\s|$)", line):
            marked = re.fullmatch(r"\{(\w+):(.*)\}", piece)
            for word in (marked[2] if marked else piece).split():
                words.append(word)
                labels.append(LABELS.index(marked[1]) if marked else 0)
        out.append((words, labels))
    return out


def pad(rows: list[np.ndarray], fill: float = 0) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows)), *rows[0].shape[1:]), fill, rows[0].dtype)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(rows: list[tuple[list[str], list[int]]] | None = None) -> Field:
    """Maximises the ridge-penalised likelihood of the labelled rows by Adam, all rows at once."""
    rows = rows or labelled_table()
    featured = [word_features(words) for words, _ in rows]
    index = {f: i for i, f in enumerate(sorted({f for row in featured for word in row for f in word}))}
    k, size = len(LABELS), np.array([len(words) for words, _ in rows])
    n, t = len(rows), size.max()
    x = np.zeros((n, t, len(index)), np.float32)
    y = np.zeros((n, t, k))
    for i, row in enumerate(featured):
        for j, word in enumerate(row):
            x[i, j, [index[f] for f in word]] = 1
            y[i, j, rows[i][1][j]] = 1
    live = np.arange(t) < size[:, None]
    both = live[:, 1:]
    seen = np.einsum("ntk,ntl->kl", y[:, :-1] * both[..., None], y[:, 1:])
    theta = [np.zeros((len(index), k)), np.zeros((k, k))]
    first, second = [np.zeros_like(a) for a in theta], [np.zeros_like(a) for a in theta]
    flat = x.reshape(n * t, -1)
    for step in range(1, STEPS + 1):
        weights, moves = theta
        e = (flat @ weights).reshape(n, t, k)
        ahead, behind = np.zeros((n, t, k)), np.zeros((n, t, k))
        ahead[:, 0] = e[:, 0]
        for j in range(1, t):
            ahead[:, j] = np.where(live[:, j, None], e[:, j] + logsum(ahead[:, j - 1, :, None] + moves, 1), ahead[:, j - 1])
        for j in range(t - 2, -1, -1):
            behind[:, j] = np.where(live[:, j + 1, None], logsum(moves + (e[:, j + 1] + behind[:, j + 1])[:, None, :], 2), 0)
        total = logsum(ahead[:, -1], 1)
        p = np.exp(ahead + behind - total[:, None, None]) * live[..., None]
        pair = np.exp(ahead[:, :-1, :, None] + moves + (e + behind)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
        gradients = [flat.T @ (p - y * live[..., None]).reshape(n * t, k) + RIDGE * weights, pair.sum((0, 1)) - seen + RIDGE * moves]
        for i, g in enumerate(gradients):
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
            theta[i] = theta[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Field(index, theta[0], theta[1])


@lru_cache(1)
def trained() -> Field:
    """The field of the labelled table."""
    return train()


def viterbi(emissions: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """The best labels of each window of words, for many windows at once."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(emissions)
    order = sorted(range(len(emissions)), key=lambda i: len(emissions[i]))
    at = 0
    while at < len(order):
        count = 1
        while count < BLOCK and at + count < len(order) and (count + 1) * len(emissions[order[at + count]]) <= CELLS:
            count += 1
        block = order[at : at + count]
        at += count
        e = pad([emissions[i] for i in block])
        size = np.array([len(emissions[i]) for i in block])
        best, back = e[:, 0], np.zeros(e.shape, np.int8)
        for j in range(1, e.shape[1]):
            ways = best[:, :, None] + moves
            live = (j < size)[:, None]
            back[:, j] = np.where(live, ways.argmax(1), np.arange(e.shape[2]))
            best = np.where(live, ways.max(1) + e[:, j], best)
        labels = np.zeros(e.shape[:2], np.int64)
        labels[:, -1] = best.argmax(1)
        for j in range(e.shape[1] - 1, 0, -1):
            labels[:, j - 1] = back[np.arange(len(block)), j, labels[:, j]]
        for i, row, n in zip(block, labels, size):
            out[i] = row[:n]
    return out


def words_before(text: str, at: int, count: int, floor: int) -> int:
    """Where the word that stands so many words before the one at `at` begins; floor if there are fewer from there on."""
    size = 64
    while True:
        low = max(floor, at - size)
        starts = [low + m.start() for m in WORD.finditer(text[low:at])]
        if len(starts) > count + 1:  # the first may be cut
            return starts[-count - 1]
        if low == floor:
            return floor
        size *= 2


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Runs of whole words (start, end), REACH before and after each digit, @, spelled-out mark or "at" before a dotted
    name. Runs that meet are one."""
    spans: list[list[int]] = []
    at = 0
    while trigger := TRIGGER.search(text, at):
        start, floor = trigger.start(), spans[-1][1] if spans else 0
        if start < floor:
            low = spans[-1][0]
        elif (low := words_before(text, start, REACH, floor)) == floor and spans:
            low = spans[-1][0]
        ends = [m.end() for m in islice(WORD.finditer(text, start), REACH + 1)]
        if spans and low == spans[-1][0]:
            spans[-1][1] = max(spans[-1][1], ends[-1])
        else:
            spans.append([low, ends[-1]])
        at = max(trigger.end(), ends[0])  # others in the same word add nothing
    return [[(low + m.start(), low + m.end()) for m in WORD.finditer(text[low:high])] for low, high in spans]


def is_address(span: str) -> bool:
    try:
        return ipaddress.ip_address(span.strip("[]").split("%")[0]).version == 6
    except ValueError:
        return False


def spelled(span: str) -> tuple[int, int] | None:
    """The first spelled-out address in a span: looked for around each "at", so in linear time."""
    floor = 0
    for found in AT.finditer(span):
        after = AFTER_AT.match(span, found.end())
        before = BEFORE_AT.match(span[floor : found.start()][::-1]) if after else None
        if after and before:
            return found.start() - before.end(), after.end()
        floor = found.start()
    return None


def plausible(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The part of a labelled span that has what its kind must have, whatever its shape."""
    span = text[start:end]
    if kind == "email":
        match = spelled(span)
        return match and (start + match[0], start + match[1])
    digits = [c for c in span if c in "0123456789"]
    good = {
        "card": 13 <= len(digits) <= 19 and luhn("".join(digits)),
        "phone": 9 <= len(digits) <= 15 and not any(c.isalpha() for c in span),
        "ip": is_address(span),
    }
    return (start, end) if good[kind] else None


class Overlaps:
    """Whether a span touches any of some spans."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def added(batch: list[str], field: Field, base: list[dict]) -> list[list[tuple[str, int, int]]]:
    """Spans that the field finds in each text and that touch none of the base spans."""
    owner, words, emissions = [], [], []
    for i, text in enumerate(batch):
        for window in windows(text):
            owner.append(i)
            words.append(window)
            emissions.append(field.emissions([text[a:b] for a, b in window]))
    out: list[list[tuple[str, int, int]]] = [[] for _ in batch]
    touches = [Overlaps([span for spans in found.values() for span in spans]) for found in base]
    for i, window, labels in zip(owner, words, viterbi(emissions, field.moves)):
        text, j = batch[i], 0
        while j < len(window):
            end = j + 1
            while end < len(window) and labels[end] == labels[j]:
                end += 1
            if labels[j]:
                start = window[j][0] + trim(text[window[j][0] : window[j][1]])[0]
                stop = window[end - 1][0] + trim(text[window[end - 1][0] : window[end - 1][1]])[1]
                kind = LABELS[labels[j]]
                span = plausible(kind, text, start, stop) if stop > start else None
                if span and not touches[i](*span):
                    out[i].append((kind, *span))
            j = end
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1:])))


def find(batch: list[str], field: Field) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, added spans) of each text."""
    base = [patterns(text) for text in batch]
    return [([(k, a, b) for k in KINDS for a, b in spans[k]], more) for spans, more in zip(base, added(batch, field, base))]


def personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA of every whole text: base counts and digest, and all spans as kind:start:end in code points.

    A null text counts as empty: no spans. Null and repeated ids pass through, an empty table gives an empty one,
    other columns are ignored. Work is linear in the text, in one narrow pass; words and spans have no longest length."""
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                rows = []
                for base, more in find([t.as_py() or "" for t in batch.column(1)], field):
                    kinds = [k for k, _, _ in base]
                    rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
                columns = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """A text with its personal data as <KIND>; of spans that overlap, the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """docs with personal data masked in text_col, all other columns as they are; a null text stays null."""
    from .common import ship

    ship(docs.sparkSession)
    field = field or trained()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [t.as_py() for t in batch]
            rows = find([t or "" for t in found], field)
            yield pa.array([t if t is None else mask(t, base + more) for t, (base, more) in zip(found, rows)], pa.string())

    # typed by hand: annotations of local names are not evaluated on executors
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(text_col, F.arrow_udf(run, "string")(docs[text_col]))
