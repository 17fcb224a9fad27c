"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field labels white-space tokens with O, B- and I- tags of the four kinds from word shapes, neighbours' shapes and a few cue words. It is
trained by gradient ascent on the exact likelihood over a small labelled table (`labelled` makes one; any table of text and spans will do),
and decoded by Viterbi in numpy over batches of equal-length sequences. A sequence is a stretch of a line around tokens that hold a digit, an
at sign, a spelt at or dot in brackets, the word dot, or an at before a dotted name (written or spelt). Every part of the trained forms lies within REACH tokens of such a token; what lies
farther from all of them is not decoded. `rates` gives the precision and recall of added spans over any labelled table.

Spans of the patterns always stay; a span of the field is added if it meets no pattern span and passes its kind's plausibility test.
Defined cases: a null text is empty and has no spans; repeated rows have the same spans; a null id stays null; empty tables give no rows;
other columns are not read by `find`.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, slices
from .wordcache import ChunkCache

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
REACH = 3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# a match can only begin where a run of digits begins, as a later start in the same run fails alike
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(parts: list[str]) -> bool:
    return all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the patterns' spans, rising."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        run = at
        while run > last and (text[run - 1] in "._%+-" or text[run - 1].isascii() and text[run - 1].isalnum()):
            run -= 1
        found = _DOMAIN.match(text, at + 1) if run < at else None
        if found:
            out.append((run, 0, found.end()))
            last = found.end()
        at = text.find("@", max(at + 1, last))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _octets(m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# --- the field ---------------------------------------------------------------------------------------------------------------------

#: Words that often stand before or inside personal data.
CUES = frozenset("call phone tel mobile fax dial reach mail email e-mail write contact address host server ip card visa pay account number line cell at dot (at) [at] (dot) [dot]".split())
_TRIGGER = re.compile(r"[0-9@]|[(\[](?:at|dot)[)\]]|(?<!\S)dot(?!\S)|(?<!\S)at(?=[ \t]+[A-Za-z0-9-]+(?:\.[A-Za-z]|[ \t]+dot(?!\S)))", re.I)
_TOKEN = re.compile(r"\S+")


def shape(token: str) -> str:
    """Letters as a or A, runs shortened to one; digits as 9, runs up to four; signs as they are."""
    s = re.sub(r"[a-zà-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]+", "A", token))
    return re.sub(r"([^a9A])\1+", r"\1", re.sub(r"9{5,}", "9999", re.sub(r"[0-9]", "9", s)))


def features(tokens: list[str]) -> list[list[str]]:
    shapes = [shape(t) for t in tokens]
    low = [t.lower().strip(".,;:!?") for t in tokens]
    out = []
    for i, s in enumerate(shapes):
        core = s.strip(".,;:!?\"'#*&%$|")
        own = ["bias", "s=" + core, "d=" + str(min(sum(c == "9" for c in s), 8)), "l=" + str("a" in s or "A" in s), "-1=" + (shapes[i - 1] if i else "^"), "+1=" + (shapes[i + 1] if i + 1 < len(shapes) else "$")]
        own += ["w=" + low[i]] * (low[i] in CUES)
        own += ["w-1=" + w for w in low[max(0, i - 1) : i] if w in CUES]
        own += ["w-2=" + w for w in low[max(0, i - 2) : max(0, i - 1)] if w in CUES]
        own += ["w+1=" + w for w in low[i + 1 : i + 2] if w in CUES]
        own += ["dots=" + str(core.count("."))] * ("." in core) + ["dash=" + str(core.count("-"))] * ("-" in core) + ["at"] * ("@" in s)
        out.append(own)
    return out


def labelled(spark: SparkSession, copies: int = 12, seed: int = 11) -> DataFrame:
    """A small labelled table (text, start, end, kind as a list of spans) from written examples whose digits and names vary."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["an", "er", "to", "li", "ma", "so", "ne", "thi", "ou", "re"]) for _ in range(r.randint(2, 4)))
    make = {
        "email": [lambda: f"{word()}.{word()}@{word()}.com", lambda: f"{word()}@{word()}", lambda: f"{word()} (at) {word()}.org", lambda: f"{word()} [at] {word()} [dot] net", lambda: f"{word()}(at){word()}.com", lambda: f"{word()} dot {word()} at {word()} dot com", lambda: f"{word()} at {word()} dot org", lambda: f"{word()}.{word()} at {word()}.com"],
        "ip": [lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: "[.]".join(str(r.randint(0, 255)) for _ in range(4)), lambda: " . ".join(str(r.randint(0, 255)) for _ in range(4))],
        "card": [lambda: " ".join(digits(4) for _ in range(4)), lambda: "-".join(digits(4) for _ in range(4)), lambda: ".".join(digits(4) for _ in range(4)), lambda: digits(16)],
        "phone": [lambda: f"+{r.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"{digits(3)} {digits(3)} {digits(4)}"],
    }
    before = {"email": ["write to", "mail", "contact"], "ip": ["from host", "server", "the"], "card": ["card", "paid with", "account"], "phone": ["call", "tel", "phone", "reach us at"]}
    plain = [lambda: f"{word()} in {r.randint(1900, 2030)} {word()}", lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)} of {word()}", lambda: f"{word()} {r.randint(1, 900)} {word()} {r.randint(1, 99)}", lambda: f"{word()} {r.randint(1, 99)}.{digits(2)} {word()}", lambda: f"page {digits(3)} - {digits(3)}", lambda: f"{word()} {digits(7)} {word()}", lambda: f"on {r.randint(1, 28)}-{r.randint(1, 12)}-{r.randint(1990, 2030)} {word()}", lambda: f"{word()} CC BY-NC {r.randint(1, 4)}.0", lambda: f"{digits(3)} {digits(3)} {digits(3)} {word()}", lambda: f"{word()} {digits(2)}/{digits(2)}/{digits(4)}", lambda: f"key {word()}{digits(6)}{word()}{digits(4)}", lambda: f"the dot {word()} is", lambda: f"{word()} at {word()} dot", lambda: f"meet at {r.randint(1, 12)} {word()}", lambda: f"a dot of {word()}", lambda: f"live at {word()}.Then {word()}", lambda: f"{word()} polka dot {word()}"]
    rows = []
    for _ in range(copies):
        for kind, makers in make.items():
            for maker in makers:
                # digits in threes and names before at mean nothing by themselves: only a cue tells
                bare = maker is make["phone"][-1] or maker in make["email"][-2:]
                for lead in (r.choice(before[kind]), r.choice(before[kind]) if bare else word()):
                    value, tail = maker(), r.choice(["", " " + word(), f" {word()} {word()}", f" {word()} {r.randint(1, 99)}"])
                    text = f"{word()} {lead} {value}{tail}"
                    start = len(text) - len(tail) - len(value)
                    rows.append((text, [(start, start + len(value), kind)]))
        rows += [(f"{word()} {p()} {word()}", []) for p in plain for _ in range(2)]
    return spark.createDataFrame(rows, "text string, spans array<struct<start: long, end: long, kind: string>>")


class Field:
    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.index, self.emit, self.move, self.start = index, emit, move, start

    def emissions(self, tokens: list[str]) -> np.ndarray:
        return np.stack([self.emit[[self.index[f] for f in own if f in self.index]].sum(axis=0) for own in features(tokens)])

    def decode(self, sequences: list[tuple[str, ...]]) -> list[list[int]]:
        """Viterbi, a numpy batch for each sequence length."""
        out: list = [None] * len(sequences)
        by: dict[int, list[int]] = {}
        for i, s in enumerate(sequences):
            by.setdefault(len(s), []).append(i)
        for length, own in by.items():
            e = np.stack([self.emissions(list(sequences[i])) for i in own])
            score, back = self.start + e[:, 0], []
            for t in range(1, length):
                step = score[:, :, None] + self.move
                back.append(step.argmax(axis=1))
                score = step.max(axis=1) + e[:, t]
            tags = [score.argmax(axis=1)]
            for b in reversed(back):
                tags.append(np.take_along_axis(b, tags[-1][:, None], axis=1)[:, 0])
            for i, path in zip(own, np.stack(tags[::-1], axis=1).tolist(), strict=True):
                out[i] = path
        return out


def train(table: DataFrame, steps: int = 120, rate: float = 0.3, penalty: float = 1e-3, most_rows: int = 5_000) -> Field:
    """Fits the field on a labelled table of at most most_rows rows (the lowest by text)."""
    rows = table.where("text IS NOT NULL").orderBy("text").limit(most_rows).collect()
    data = []
    for r in rows:
        tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(r["text"])]
        if not tokens:
            continue
        tags, spans = [], r["spans"] or []
        for a, b, _ in tokens:
            own = next((s for s in spans if a < s["end"] and b > s["start"]), None)
            tags.append(0 if own is None else 1 + 2 * KINDS.index(own["kind"]) + (a > own["start"]))
        data.append((features([t for _, _, t in tokens]), tags))
    index: dict[str, int] = {}
    for feats, _ in data:
        for own in feats:
            for f in own:
                index.setdefault(f, len(index))
    n, width, k = len(data), max((len(t) for _, t in data), default=1), len(TAGS)
    mask = np.zeros((n, width), dtype=bool)
    gold = np.zeros((n, width), dtype=np.int64)
    row, place, col = [], [], []
    for i, (feats, tags) in enumerate(data):
        mask[i, : len(tags)], gold[i, : len(tags)] = True, tags
        for t, own in enumerate(feats):
            row += [i] * len(own)
            place += [t] * len(own)
            col += [index[f] for f in own]
    flat, col = np.array(row, dtype=np.int64) * width + np.array(place, dtype=np.int64), np.array(col, dtype=np.int64)
    order = np.argsort(col, kind="stable")
    flat, col = flat[order], col[order]
    first = np.flatnonzero(np.diff(col, prepend=-1)) if len(col) else np.zeros(0, dtype=np.int64)
    by_place = np.argsort(flat, kind="stable")
    place_first = np.flatnonzero(np.diff(flat[by_place], prepend=-1)) if len(flat) else first
    emit, move, start = np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (emit, move, start)]
    one = np.eye(k)
    total = lambda x, axis: (m := x.max(axis=axis, keepdims=True)) + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))
    for step in range(1, steps + 1 if data else 0):
        e = np.zeros((n * width, k))
        e[flat[by_place][place_first]] = np.add.reduceat(emit[col[by_place]], place_first, axis=0)
        e = e.reshape(n, width, k)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, width):
            alpha[:, t] = np.where(mask[:, t, None], total(alpha[:, t - 1, :, None] + move, 1)[:, 0] + e[:, t], alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], total(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)[:, :, 0], beta[:, t + 1])
        z = total(alpha[:, -1], 1)
        # alpha of a shorter sequence stays at its last token, and beta there is 0
        p = np.exp(alpha + beta - z[:, None]) * mask[:, :, None]
        g_place = (p - one[gold] * mask[:, :, None]).reshape(-1, k)
        g_emit = np.add.reduceat(g_place[flat], first, axis=0) / n
        g_start = (p[:, 0] - one[gold[:, 0]]).sum(axis=0) / n
        g_move = np.zeros((k, k))
        for t in range(1, width):
            both = np.exp(alpha[:, t - 1, :, None] + move + (e[:, t] + beta[:, t])[:, None, :] - z[:, :, None]) * mask[:, t, None, None]
            g_move += both.sum(axis=0)
            np.add.at(g_move, (gold[mask[:, t], t - 1], gold[mask[:, t], t]), -1)
        for x, g, (m, v) in zip((emit, move, start), (g_emit, g_move / n, g_start), moments, strict=True):
            g = g + penalty * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(index, emit, move, start)


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Token places of each stretch around triggers: lines' tokens within REACH of one."""
    out: list[list[tuple[int, int]]] = []
    done = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < done:
            continue
        left = text.rfind("\n", 0, m.start()) + 1
        right = text.find("\n", m.start())
        right = len(text) if right < 0 else right
        done = right
        tokens = [(left + t.start(), left + t.end()) for t in _TOKEN.finditer(text[left:right])]
        begins = [a for a, _ in tokens]
        hot = {bisect_right(begins, t.start()) - 1 for t in _TRIGGER.finditer(text, left, right)}
        near = sorted({j for i in hot for j in range(max(0, i - REACH), min(len(tokens), i + REACH + 1))})
        run: list[tuple[int, int]] = []
        for k, j in enumerate(near):
            if k and near[k - 1] != j - 1:
                out.append(run)
                run = []
            run.append(tokens[j])
        if run:
            out.append(run)
    return out


def plausible(kind: str, value: str) -> bool:
    digits = _digits(value)
    if kind == "email":
        # a name, an at in some form, and a name; the field has decided that they belong together
        dots = r"(?:\s*(?:\.|[(\[]dot[)\]]|(?<=\s)dot(?=\s))\s*[\w%+-]+)"
        return bool(re.fullmatch(rf"[\w.%+-]+@[\w-]*[a-z][\w-]*|[\w%+-]+{dots}*\s*(?:@|[(\[]at[)\]]|(?<=\s)at(?=\s))\s*[\w-]+{dots}+", value, re.I))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", value)
        return len(parts) == 4 and _octets(parts) and not re.search(r"[A-Za-z]", value)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[A-Za-z]", value)
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9](?:[ ().-]{0,3}[0-9])+", value)) and bool(re.search(r"[ ().-]", value))


def field_spans(field: Field, texts: list[str], cache: ChunkCache) -> list[list[tuple[int, int, int]]]:
    """(start, kind's index, end) of the field's plausible spans in each text."""
    found = [stretches(x) for x in texts]
    key = [[tuple(text[a:b] for a, b in s) for s in own] for text, own in zip(texts, found, strict=True)]
    tags = cache.get({s for own in key for s in own})
    out = []
    for text, own, keys in zip(texts, found, key, strict=True):
        spans = []
        for places, k in zip(own, keys, strict=True):
            path, i = tags[k], 0
            while i < len(path):
                if not path[i]:
                    i += 1
                    continue
                kind, j = (path[i] - 1) // 2, i + 1
                while j < len(path) and path[j] == 2 + 2 * kind:
                    j += 1
                start, end = places[i][0], places[j - 1][1]
                while start < end and not (text[start].isalnum() or text[start] in "+("):
                    start += 1
                while end > start and not text[end - 1].isalnum():
                    end -= 1
                if plausible(KINDS[kind], text[start:end]):
                    spans.append((start, kind, end))
                i = j
        out.append(spans)
    return out


def rates(table: DataFrame, field: Field) -> tuple[float, float]:
    """Precision and recall of the field's added spans over a labelled table, among the spans that no pattern meets."""
    scan = scanner(field)
    right = given = wanted = 0
    for r in table.where("text IS NOT NULL").toLocalIterator():
        ((base, every),) = scan([r["text"]])
        free = lambda a, b, base=base: not any(a < e and s < b for s, _, e in base)
        true = {(s["start"], s["end"], s["kind"]) for s in r["spans"] or [] if free(s["start"], s["end"])}
        # digits in groups are no card if they fail the check
        true = {x for x in true if x[2] != "card" or luhn(_digits(r["text"][x[0] : x[1]]))}
        added = {(a, b, KINDS[k]) for a, k, b in every} - {(a, b, KINDS[k]) for a, k, b in base}
        right, given, wanted = right + len(true & added), given + len(added), wanted + len(true)
    return right / max(given, 1), right / max(wanted, 1)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def both(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The base spans (by start), and those of `more` that meet none of them: none that begins before their end reaches beyond their start."""
    if not more:
        return base
    starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
    upto = [bisect_left(starts, s[2]) for s in more]
    return sorted(base + [s for s, k in zip(more, upto, strict=True) if not k or reach[k - 1] <= s[0]])


def scanner(field: Field):
    """A function of texts that gives (base spans, all spans) for each."""
    cache = ChunkCache(lambda new: field.decode(new), most=100_000)

    def scan(texts: list[str]) -> list[tuple[list, list]]:
        return [(b, both(b, m)) for b, m in zip(map(base_spans, texts), field_spans(field, texts, cache), strict=True)]

    return scan


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone: the patterns' counts, base_sha256, spans: all, n_added)."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(field)
        for part in chunks(batches):
            rows = []
            for doc_id, (base, every) in zip(part["doc_id"], scan(part["text"]), strict=True):
                rows.append((doc_id, *(sum(s[1] == k for s in base) for k in range(4)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), len(every) - len(base)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (5, 6) else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or overlapping spans together, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with the spans masked in the text column; a null text stays null."""

    own: list = []  # each Python worker's scanner

    @F.arrow_udf("string")
    def mask(column: pa.Array) -> pa.Array:
        if not own:
            own.append(scanner(field))
        parts = [pa.array([], pa.string())]
        for part in slices(column, column):
            texts = part.to_pylist()
            found = own[0]([x or "" for x in texts])
            parts.append(pa.array([masked(x, every) if x and every else x for x, (_, every) in zip(texts, found, strict=True)], pa.string()))
        return pa.concat_arrays(parts)

    return docs.withColumn(text_col, mask(F.col(text_col)))
