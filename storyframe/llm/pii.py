"""Personal data: a character-level bidirectional LSTM with CRF transitions, beside fixed base patterns.

The network is trained in numpy from labelled spans: spans of made-up e-mail addresses, IP addresses, card and phone
numbers, in plain and in spaced or punctuated forms, are set into lines of a bounded sample of documents. In prediction
every character of every text is in one or more windows of `WINDOW` characters that overlap by `OVERLAP`. Windows are
decoded by Viterbi; a character takes the tag of the window in which it is farther from an edge, and spans are read from
the tags of the whole text, so one may cross windows. A span of the network is kept if it has the make-up of its
kind (a checksum, parts in range, a digit count) and overlaps no base span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyframe.llm.common import batch, slices, trained
from storyframe.llm.recurrent import Adam, Lstm, Tagger, cut, windows

KINDS = ("email", "ip", "card", "phone")
#: Characters of an address before its @, and what follows; the whole of four or more dotted numbers.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

SIZE, WINDOW, OVERLAP, BATCHES, BATCH, SAMPLE, SAMPLE_CHARS = 8, 256, 32, 180, 128, 400, 4096
#: An address has at most 254 characters; room for blanks and brackets in it.
MOST_ADDRESS = 400
_SYMBOLS = 129  # ASCII, and one for all else


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _byte(number: str) -> bool:
    """0 to 255, with any number of zeros before."""
    number = number.lstrip("0")
    return len(number) <= 3 and int(number or "0") <= 255


Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ ends one run of local characters, which begins after the match before; so a text is read once, however long its runs are."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = done + len(text[done:at].rstrip(_LOCAL))
        if begin < at and (m := _DOMAIN.match(text, at)):
            yield begin, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Dotted numbers, four at a time."""
    for m in _DOTTED.finditer(text):
        parts, begin = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            end = begin + sum(map(len, parts[i : i + 4])) + 3
            if all(map(_byte, parts[i : i + 4])):
                yield begin, end
            begin = end + 1


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start; leftmost, not overlapping within a kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", a, b) for a, b in _addresses(text)]
    # 19 digits with a sign between each two have 37 characters
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


_SPACED_AT = re.compile(r"^[\w.%+-]+(?:@|\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20|\x20@\x20)[\w-]+(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\x20\.\x20)[\w-]+)+$", re.ASCII)


def plausible(kind: str, found: str) -> bool:
    """The make-up that a span of the network must have."""
    if len(found) > MOST_ADDRESS:
        return False
    digits = _digits(found)
    if kind == "email":
        return bool(_SPACED_AT.match(found))
    if kind == "ip":
        parts = re.split(r"[^0-9]+", found)
        return len(parts) == 4 and all(p and _byte(p) for p in parts) and not re.search(r"[A-Za-z]", found)
    if re.search(r"[^0-9\x20().+/_-]", found):
        return False
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15 and bool(re.match(r"^(\+|00|\()", found))


def crf_log_z(unary: np.ndarray, trans: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scores (T, B, K): log partition (B), marginals (T, B, K) and expected transitions (K, K), where live is 1."""
    steps, wide, kinds = unary.shape
    fore, back = np.zeros_like(unary), np.zeros_like(unary)
    fore[0] = unary[0]

    def add(x: np.ndarray, axis: int) -> np.ndarray:
        most = x.max(axis=axis, keepdims=True)
        return most.squeeze(axis) + np.log(np.exp(x - most).sum(axis=axis))

    for t in range(1, steps):
        now = add(fore[t - 1][:, :, None] + trans, 1) + unary[t]
        fore[t] = np.where(live[t][:, None] > 0, now, fore[t - 1])
    for t in range(steps - 2, -1, -1):
        now = add(trans + (unary[t + 1] + back[t + 1])[:, None, :], 2)
        back[t] = np.where(live[t + 1][:, None] > 0, now, back[t + 1])
    log_z = add(fore[-1], 1)
    marginal = np.exp(fore + back - log_z[:, None]) * live[:, :, None]
    pair = np.zeros((kinds, kinds))
    for t in range(1, steps):
        joint = fore[t - 1][:, :, None] + trans + (unary[t] + back[t])[:, None, :] - log_z[:, None, None]
        pair += (np.exp(joint) * live[t][:, None, None]).sum(axis=0)
    return log_z, marginal, pair


def viterbi(unary: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best tags (T, B) of scores (T, K, B)."""
    steps, kinds, wide = unary.shape
    best = unary[0].copy()
    came = np.zeros((steps, kinds, wide), np.int8)
    for t in range(1, steps):
        score, now = unary[t], np.empty_like(best)
        for k in range(kinds):
            top, arg = best[0] + trans[0, k], np.zeros(wide, np.int8)
            for j in range(1, kinds):
                other = best[j] + trans[j, k]
                better = other > top
                arg[better] = j
                np.maximum(top, other, out=top)
            now[k], came[t, k] = top + score[k], arg
        best = now
    tags = np.zeros((steps, wide), np.int8)
    tags[-1] = best.argmax(axis=0)
    across = np.arange(wide)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = came[t, tags[t], across]
    return tags


def doubtful(unary: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The columns of scores (T, K, B) whose best path may leave tag 0.

    Against the path that stays at 0, each character in another tag gains what it scores over tag 0 plus at most `inner` for its
    transition, and each stay pays at least `toll` to come or go, unless it fills the window. So a window is certain if no run
    of characters gains as much as the toll and all of them together gain less than 0.
    """
    inner = max(0.0, float((trans[1:, 1:] - trans[0, 0]).max()))
    toll = float(trans[0, 0] - max(trans[0, 1:].max(), trans[1:, 0].max()))
    gain = unary[:, 1:].max(axis=1) - unary[:, 0] + np.float32(inner)
    most = run = np.zeros(gain.shape[1], np.float32)
    for now in gain:
        run = np.maximum(run, 0) + now
        most = np.maximum(most, run)
    return np.flatnonzero((most >= toll - 1e-3) | (gain.sum(axis=0) >= -1e-3))


def _symbols(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128).astype(np.int16)


class PiiModel:
    """Tags: 0 outside, 1 + the place of the kind inside."""

    def __init__(self, tagger: Tagger, trans: np.ndarray) -> None:
        self.tagger, self.trans = tagger, trans

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """A tag for every character of every text."""
        flat = _symbols("".join(texts))
        lengths = np.array([len(t) for t in texts])
        first = np.cumsum(lengths) - lengths
        text, start, size = windows(lengths, WINDOW, WINDOW - OVERLAP)
        out = np.zeros(len(flat), np.int8)
        for i in range(0, len(text), 1 << 12):
            w, s, n = text[i : i + (1 << 12)], start[i : i + (1 << 12)], size[i : i + (1 << 12)]
            x = cut(flat, first[w] + s, n, WINDOW, _SYMBOLS)
            unary = self.tagger.predict(x)
            unsure = doubtful(unary, self.trans)
            tag = np.zeros(x.shape, np.int8)
            if len(unsure):
                tag[:, unsure] = viterbi(unary[:, :, unsure], self.trans)
            # half of an overlap belongs to either window
            low = np.where(s > 0, OVERLAP // 2, 0)
            high = np.where(s + n < lengths[w], n - OVERLAP // 2, n)
            place = np.arange(WINDOW)[:, None]
            mine = (place >= low) & (place < high)
            out[(first[w] + s + place)[mine]] = tag[mine]
        return np.split(out, first[1:])

    def spans(self, text: str, tags: np.ndarray, base: list[Span]) -> list[Span]:
        if not tags.any():
            return []
        cuts = np.flatnonzero(np.diff(tags, prepend=0, append=0))
        out = []
        # base spans by start, and the farthest end up to each
        order = sorted((s, e) for _, s, e in base)
        starts, ends = [s for s, _ in order], list(accumulate((e for _, e in order), max))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if tag := int(tags[a]):
                found = text[a:b]
                a += len(found) - len(found.lstrip(" ,;:.\n"))
                found = found.strip(" ,;:.\n")
                b = a + len(found)
                before = bisect_left(starts, b)
                if (not before or ends[before - 1] <= a) and plausible(KINDS[tag - 1], found):
                    out.append((KINDS[tag - 1], a, b))
        return out


def _made_up(rng: np.random.Generator) -> tuple[str, int]:
    """A made-up item and its tag."""
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    kind = int(rng.integers(0, 4))
    if kind == 0:
        at, dot = pick(("@", "."), ("@", "."), (" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."))
        name = word() + pick("", "." + word(), "_" + word(), number(2), "." + number(2))
        return f"{name}{at}{word()}{pick('', number(1))}{dot}{pick('com', 'org', 'net', 'example' + dot + 'com')}", 1
    if kind == 1:
        return pick(".", ".", ".", " . ", "[.]", "-").join(str(rng.integers(0, 256)) for _ in range(4)), 2
    if kind == 2:
        body = str(rng.integers(2, 7)) + number(int(pick(14, 14, 14, 17)))
        card = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        step = pick("", "", " ", "-", ".", "/")
        return step.join(card[i : i + 4] for i in range(0, len(card), 4)), 3
    a, b, c = number(3), number(3), number(4)
    return pick(f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"00{number(2)} {a} {b}{c}", f"+1.{a}.{b}.{c}"), 4


def _decoy(rng: np.random.Generator) -> str:
    """Digits and signs that are no personal data."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    choices = (f"{n(1)}.{n(1)}", f"Version {n(1)}.{n(1)}.", n(4), f"{n(2)}%", f"${n(3)}.{n(2)}", f"({n(2)})", f"{n(1)}-{n(1)}", "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, 40)), "@@", "&&&", "at", f"+{n(1)}", f"{n(4)}-{n(2)}-{n(2)}", f"{n(2)}:{n(2)}")
    return choices[int(rng.integers(len(choices)))]


def _example(rng: np.random.Generator, lines: list[str], width: int) -> tuple[str, np.ndarray]:
    line = lines[int(rng.integers(len(lines)))] if lines else ""
    begin = int(rng.integers(0, max(1, len(line) - width)))
    line = line[begin : begin + width]
    at = int(rng.integers(0, len(line) + 1))
    what = rng.random()
    item, tag = _made_up(rng) if what < 0.55 else (_decoy(rng), 0) if what < 0.85 else ("", 0)
    before, after = (" " if at else ""), (" " if rng.random() < 0.8 else "")
    text = line[:at] + before + item + after + line[at:]
    tags = np.zeros(len(text), np.int64)
    tags[at + len(before) : at + len(before) + len(item)] = tag
    shift = max(0, min(int(rng.integers(0, at + 1)), len(text) - width)) if len(text) > width else 0
    return text[shift : shift + width], tags[shift : shift + width]


def train(lines: list[str], seed: int = 5, batches: int = BATCHES, width: int = 72) -> PiiModel:
    rng = np.random.default_rng(seed)
    kinds = len(KINDS) + 1
    tagger = Tagger(Lstm, _SYMBOLS, kinds, SIZE)
    params = tagger.params
    params["trans"] = np.where(np.eye(kinds) > 0, 1.0, -1.0).astype(np.float32)
    adam = Adam(params, 0.03)
    across = np.arange(BATCH)
    for n in range(batches):
        adam.rate = 0.03 if n < batches * 2 // 3 else 0.01
        made = [_example(rng, lines, width) for _ in range(BATCH)]
        x = np.full((width, BATCH), _SYMBOLS, np.int16)
        tags = np.zeros((width, BATCH), np.int64)
        for b, (text, tag) in enumerate(made):
            x[: len(text), b], tags[: len(text), b] = _symbols(text), tag
        live = (x < _SYMBOLS).astype(np.float32)
        keep: dict = {}
        unary = tagger.scores(x, keep)
        _, marginal, pair = crf_log_z(unary.astype(np.float64), params["trans"].astype(np.float64), live)
        grad = marginal
        grad[np.arange(width)[:, None], across, tags] -= live
        count = np.zeros((kinds, kinds))
        np.add.at(count, (tags[:-1].ravel(), tags[1:].ravel()), live[1:].ravel())
        grads = tagger.gradients(x, keep, (grad / BATCH).astype(np.float32))
        grads["trans"] = ((pair - count) / BATCH).astype(np.float32)
        adam.step(grads)
    return PiiModel(tagger, params["trans"])


def training_lines(docs: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[str]:
    """Lines without base spans of at most `sample` documents, those with the smallest hash of doc_id.

    Of a longer text a window of `chars` characters is taken, at a place given by the hash, so the driver gets a bounded sample.
    """
    ids = docs.filter("text is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id", F.lit("window")))
    begin = F.pmod("h", F.greatest(F.lit(1), F.length("text") - chars + 1)).cast("int") + 1
    rows = rows.select("doc_id", F.substring("text", begin, F.lit(chars)).alias("text")).orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(sample).collect()
    lines = [x for r in rows for x in r[1].split("\n") if x.strip()]
    return [x for x in lines if not base_spans(x)]


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("n_added", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
_OUT_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string"


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find_pii(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base), n_added, base_sha256, spans.

    spans: kind:start:end in code points (end exclusive), base and added, by kind and start, joined by commas. Null
    texts count as empty and have no spans; repeated rows are judged alike. Base spans take time in proportion to a text's length, whatever runs
    it holds, and so do added ones. Other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model or trained("pii", training_lines(source), train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, texts = rows["doc_id"].to_pylist(), [t or "" for t in rows["text"].to_pylist()]
            for a, b in slices(texts, 1 << 19):
                part = texts[a:b]
                base = [base_spans(t) for t in part]
                added = [shared.value.spans(t, tags, s) for t, tags, s in zip(part, shared.value.tags(part), base)]
                yield batch(
                    _OUT,
                    doc_id=ids[a:b],
                    **{f"n_{k}": [sum(s[0] == k for s in found) for found in base] for k in KINDS},
                    n_added=[len(x) for x in added],
                    base_sha256=[hashlib.sha256(joined(x).encode()).hexdigest() for x in base],
                    spans=[joined(x + y) for x, y in zip(base, added)],
                )

    return source.mapInArrow(run, _OUT_DDL)
