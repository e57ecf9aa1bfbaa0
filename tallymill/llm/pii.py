r"""Personal data: rules, and boosted trees over overlapping candidates.

1. Rules find the base spans: e-mail and IP addresses, card and phone numbers, per kind leftmost and
   non-overlapping; a match that fails its check is dropped and not tried again.
2. Generators with high recall propose overlapping candidates: every ``x@y`` with its trimmed forms,
   and every run of number groups of at most ``DIGITS`` digits, the most that any kind has. So a card
   beside another number, which the greedy rule swallows and drops, is proposed as well.
3. Boosted trees score each candidate by its format (digits, groups, separators, checks) and its
   context (neighbouring characters, key words, other candidates). They are trained here: candidates
   equal to a base span are positive; others are negative, but for those inside a match that a rule
   dropped and that the rule would take if they stood alone, and those written in a form that no rule
   knows (a national phone number, an address with an accent, a card with dots), which are unknown and
   left out, or positive with a key word of their kind before them.
   What no rule sees can't be learnt from what rules find, so each text with base spans also teaches
   rewritten, ``REWRITTEN`` times: about half of its addresses, cards and phone numbers in such other
   forms, or beside a number that the rules swallow them with, positive, and the others as dates,
   amounts, numbers that fail the check and names without a domain, negative.
4. A cut-off per kind is calibrated for ``PRECISION`` on the quarter of all distinct documents that
   fitting does not see, as written and rewritten, at any size, from counts per kind and bin of the
   score. Candidates at or above it are added, best first, where they overlap neither a base span nor
   one already added.

The trees are fitted on a bounded sample, chosen by a hash: of the other documents with a digit or
``@`` about ``SAMPLE_DOCS``, and about ``SAMPLE_PER_KIND`` of those with a base span of a kind, so that
rare kinds teach too; of each at most ``SAMPLE_PER_DOC`` candidates. Everything else, the calibration
included, covers every whole text. A run of number groups ends at ``DIGITS`` digits, so a text that is one
long column of numbers costs time in proportion to its length.

Defined cases: a NULL or empty text has no spans; rows repeated are treated alike; without training
data only base spans remain; no other column is read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import boosting
from tallymill.llm.common import SLICE_ROWS, working
from tallymill.session import write_once

KINDS = ("email", "ip", "card", "phone")
#: The longest card number; it bounds the groups of a run too, as each has a digit.
DIGITS = 19
PRECISION = 0.995
SAMPLE_DOCS = 6000
SAMPLE_PER_KIND = 1500
SAMPLE_PER_DOC = 64
#: Rewritten versions of each text that has base spans.
REWRITTEN = 4
#: Bins of the score per unit of its logit, and candidates described at a time, in calibration.
SCORE_BINS = 64
STEP = 4096

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
# the look-behind keeps the leftmost start only: a later start in one run of digits fails alike
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_GROUP = re.compile(r"\(?\+?[0-9]+\)?")
_LEFT = re.compile(r"[^\s@,;:<>()\[\]\"']+$")
_RIGHT = re.compile(r"[^\s@,;:<>()\[\]\"']{1,255}")
_EDGE = ".!?*#$%&|-_"
#: Forms that the rules don't take: see ``_other_form``.
_OTHER_EMAIL = re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+")
_OTHER_CARD = re.compile(r"[0-9]{4}([./]|\x20\x20)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}")
_OTHER_PHONE = re.compile(r"\(?0?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}")
_NAMES = {"email": ("mail",), "ip": (), "card": ("card", "visa"), "phone": ("tel", "phone", "call", "fax", "mobile")}
_WORDS = ("mail", "tel", "phone", "call", "fax", "card", "visa", "ip", "host", "server", "contact", "token", "version", "license")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # where the last match ended
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """The rules' spans by kind and start, and the matches that failed their check."""
    spans, dropped = [], []
    if "@" in text:
        spans += [Span("email", *x) for x in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [x.lstrip("0") or "0" for x in m.group().split(".")]
            if all(len(x) <= 3 and int(x) <= 255 for x in parts):
                spans.append(Span("ip", *m.span()))
            else:
                dropped.append(m.span())
        for m in _CARD.finditer(text):
            digits = _digits(m.group()) if m.end() - m.start() < 40 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(Span("card", *m.span()))
            elif m.end() - m.start() >= 13:
                dropped.append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    spans.append(Span("phone", *m.span()))
                else:
                    dropped.append(m.span())
    return spans, dropped


def candidates(text: str) -> list[Span]:
    """Overlapping proposals, each once."""
    found: dict[Span, None] = {}
    at = text.find("@")
    while at >= 0:
        # the parts of an address are at most 64 and 255 long
        left, right = _LEFT.search(text[max(0, at - 64) : at]), _RIGHT.match(text, at + 1)
        if left and right:
            start, end = at - len(left.group()), right.end()
            found[Span("email", start, end)] = None
            found[Span("email", at - len(left.group().lstrip(_EDGE)), at + 1 + len(right.group().rstrip(_EDGE)))] = None
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        groups = [(*m.span(), sum(map(str.isdigit, m.group()))) for m in _GROUP.finditer(text)]
        for i, (start, end, digits) in enumerate(groups):
            for j in range(i, len(groups)):
                if j > i:
                    gap = text[end : groups[j][0]]
                    if len(gap) > 3 or gap.strip(" ().+/-"):
                        break
                    end = groups[j][1]
                    digits += groups[j][2]
                if digits > DIGITS:
                    break
                part = text[start:end]
                a = start + (part[0] == "(" and ")" not in part)
                b = end - (part[-1] == ")" and "(" not in part)
                if j == i + 3 and part.count(".") == 3:
                    found[Span("ip", a, b)] = None
                if 12 <= digits <= 19:
                    found[Span("card", a, b)] = None
                if 7 <= digits <= 15:
                    found[Span("phone", a, b)] = None
    return list(found)


def _sort_of(c: str) -> int:
    if not c:
        return 0
    if c.isspace():
        return 1
    if c.isdigit():
        return 2
    if c.isalpha():
        return 3
    return 4 + ".,;:!?-+()@|#*$%&".find(c) if c in ".,;:!?-+()@|#*$%&" else 22


def describe(text: str, span: Span) -> list[int]:
    """Format and context of a candidate as integers below the number of bins."""
    kind, start, end = span
    part = text[start:end]
    digits = _digits(part)
    groups = _GROUP.findall(part)
    before, after = text[max(0, start - 24) : start], text[end : end + 24]
    near = (before + " " + after).lower()
    dotted = part.split(".")
    return [min(x, boosting.BINS - 1) for x in (
        KINDS.index(kind),
        len(digits),
        len(groups),
        max((len(g.strip("()+")) for g in groups), default=0),
        min((len(g.strip("()+")) for g in groups), default=0),
        part.count(" "),
        part.count("-"),
        part.count("."),
        part.count("("),
        part.count("/"),
        _sort_of(part[0]),
        _sort_of(part[-1]),
        int(part[0] == "+"),
        part.count("+"),
        int(bool(digits) and luhn(digits)),
        int(len(dotted) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in dotted)),
        len(dotted[-1]) if kind == "email" else 0,
        int(kind == "email" and part.isascii()),
        int(kind == "email" and "." in part.partition("@")[2]),
        _sort_of(text[start - 1 : start]),
        _sort_of(text[end : end + 1]),
        _sort_of(before.rstrip()[-1:]),
        _sort_of(after.lstrip()[:1]),
        int(bool(re.search(r"\+[0-9 ().-]*$", before))),
        sum(1 << i % 4 for i, w in enumerate(_WORDS) if w in near),
        int(text[max(0, start - 2) : start].strip()[-1:].isdigit()),
        int(text[end : end + 2].strip()[:1].isdigit()),
    )]


class _Cover:
    """Non-overlapping intervals, merged, for overlap tests."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def all_spans(text: str, model: boosting.Trees | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans together, both by kind and start."""
    base, _ = base_spans(text)
    if model is None or not model.threshold:
        return base, base
    cover = _Cover([(s.start, s.end) for s in base])
    left = [c for c in candidates(text) if not cover.meets(c.start, c.end)]
    if not left:
        return base, base
    scores = model.scores(np.array([describe(text, c) for c in left]))
    added = []
    for i in sorted(range(len(left)), key=lambda i: (-scores[i], left[i].start - left[i].end, left[i])):
        c = left[i]
        if scores[i] >= model.threshold[c.kind] and not cover.meets(c.start, c.end):
            cover.add(c.start, c.end)
            added.append(c)
    return base, sorted(base + added, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each span, or group of overlapping spans, becomes [KIND] of its first one."""
    out, free = [], 0
    region: list | None = None
    for kind, a, b in sorted(spans, key=lambda s: (s.start, -s.end)):
        if region and a < region[1]:
            region[1] = max(region[1], b)
            continue
        if region:
            free = region[1]
        out.append(text[free:a] + f"[{kind.upper()}]")
        region = [a, b]
    return "".join(out) + text[region[1] if region else 0 :]


def _alone(text: str, span: Span) -> bool:
    return Span(span.kind, 0, span.end - span.start) in base_spans(text[span.start : span.end])[0]


def _other_form(text: str, span: Span) -> bool:
    """Whether a candidate is written as no rule takes it, though people write such data so."""
    kind, start, end = span
    part = text[start:end]
    if text[max(0, start - 2) : start].strip()[-1:].isdigit() or text[end : end + 2].strip()[:1].isdigit():
        return False
    if kind == "email":
        return bool(_OTHER_EMAIL.fullmatch(part)) and not part.isascii()
    if kind == "card":
        return bool(_OTHER_CARD.fullmatch(part)) and luhn(_digits(part))
    return kind == "phone" and bool(_OTHER_PHONE.fullmatch(part)) and 9 <= len(_digits(part)) <= 11


def _named(text: str, span: Span) -> bool:
    """Whether a key word of the kind stands before a candidate."""
    return any(w in text[max(0, span.start - 12) : span.start].lower() for w in _NAMES[span.kind])


def _labelled(text: str) -> tuple[list[Span], list[int]]:
    """The candidates with a known label, and the labels."""
    base, dropped = base_spans(text)
    known, unknown, taken = set(base), _Cover(dropped), _Cover([(s.start, s.end) for s in base])
    rows, labels = [], []
    for c in candidates(text):
        label = int(c in known)
        if not label and not taken.meets(c.start, c.end):
            if _other_form(text, c):
                if not _named(text, c):
                    continue
                label = 1
            elif unknown.meets(c.start, c.end) and _alone(text, c):
                continue
        rows.append(c)
        labels.append(label)
    return rows, labels


def _address(part: str, rng: np.random.Generator) -> tuple[str, str]:
    """Name and host of an address, as they are or shortened, so that the trees don't hold one habit of naming for the rule."""
    name, _, host = part.partition("@")
    if rng.random() < 0.5:
        name = name.replace(".", "")[: int(rng.integers(3, 12))] or "a"
    if rng.random() < 0.5:
        name = name.rstrip("0123456789._%+-") or "a"
    if rng.random() < 0.5:
        first, _, rest = host.partition(".")
        host = f"{first.rstrip('0123456789') or 'a'}.{(rest, rest.rpartition('.')[2])[rng.integers(2)]}"
    if rng.random() < 0.5:
        host = host.rpartition(".")[0] + "." + ("fr", "de", "com", "info", "org")[rng.integers(5)]
    return name, host


def _in_other_form(kind: str, part: str, rng: np.random.Generator) -> str:
    """The same datum as it is also written, but not for the rules."""
    if kind == "email":
        name, host = _address(part, rng)
        accent = "éèáóöüñ"[rng.integers(7)]
        where = rng.integers(3)
        if where != 1:
            name = name[:-1] + accent
        if where != 0:
            label, dot, rest = host.partition(".")
            at = int(rng.integers(len(label)))
            host = label[:at] + accent + label[at + 1 :] + dot + rest
        return f"{name}@{host}"
    digits = _digits(part)
    if kind == "card":
        return (".", "/", "  ")[rng.integers(3)].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    groups = [_digits(g) for g in _GROUP.findall(part)][1:]
    if len(groups) < 2 or not 9 <= sum(map(len, groups)) <= 11 or max(map(len, groups)) > 4:
        digits = digits[-10:].rjust(10, "2")
        groups = [digits[:3], digits[3:6], digits[6:]]
    first, rest = groups[0], groups[1:]
    return (f"({first}) {'-'.join(rest)}", f"({first}) {' '.join(rest)}", "-".join(groups), ".".join(groups), " ".join(groups))[rng.integers(5)]


def _beside_another(kind: str, part: str, rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A number as the rules take it, before or after another that they swallow it with, and where both are."""
    if rng.random() < 0.5:
        other = "ip", ".".join(map(str, rng.integers(1, 256, 4)))
    else:
        digits = "".join(map(str, rng.integers(0, 10, 15)))
        other = "card", digits + next(c for c in "0123456789" if luhn(digits + c))
    pair = [(kind, part), other]
    (k1, first), (k2, second) = pair if rng.random() < 0.5 else pair[::-1]
    return f"{first} {second}", [Span(k1, 0, len(first)), Span(k2, len(first) + 1, len(first) + 1 + len(second))]


def _look_alike(kind: str, part: str, rng: np.random.Generator) -> str:
    """What resembles a datum of this kind and is none."""
    if kind == "email":
        name, host = _address(part, rng)
        host = host.partition(".")[0]
        return (f"{name}@{host}", f"{name[0]}@{len(host)}", f"{name}@{host}:{len(name)}", f"{name[:-1]}é@{host}")[rng.integers(4)]
    digits = _digits(part)
    if kind == "card":
        digits = digits[:-1] + str((int(digits[-1]) + int(rng.integers(1, 10))) % 10)
        return ("", " ", "-", ".", "/")[rng.integers(5)].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    a, b, c = rng.integers(1, 29, 3).tolist()
    year = int(rng.integers(1900, 2100))
    amount = f"{int(rng.integers(10**6, 10**10)):,}"
    return (
        f"{year}-{b % 12 + 1:02}-{c:02}",
        f"{c:02}.{b % 12 + 1:02}.{year}",
        f"{c:02}/{b % 12 + 1:02}/{year}",
        f"{year}-{year + a}",
        amount.replace(",", " "),
        amount.replace(",", "."),
        digits[-int(rng.integers(7, 11)) :],
        f"978-{a % 10}-{b:02}-{int(rng.integers(10**6)):06}-{c % 10}",
        f"{a}.{b}.{c}.{int(rng.integers(1000, 10**5))}",
        f"{year}-{b % 12 + 1:02}-{c:02} {a % 24:02}.{b:02}",
    )[rng.integers(10)]


def _rewritten(text: str, seed: int) -> tuple[str, list[Span], list[int]]:
    """The text with its spans written otherwise; of the candidates that meet these, and no base span, the labels."""
    rng = np.random.default_rng(seed)
    out, size, free = [], 0, 0
    right, touched = set(), []
    for kind, start, end in sorted(base_spans(text)[0], key=lambda s: (s.start, -s.end)):
        if kind == "ip" or start < free:
            continue
        keep = rng.random() < 0.5
        at = size + start - free
        if not keep:
            new = _look_alike(kind, text[start:end], rng)
        elif kind != "email" and rng.random() < 0.5:
            new, spans = _beside_another(kind, text[start:end], rng)
            right.update(Span(k, at + a, at + b) for k, a, b in spans)
        else:
            new = _in_other_form(kind, text[start:end], rng)
            right.add(Span(kind, at, at + len(new)))
        out += [text[free:start], new]
        size, free = at + len(new), end
        touched.append((at, size))
    if not touched:
        return text, [], []
    changed = "".join(out) + text[free:]
    taken, here = _Cover([(s.start, s.end) for s in base_spans(changed)[0]]), _Cover(touched)
    rows = [c for c in candidates(changed) if here.meets(c.start, c.end) and not taken.meets(c.start, c.end)]
    return changed, rows, [int(c in right) for c in rows]


def _versions(text: str, seed: int) -> Iterator[tuple[str, list[Span], list[int]]]:
    """A text as it is and rewritten, its candidates and their labels."""
    yield text, *_labelled(text)
    for i in range(REWRITTEN):
        yield _rewritten(text, REWRITTEN * seed + i)


def _training_rows(text: str, seed: int) -> tuple[list[list[int]], list[int]]:
    x, y = [], []
    for version, rows, labels in _versions(text, seed):
        chosen = range(len(rows))
        if len(rows) > SAMPLE_PER_DOC:
            chosen = sorted(np.random.default_rng(seed).choice(len(rows), SAMPLE_PER_DOC, replace=False))
        x += [describe(version, rows[i]) for i in chosen]
        y += [labels[i] for i in chosen]
    return x, y


def _score_counts(text: str, seed: int, model: boosting.Trees) -> np.ndarray:
    """Rows of kind, bin, negatives, positives of a text's candidates with a score of 0.5 or more."""
    found: dict[tuple[int, int], list[int]] = {}
    for version, rows, labels in _versions(text, seed):
        for at in range(0, len(rows), STEP):
            x = np.array([describe(version, c) for c in rows[at : at + STEP]])
            bins = np.floor(np.clip(model.logits(x), -30, 30) * SCORE_BINS).astype(np.int64)
            for kind, score, y in zip(x[:, 0].tolist(), bins.tolist(), labels[at : at + STEP], strict=True):
                if score >= 0:
                    found.setdefault((kind, score), [0, 0])[y] += 1
    return np.array([[*k, *n] for k, n in found.items()], np.int64).reshape(-1, 4)


def _kinds_per_text(rows: DataFrame) -> DataFrame:
    """h and kinds, a bit per kind that the text has a base span of; one row per distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("pii")
        for batch in batches:
            kinds = [sum({1 << KINDS.index(s.kind) for s in base_spans(t)[0]}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(kinds, pa.int64())], ["h", "kinds"])

    return write_once(rows.mapInArrow(run, "h bigint, kinds bigint").groupBy("h").agg(F.min("kinds").alias("kinds")), "pii-kinds")


def train(df: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_per_kind: int = SAMPLE_PER_KIND) -> boosting.Trees | None:
    """Fit the trees and calibrate a cut-off per kind; None if there is nothing to learn from."""
    text = F.col(f"`{text_col}`").cast("string")
    every = df.select(text.alias("text"), F.xxhash64(text).alias("h")).where(F.col("text").rlike("[0-9@]"))
    held = F.pmod("h", F.lit(4)) == 0
    # copies of one text teach nothing new, and a large group of them would break the bound
    known = _kinds_per_text(every.where(~held))
    has = [F.col("kinds").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(KINDS))]
    total, *of_kind = known.agg(F.count("*"), *[F.count_if(x) for x in has]).first()

    def chosen(wanted: int, there: int):
        # the lowest of all 2**64 hashes, however many texts there are
        return F.lit(True) if there <= wanted else F.col("h") < -(1 << 63) + (wanted << 64) // there

    take = chosen(sample_docs, total)
    for x, there in zip(has, of_kind, strict=True):
        take = take | (x & chosen(sample_per_kind, there))
    rows = every.where(~held).join(F.broadcast(known.where(take).select("h")), "h", "left_semi").select("text", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("pii")
        for batch in batches:
            hs, xs, ys = [], [], []
            for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = _training_rows(t, h & 0xFFFFFFFF)
                if x:
                    hs.append(h)
                    xs.append(np.array(x, np.uint8).tobytes())
                    ys.append(bytes(y))
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["h", "x", "y"])

    found = rows.mapInArrow(run, "h bigint, x binary, y binary").groupBy("h").agg(F.min("x").alias("x"), F.min("y").alias("y")).collect()
    if not found:
        return None
    found.sort(key=lambda r: r["h"])
    y = np.concatenate([np.frombuffer(r["y"], np.uint8) for r in found]).astype(np.int64)
    x = np.concatenate([np.frombuffer(r["x"], np.uint8) for r in found]).reshape(len(y), -1).astype(np.int64)
    model = boosting.fit(x, y)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("pii")
        for batch in batches:
            for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = _score_counts(t, h & 0xFFFFFFFF, model)
                if len(counts):
                    columns = [pa.array(np.full(len(counts), h)), *[pa.array(c) for c in counts.T]]
                    yield pa.RecordBatch.from_arrays(columns, ["h", "kind", "bin", "n", "p"])

    counts = every.where(held).mapInArrow(score, "h bigint, kind bigint, bin bigint, n bigint, p bigint").dropDuplicates(["h", "kind", "bin"])
    bins = counts.groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()
    for i, kind in enumerate(KINDS):
        of_this = [(r["bin"], r["n"], r["p"]) for r in bins if r["kind"] == i]
        model.threshold[kind] = boosting.calibrate_bins(of_this, PRECISION, SCORE_BINS)
    return model


def find(df: DataFrame, model: boosting.Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans (kind:start:end, comma-joined)."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("pii")
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                found = [all_spans(t or "", model) for t in part.column(1).to_pylist()]
                counts = [pa.array([sum(s.kind == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(s) for _, s in found], pa.string())], names
                )

    return rows.mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string")


def redacted(df: DataFrame, model: boosting.Trees | None, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` with all spans replaced in its text, and ``length_col``, if given, set to the new length in code points."""
    names = df.columns
    at = names.index(text_col)
    length = names.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("pii")
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = [t if t is None else redact(t, all_spans(t, model)[1]) for t in part.column(at).to_pylist()]
                arrays = list(part.columns)
                arrays[at] = pa.array(texts, part.schema.field(at).type)
                if length is not None:
                    arrays[length] = pa.array([None if t is None else len(t) for t in texts], part.schema.field(length).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return df.mapInArrow(run, df.schema)
