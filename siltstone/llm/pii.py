"""Personal data: fixed patterns, and candidates judged by boosted trees.

High-recall generators propose spans, which may overlap, in looser forms than the fixed patterns know (an
address written with "at" and "dot", a phone number without its plus, a card number with other separators, IPv6).
Boosted trees judge each by its format and its context; their calibrated probability must reach a threshold
set for each kind. What passes is taken best first where it overlaps neither a fixed match nor a better one.

The trees are fitted in the driver on pieces of at most ``sample_rows`` documents (chosen by a hash of the text, so the same
ones each time): their words are the contexts, into which written forms of personal data and of harmless look-alikes
are put. The name before an "at" has at most 64 characters, as the mail standard says. All else covers every document and every text as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import quoted, small_batches, text_udf, whole_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, index of the kind, end

SAMPLE_ROWS = 4000
CONTEXT_CHARS = 160
MIN_PRECISION = 0.98

_LOOSE_AT = re.compile(r"(?i)[@＠]|(?<![a-z])at(?![a-z])")
_TRIGGER = re.compile(rf"{_LOOSE_AT.pattern}|[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern, found from each @, so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """The matches of the fixed patterns, each kind by itself, sorted by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


_AT_DOT = re.compile(r"(?i)([\w.+%-]{1,64}) ?[\[({<]? ?(?:at|@|＠) ?[\])}>]? ?((?:[\w-]{1,63} ?[\[({<]? ?(?:dot|\.) ?[\])}>]? ?){1,4})([a-z]{2,24})\b")
_NUMBERS = re.compile(r"(?<![\w.])[+(]?[0-9](?:[ ().\-/_]{0,3}[0-9]){8,24}(?![\w])")
_IP_LIKE = re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}|[0-9]{1,3}(?: ?[\[(]?(?:\.|dot)[\])]? ?[0-9]{1,3}){3})(?![\w:])")


def candidates(text: str) -> list[Span]:
    """Spans that might be personal data, generously; they may overlap."""
    out: list[Span] = []
    for at in _LOOSE_AT.finditer(text):
        low = max(0, at.start() - 3)  # _AT_DOT allows three characters before it
        begin = at.start()
        while begin > low and text[begin - 1] in " [({<":
            begin -= 1
        start = begin
        while start > max(0, begin - 64) and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        if start < begin and (e := _AT_DOT.match(text, start)):
            out.append((e.start(), 0, e.end()))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP_LIKE.finditer(text)]
        for m in _NUMBERS.finditer(text):
            n = sum("0" <= c <= "9" for c in m.group())
            if 13 <= n <= 19:
                out.append((m.start(), 2, m.end()))
            if 9 <= n <= 15:
                out.append((m.start(), 3, m.end()))
    return out


#: Words by which people announce a kind of personal data. Fixed values.
_CUES = (("mail", "contact", "write", "reach"), ("ip", "host", "server", "addr", "ping"), ("card", "visa", "credit", "kart", "tarj", "carte"), ("tel", "phone", "call", "fon", "mobile", "fax", "ruf"))
_PLAIN = frozenset("the a an of in to and or is it this that our my we der die das le la les el los las un une una".split())
_TOP_LEVEL = frozenset("com org net edu gov io de fr es uk eu info biz co us ca au ch at nl it pl ru jp cn br in me dev app".split())


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate, as numbers."""
    start, kind, end = span
    s, left, right = text[start:end], text[max(0, start - 24) : start].lower(), text[end : end + 24].lower()
    digits = _NOT_DIGIT.sub("", s)
    groups = re.findall("[0-9]+", s)
    words = re.findall(r"[a-z]+", s.lower())
    before, after = left[-1:], right[:1]
    sizes = [len(g) for g in groups] or [0]
    return [
        *(float(kind == k) for k in range(4)),
        len(s), len(digits), len(digits) / len(s), len(groups), min(sizes), max(sizes), sizes[0], sizes[-1],
        len(set(s) - set("0123456789")), s.count(" "), s.count("-"), s.count("."), s.count("/") + s.count("_"), s.count(":"), s.count("("),
        float(bool(digits) and luhn(digits)), float(digits[:1] == "0"), float(digits[:2] == "00"), len(set(digits)),
        float(bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float("@" in s or "＠" in s), float(" dot" in s.lower() or "dot " in s.lower() or "(dot" in s.lower() or "[dot" in s.lower()), float(bool(re.search(r"[\[({<]", s))),
        float(bool(words) and words[-1] in _TOP_LEVEL), len(words), max(map(len, words), default=0),
        float(before.isalnum()), float(after.isalnum()), float(before in "\"'=#$€£/" and before != ""), float(after in "\"'%/$€£" and after != ""),
        float(any(v in _PLAIN for v in words[1:])), float("=" in left[-6:]), float(any(c in left for c in _CUES[kind])),
    ]


def _forms(rng: np.random.Generator) -> Iterator[tuple[int, str, int]]:
    """Kind, a written form, and whether it is personal data (1) or a look-alike (0), without end."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    w = lambda: "".join(rng.choice(list("abcdeghilmnoprstu"), rng.integers(3, 9)))
    pick = lambda *x: x[rng.integers(len(x))]

    def card(valid: bool) -> str:
        body = pick("4", "51", "55", "37", "6011")
        body += n(int(pick(15, 15, 15, 12)) - len(body))
        check = next(d for d in "0123456789" if luhn(body + d))
        return body + (check if valid else str((int(check) + int(rng.integers(1, 10))) % 10))

    def cut(digits: str, sep: str) -> str:
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    while True:
        dot = pick(" dot ", " (dot) ", " [dot] ", "(dot)", "[dot]", " DOT ", ".")
        at = pick(" at ", " (at) ", " [at] ", "(at)", "[at]", " AT ", " @ ", "＠") if dot != "." else pick(" (at) ", "(at)", "[at]", " [at] ", " @ ", "＠")
        name = pick(w(), f"{w()}.{w()}", f"{w()}.{rng.integers(100)}", f"{w()}_{w()}")
        if dot == "." and not name.isalpha():  # one word, as in "buy at shop.com", is a look-alike
            at = pick(at, " at ")
        yield 0, f"{name}{at}{w()}{dot}{pick('com', 'org', 'net', 'de', 'fr', 'es', 'io')}", 1
        yield 0, pick(f"{w()} at {w()} dot {w()}", f"{w()} at the dot {w()}", f"{w()} at {pick('the', 'a', 'this', 'our', 'la', 'der')} dot {pick('com', 'org', 'net')}", f"{w()} @ {w()}. {w()}", f"look at {w()}.{w()}", f"{w()} at {w()}.{pick('com', 'org', 'net', 'de')}", f"{w()} at {w()}. {w()}", f"{w()} at {w()}. {pick('in', 'it', 'at', 'me', 'de', 'es', 'us')}"), 0
        three = lambda: pick("2", "3", "4", "5", "6", "7", "8", "9") + n(2)
        yield 3, pick(f"({three()}) {three()}-{n(4)}", f"{three()}-{three()}-{n(4)}", f"{three()}.{three()}.{n(4)}", f"1-{three()}-{three()}-{n(4)}", f"00{rng.integers(20, 99)} {n(3)} {n(7)}", f"0{n(2)} {n(4)} {n(4)}", f"0{n(3)} {n(7)}", f"0{n(3)}/{n(6)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}"), 1
        yield 3, pick(n(int(rng.integers(9, 16))), f"20{n(2)}-0{rng.integers(1, 10)}-1{n(1)} 1{n(1)}:{n(2)}", f"20{n(2)}.{n(2)}.{n(2)}.{n(4)}", f"{n(3)}.{n(3)}.{n(3)}.{n(3)}", f"{n(1)}.{n(9)}", f"{n(2)}/{n(2)}/{n(4)}/{n(3)}", card(False)[:15], f"{n(5)} {n(5)} {n(5)}", f"{n(3)}-{n(1)}-{n(2)}-{n(6)}-{n(1)}"), 0
        sep = pick(".", "/", "_", "  ", ". ")
        yield 2, cut(card(True), sep), 1
        yield 2, pick(cut(card(False), sep), card(False), n(int(rng.integers(13, 20))), cut(card(False), " "), cut(card(False), "-"), f"{n(2)}.{n(12)}"), 0
        a, b, c, d = rng.integers(0, 256, 4)
        yield 1, pick(f"{a}[.]{b}[.]{c}[.]{d}", f"{a}(.){b}(.){c}(.){d}", f"{a} dot {b} dot {c} dot {d}", f"{a}[dot]{b}[dot]{c}[dot]{d}", ":".join(f"{x:x}" for x in rng.integers(4096, 65536, 8)), f"2001:db8:{rng.integers(4096, 9999)}::{rng.integers(1, 9999)}"), 1
        yield 1, pick(f"{n(2)}:{n(2)}:{n(2)}", f"{rng.integers(256, 999)}[.]{n(3)}[.]{n(3)}[.]{n(3)}", f"{rng.integers(300, 999)}.{n(3)}.{n(3)}.{n(3)}", f"{n(1)}:{n(1)}:{n(1)}:{n(1)}", f"{a} . {b} . {c} . {d}"), 0


@dataclass
class Judge:
    trees: BoostedTrees
    thresholds: list[float]

    def added(self, text: str, fixed: list[Span]) -> list[Span]:
        """The candidates that pass, best first, without overlaps; fixed spans always stay."""
        found = [c for c in dict.fromkeys(candidates(text)) if not any(c[0] < f[2] and f[0] < c[2] for f in fixed)] if len(fixed) < 64 else _apart(candidates(text), fixed)
        if not found:
            return []
        p = self.trees.probability(np.array([features(text, c) for c in found]))
        ranked = sorted((-q, c) for q, c in zip(p, found, strict=True) if q >= self.thresholds[c[1]])
        return _greedy([c for _, c in ranked])


def _apart(found: list[Span], fixed: list[Span]) -> list[Span]:
    """Those of ``found`` that overlap no span of ``fixed``, by binary search over merged spans."""
    from bisect import bisect_right

    merged: list[list[int]] = []
    for a, _, b in sorted(fixed):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [m[0] for m in merged]

    def free(c: Span) -> bool:
        i = bisect_right(starts, c[2] - 1) - 1
        return i < 0 or merged[i][1] <= c[0]

    return [c for c in dict.fromkeys(found) if free(c)]


def _greedy(ranked: list[Span]) -> list[Span]:
    from bisect import bisect_left, insort

    kept: list[Span] = []
    for c in ranked:
        i = bisect_left(kept, c)
        if (i == 0 or kept[i - 1][2] <= c[0]) and (i == len(kept) or c[2] <= kept[i][0]):
            insort(kept, c)
    return kept


def fit_judge(contexts: list[str], examples: int = 4000, seed: int = 7, min_precision: float = MIN_PRECISION) -> Judge:
    """Trees, calibration and thresholds from forms put into the contexts. Two thirds fit the trees; the rest calibrates
    them and sets, for each kind, the least threshold of at least one half whose precision is ``min_precision``."""
    rng = np.random.default_rng(seed)
    contexts, forms = contexts or [""], _forms(rng)
    x, y, kinds = [], [], []
    for i in range(examples):
        kind, form, label = next(forms)
        assert not label or any(k == kind for _, k, _ in candidates(form)), f"no candidate for {form!r}"
        words = contexts[int(rng.integers(len(contexts)))]
        cut = int(rng.integers(len(words) + 1))
        cue = f"{rng.choice(_CUES[kind])}: " if rng.random() < 0.15 else ""
        left, right = words[:cut][-40:].rstrip(), words[cut:][:40].lstrip()
        text = f"{left} {cue}{form}{rng.choice(['.', ' ', ',', ' '])}{right}"
        at = len(left) + 1 + len(cue)
        for c in candidates(text):
            if c[0] < at + len(form) and at < c[2]:
                exact = c[0] >= at and c[2] <= at + len(form) + 1 and c[2] - c[0] >= len(form) - 2
                x.append(features(text, c)), y.append(float(bool(label) and c[1] == kind and exact)), kinds.append((c[1], i))
    x, y, own, fold = np.array(x), np.array(y), np.array([k for k, _ in kinds]), np.array([i for _, i in kinds]) % 3
    trees = BoostedTrees().fit(x[fold > 0], y[fold > 0]).calibrate(x[fold == 0], y[fold == 0])
    p, thresholds = trees.probability(x[fold == 0]), []
    for k in range(len(KINDS)):
        mine = own[fold == 0] == k
        pk, yk = p[mine], y[fold == 0][mine]
        options = [t for t in np.round(np.arange(0.5, 1.0, 0.02), 2) if yk[pk >= t].sum() and yk[pk >= t].mean() >= min_precision]
        thresholds.append(float(options[0]) if options else 0.99)
    return Judge(trees, thresholds)


def sample_contexts(docs: DataFrame, text_col: str, sample_rows: int, context_chars: int = CONTEXT_CHARS) -> list[str]:
    """Pieces of ``context_chars`` characters from anywhere in about ``sample_rows`` texts, both by hash: neighbours for the made-up examples;
    nothing else is learned from them."""
    n = docs.count()
    rate = max(1, -(-n // max(1, sample_rows)))
    rows = docs.select(whole_text(text_col).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(rate)) == 0)
    start = F.pmod(F.xxhash64(F.lit(3), "t"), F.greatest(F.length("t") - context_chars, F.lit(0)) + 1).cast("int") + 1
    rows = rows.select(F.substring("t", start, F.lit(context_chars)).alias("c")).where("length(c) > 0").distinct()
    return sorted(r.c for r in rows.orderBy(F.xxhash64("c"), "c").limit(sample_rows).collect())


def _spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, judge: Judge | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (matches of the fixed patterns), base_sha256, spans (all, by start, then kind, as
    kind:start:end in code points, joined by commas) and n_added.

    Cases: null and empty texts have no spans. Rows are independent, so repeated rows repeat and a null doc_id stays. Other
    columns are not read. An empty table gives an empty result. Texts are searched as a whole, in linear time.
    """
    judge = judge or fit_judge(sample_contexts(docs, text_col, sample_rows))

    def make():
        def one(text: str | None) -> dict:
            fixed = more = []
            if text and _TRIGGER.search(text):
                fixed = base_spans(text)
                more = judge.added(text, fixed)
            counts = [0, 0, 0, 0]
            for _, k, _ in fixed:
                counts[k] += 1
            return {"n_email": counts[0], "n_ip": counts[1], "n_card": counts[2], "n_phone": counts[3], "base_sha256": hashlib.sha256(_spelled(fixed).encode()).hexdigest(), "spans": _spelled(sorted([*fixed, *more])), "n_added": len(more)}

        return lambda texts: [one(t) for t in texts]

    small_batches(docs.sparkSession)
    run = text_udf(make, "struct<n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, base_sha256: string, spans: string, n_added: bigint>")
    return docs.select(F.col(id_col).alias("doc_id"), run(whole_text(text_col)).alias("r")).select("doc_id", "r.*")


def redact_text(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in angle brackets; of overlapping spans, one mark for all."""
    out, done = [], 0
    for a, k, b in sorted(spans):
        if a >= done:
            out += text[done:a], f"<{KINDS[k].upper()}>"
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, judge: Judge | None = None) -> DataFrame:
    """The rows with personal data in their text replaced by marks such as <EMAIL>; all other columns stay.

    Cases: null and empty texts stay as they are; so do texts without personal data. Rows are independent, so repeated rows
    repeat and null ids stay. Other columns may have any names. An empty table gives an empty result.
    """
    judge = judge or fit_judge(sample_contexts(docs, text_col, sample_rows))

    def make():
        def one(text: str | None) -> str | None:
            if not text or not _TRIGGER.search(text):
                return text
            fixed = base_spans(text)
            return redact_text(text, [*fixed, *judge.added(text, fixed)])

        return lambda texts: [one(t) for t in texts]

    small_batches(docs.sparkSession)
    clean = text_udf(make, "string")(F.col(quoted(text_col)))
    return docs.select(*[(clean if c == text_col else F.col(quoted(c))).alias(c) for c in docs.columns])
