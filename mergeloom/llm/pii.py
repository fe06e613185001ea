"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns find mail addresses, IP addresses, card numbers and phone numbers in their plain
forms; these spans always stay. The random field finds other spellings: `name (at) host (dot) com`,
numbers without a plus sign, with other separators or spaces, `1[.]2[.]3[.]4`. It works on
tokens around digits and at signs. Its candidates are segments of at most MAX_TOKENS tokens, which
are scored whole: by their shape, number and grouping of digits, checksum, ranges of parts,
separators, what stands beside them, and whether another entity ends where they begin. Viterbi's algorithm
over segments chooses boundaries and types together; segments that touch a pattern's span are out.

It is trained here, by maximum likelihood (forward and backward sums over the same segments), on
at most TRAIN_SPANS spans a kind that the patterns find in the documents, those with the smallest
hashes of their surroundings: each as it stands, in other spellings, and spoiled (a wrong checksum, a part
above 255, too few digits, no top-level domain), which must not be found. Every
task offers its own smallest ones, so what is gathered is bounded; all texts are searched whole, by both methods.

Cases: a null text is an empty one; offsets count code points, ends are exclusive; a document without a span has
empty lists; rows that repeat a doc_id have a row each, and a null doc_id stays null; further
columns are ignored; with no span in all documents there is nothing to learn from, and only the
patterns are used; an empty table gives no rows. A very long text takes time and memory in
proportion: patterns are tried from their rare characters, not from every letter.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize, text_chunks, whole_text

KINDS = ("email", "ip", "card", "phone")
TRAIN_SPANS = 150
MAX_TOKENS = 24
AROUND = 64
EPOCHS = 10
L2 = 2e-4

# The patterns that a span of each kind has in its plain form.
EMAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all spans that the patterns find, by start and kind."""
    out = []
    if "@" in text:
        last = 0
        for m in EMAIL_REST.finditer(text):
            before = text.rfind("@", last, m.start()) + 1
            at = max(last, before)
            start = at + len(text[at : m.start()].rstrip(EMAIL_LOCAL))
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        if all(small(p) for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0]))


TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|\w")
TRIGGER = re.compile(r"[0-9]+|@|[\[({]at[\])}]|(?<!\w)at(?= [A-Za-z0-9-]+ dot(?!\w))", re.I)
JOINTS = frozenset("+()-./[],_")


def regions(text: str) -> list[tuple[int, int]]:
    """Where tokens are looked at: AROUND characters on both sides of digits and at signs."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _numeric(text: str, tokens: list[tuple[int, int]]):
    """(first token, end token, kind): runs of digits and joints that can be a number of a kind."""
    is_digit = ["0" <= text[a] <= "9" for a, _ in tokens]
    n = len(tokens)
    for i in range(n):
        a = tokens[i][0]
        if not (is_digit[i] or (text[a] in "+(" and i + 1 < n and tokens[i + 1][0] == tokens[i][1] and (is_digit[i + 1] or text[tokens[i + 1][0]] == "("))):
            continue
        digits, groups = 0, 0
        for j in range(i, min(n, i + MAX_TOKENS)):
            s, e = tokens[j]
            if j > i and (s - tokens[j - 1][1] > 2 or "\n" in text[tokens[j - 1][1] : s]):
                break
            if not is_digit[j]:
                if text[s] not in JOINTS:
                    break
                continue
            digits, groups = digits + e - s, groups + 1
            if digits > 19:
                break
            if groups == 4 and is_digit[i] and digits <= 12:
                yield i, j + 1, 1
            if 12 <= digits:
                yield i, j + 1, 2
            if 7 <= digits <= 15:
                yield i, j + 1, 3


def _link(text: str, tokens: list[tuple[int, int]], t: int, word: str, sign: str) -> tuple[int, int] | None:
    """(first, end) of the tokens that stand for a sign at t: the sign, or its word in brackets or between spaces."""
    n = len(tokens)
    is_ = lambda k, w: k < n and text[tokens[k][0] : tokens[k][1]].lower() == w
    if is_(t, sign):
        return t, t + 1
    if t < n and text[tokens[t][0]] in "([{" and is_(t + 1, word) and t + 2 < n and text[tokens[t + 2][0]] in ")]}":
        return t, t + 3
    if sign == "." and t + 2 < n and text[tokens[t][0]] in "([{" and is_(t + 1, ".") and text[tokens[t + 2][0]] in ")]}":
        return t, t + 3
    if is_(t, word) and t and tokens[t - 1][1] < tokens[t][0] and t + 1 < n and tokens[t][1] < tokens[t + 1][0]:
        return t, t + 1
    return None


def _mails(text: str, tokens: list[tuple[int, int]]):
    n = len(tokens)
    part = lambda k: text[tokens[k][0]].isalnum()
    gap = lambda k: tokens[k + 1][0] - tokens[k][1]
    for t in range(1, n - 1):
        at = _link(text, tokens, t, "at", "@")
        if at is None or gap(t - 1) > 1 or at[1] >= n or gap(at[1] - 1) > 1:
            continue
        starts, k = [], t - 1
        while k >= 0 and t - k < 10 and (part(k) or text[tokens[k][0]] in "._%+-"):
            if part(k):
                starts.append(k)
            if k == 0 or gap(k - 1):
                break
            k -= 1
        k, dots, ends = at[1], 0, []
        while starts and k < n and k - t < MAX_TOKENS - 10:
            if not (part(k) or text[tokens[k][0]] == "-"):
                break
            while k + 1 < n and gap(k) == 0 and (part(k + 1) or text[tokens[k + 1][0]] == "-"):
                k += 1
            if dots:
                ends.append(k + 1)
            dot = _link(text, tokens, k + 1, "dot", ".")
            if dot is None or gap(k) > 1 or dot[1] >= n or gap(dot[1] - 1) > 1:
                break
            k, dots = dot[1], dots + 1
        for i in starts:
            for j in ends:
                yield i, j, 0


def _beside(c: str) -> str:
    return "none" if not c else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else "joint" if c in "+()-./_@" else "end" if c in ",;:!?\"'" else "sign"


def features(text: str, a: int, b: int, kind: int) -> list[str]:
    """What the segment text[a:b] is like as a whole."""
    s = text[a:b]
    found = ["any", f"left {_beside(text[a - 1 : a])}", f"right {_beside(text[b : b + 1])}"]
    word = re.search(r"([^\W\d_]+)\W*$", text[max(0, a - 24) : a])
    if word:
        found.append(f"word {word[1].lower()}")
    if kind == 0:
        low = s.lower()
        link = "@" if "@" in s else "bracket" if re.search(r"[\[({]at", low) else "word"
        dot = "bracket" if re.search(r"[\[({](?:dot|\.)", low) else "word" if re.search(r"\sdot\s", low) else "spaced" if re.search(r"\s\.|\.\s", s) else "plain"
        last = re.search(r"[^\W_]+$", s)
        top = last[0] if last else ""
        found += [f"at {link}", f"dot {dot}", f"at {link} dot {dot}", f"top {'letters' if top.isalpha() else 'other'} {min(len(top), 7)}", f"spaces {min(sum(c.isspace() for c in s), 5)}", f"capitals {s != low}"]
        found.append(f"whole left {text[a - 1 : a] in ('', ' ', chr(10), chr(9), '(', '<', ':', chr(34))}")
    else:
        digits = digits_of(s)
        groups = re.findall(r"[0-9]+", s)
        joints = re.sub(r"[0-9]+", "d", s)
        shape = re.sub(r"[0-9]", "d", s)
        found += [f"digits {len(digits)}", f"groups {min(len(groups), 7)}", f"joints {joints}" if len(joints) < 24 else "joints long", f"plus {s[0] == '+'}"]
        found.append(f"shape {shape}" if kind != 1 else f"small {all(small(g) for g in groups)}")
        found.append(f"brackets {s.count('(') == s.count(')') and s.count('[') == s.count(']')}")
        found.append(f"one joint {len(set(re.findall(r'[^0-9]+', s))) <= 1}")
        more = re.match(r"[\s().+-]{0,2}[0-9]", text[b : b + 3]) or re.search(r"[0-9][\s().+-]{0,2}$", text[max(0, a - 3) : a])
        found.append(f"alone {more is None}")
        if kind == 2:
            found.append(f"luhn {luhn(digits)} {14 <= len(digits) <= 19}")
            found.append(f"even groups {len({len(g) for g in groups}) == 1}")
        if kind == 3:
            found.append(f"last groups {'-'.join(str(len(g)) for g in groups[-3:])}")
    return [f"{KINDS[kind]} {x}" for x in found]


def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What spans, sorted by start, cover, as intervals apart from each other."""
    out: list[tuple[int, int]] = []
    for _, a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def touches(fixed: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the intervals overlaps a to b."""
    at = bisect.bisect_left(fixed, (b,))
    return at > 0 and fixed[at - 1][1] > a


def lattice(text: str, region: tuple[int, int], fixed: list[tuple[int, int]]):
    """(tokens, candidates (first, end, kind, features)) of a region; no candidate touches a fixed interval."""
    lo, hi = region
    tokens = [m.span() for m in TOKEN.finditer(text, lo, hi)]
    found = []
    for i, j, kind in (*_numeric(text, tokens), *_mails(text, tokens)):
        a, b = tokens[i][0], tokens[j - 1][1]
        if not touches(fixed, a, b):
            found.append((i, j, kind, features(text, a, b, kind)))
    return tokens, found


ADJACENT = "next to another"


def _scores(found, weights: dict[str, float]) -> list[float]:
    return [sum(weights.get(f, 0.0) for f in x[3]) for x in found]


def decode(n: int, found, weights: dict[str, float]) -> list[int]:
    """The candidates of the best segmentation, as numbers."""
    ends: dict[int, list[int]] = {}
    for c, x in enumerate(found):
        ends.setdefault(x[1], []).append(c)
    score = _scores(found, weights)
    near = weights.get(ADJACENT, 0.0)
    best = [(0.0, -math.inf)]  # of the tokens up to here: without and with a segment that ends here
    back: list[tuple] = [(None, None)]
    for p in range(1, n + 1):
        free = max(best[p - 1])
        closed, by = -math.inf, None
        for c in ends.get(p, ()):
            i = found[c][0]
            for state in (0, 1):
                s = best[i][state] + score[c] + near * state
                if s > closed:
                    closed, by = s, (c, state)
        best.append((free, closed))
        back.append((0 if best[p - 1][0] >= best[p - 1][1] else 1, by))
    p, state, out = n, 0 if best[n][0] >= best[n][1] else 1, []
    while p > 0:
        if state:
            c, state = back[p][1]
            out.append(c)
            p = found[c][0]
        else:
            state = back[p][0]
            p -= 1
    return out[::-1]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def expected(n: int, found, weights: dict[str, float]) -> tuple[list[float], float]:
    """(probability of every candidate, expected number of adjacent pairs), by forward and backward sums over segmentations."""
    score = _scores(found, weights)
    near = weights.get(ADJACENT, 0.0)
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for c, x in enumerate(found):
        ends.setdefault(x[1], []).append(c)
        starts.setdefault(x[0], []).append(c)
    ahead = [(0.0, -math.inf)]
    for p in range(1, n + 1):
        closed = -math.inf
        for c in ends.get(p, ()):
            x, y = ahead[found[c][0]]
            closed = _add(closed, score[c] + _add(x, y + near))
        ahead.append((_add(*ahead[p - 1]), closed))
    behind = [(0.0, 0.0)] * (n + 1)
    for p in range(n - 1, -1, -1):
        plain = behind[p + 1][0]
        x = y = plain
        for c in starts.get(p, ()):
            s = score[c] + behind[found[c][1]][1]
            x, y = _add(x, s), _add(y, s + near)
        behind[p] = (x, y)
    total = behind[0][0]
    shares, adjacent = [], 0.0
    for c, (i, j, _, _) in enumerate(found):
        rest = score[c] + behind[j][1] - total
        one, two = math.exp(ahead[i][0] + rest), math.exp(ahead[i][1] + near + rest)
        shares.append(one + two)
        adjacent += two
    return shares, adjacent


def _spellings(kind: int, s: str) -> list[tuple[str, bool]]:
    """(text, whether it still is a span of the kind): a span in other spellings, and spoiled."""
    d = digits_of(s)
    if kind == 0:
        name, host = s.split("@")
        parts = host.split(".")
        good = [f"{name} (at) {host}", f"{name} [at] {' [dot] '.join(parts)}", f"{name} at {' dot '.join(parts)}", f"{name}(at){'(dot)'.join(parts)}", f"{name} @ {host}", f"{name}@{' . '.join(parts)}", f"{name}@{'[.]'.join(parts)}", f"{name} (at) {' (dot) '.join(parts)}"]
        word = "".join(c for c in name if c.isalpha()) or "we"
        prose = [f"{word} at {parts[0]}. {parts[-1].title()} {word}", f"{word} at the {parts[-1]}. {word.title()}", f"{word} at {word}. {word}", f"{word} at {word}, dot {parts[-1]}"]
        return [(x, True) for x in good] + [(x, False) for x in (*prose, f"{name}@{parts[0]}", f"@{name}", f"{name} at {parts[0]}", f"{name}. {parts[0]} . {parts[-1]}")]
    if kind == 1:
        p = s.split(".")
        wrong = [*p[:3], str(256 + int(p[3]) % 700)]
        return [(x, True) for x in ("[.]".join(p), "(.)".join(p), " . ".join(p), ". ".join(p))] + [(x, False) for x in ("[.]".join(wrong), ".".join(wrong), ".".join(p[:3]), " ".join(p), "-".join(p), "/".join(p[:3]))]
    if kind == 2:
        fours = [d[i : i + 4] for i in range(0, len(d), 4)]
        odd = d[:-1] + str((int(d[-1]) + 3) % 10)
        odd_fours = [odd[i : i + 4] for i in range(0, len(odd), 4)]
        return [(x.join(fours), True) for x in (".", "/", "_", "  ", " - ")] + [(x, False) for x in (odd, *(y.join(odd_fours) for y in (" ", "-", ".", "/", "_", "  ")), d[:12])]
    local = d[-10:]
    area, mid, last = local[:3], local[3:6], local[6:]
    code = d[:-10] or "1"
    good = [f"({area}) {mid}-{last}", f"({area}) {mid} {last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"{code}-{area}-{mid}-{last}", f"{code} ({area}) {mid}-{last}", f"({area}){mid}-{last}", f"00{code} {area} {mid} {last}", f"+{code}/{area}/{mid}{last}"]
    bad = [f"{mid}-{last}", f"{area}-{mid}", local, d + d[:5], f"{last}-{mid[:2]}-{area[:2]}", f"{last[:2]}.{mid[:2]}.{last}", f"{area},{mid},{last}", f"{mid}.{last}", f"({last})", f"{last} {last} {mid} {area} {mid}"]
    return [(x, True) for x in good] + [(x, False) for x in bad]


def examples(kind: int, before: str, s: str, after: str):
    """(text, spans): a span in its surroundings, as it stands and spelled otherwise; spoiled ones are no spans."""
    own = len(before)
    for x, good in ((s, True), *_spellings(kind, s)):
        text = before + x + after
        spans = [v for v in base_spans(text) if v[2] <= own or v[1] >= own + len(x)]
        held = [v for v in base_spans(x)] if not good else []
        yield text, [*spans, *((k, a + own, b + own) for k, a, b in held), *([(kind, own, own + len(x))] if good else [])]
    token = f'{zlib.crc32(s.encode()):08x}{zlib.crc32(s.encode(), 1):08x}{zlib.crc32(s.encode(), 2):08x}'
    for x in (token, "2023-05-17", "17.05.2023 10:30", "1,234,567.89", "version 10.2.33", "12345678"):
        text = before + x + after
        yield text, base_spans(text)


def train(rows: list[tuple[int, str, str, str]], epochs: int = EPOCHS) -> dict[str, float]:
    """Weights from (kind, text before, span, text after); stochastic gradient ascent on the likelihood, in the given order."""
    work = []
    for row in rows:
        for text, spans in examples(*row):
            for region in regions(text):
                tokens, found = lattice(text, region, [])
                at = {(tokens[i][0], tokens[j - 1][1], k): c for c, (i, j, k, _) in enumerate(found)}
                chosen = [c for k, a, b in spans if (c := at.get((a, b, k))) is not None]
                chosen = [c for n, c in enumerate(chosen) if all(found[c][0] >= found[o][1] or found[o][0] >= found[c][1] for o in chosen[:n])]
                if found:
                    work.append((len(tokens), found, set(chosen)))
    weights: dict[str, float] = {}
    slope: dict[str, float] = {}
    for _ in range(epochs):
        for n, found, chosen in work:
            shares, adjacent = expected(n, found, weights)
            step: dict[str, float] = {}
            for c, (i, _, _, names) in enumerate(found):
                g = (c in chosen) - shares[c]
                if abs(g) > 1e-4:
                    for f in names:
                        step[f] = step.get(f, 0.0) + g
            met = sum(found[c][0] == found[o][1] for c in chosen for o in chosen)
            step[ADJACENT] = met - adjacent
            for f, g in step.items():
                w = weights.get(f, 0.0)
                g -= L2 * w
                slope[f] = slope.get(f, 1e-6) + g * g
                weights[f] = w + 0.3 * g / math.sqrt(slope[f])
    return weights


def all_spans(text: str, weights: dict[str, float] | None) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, whether a pattern found it), by start and kind."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    if weights:
        fixed = joined(base)
        for region in regions(text):
            tokens, found = lattice(text, region, fixed)
            if found:
                out += [(found[c][2], tokens[found[c][0]][0], tokens[found[c][1] - 1][1], False) for c in decode(len(tokens), found, weights)]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def sample(docs: DataFrame, text_col: str = "text", spans: int = TRAIN_SPANS) -> list[tuple[int, str, str, str]]:
    """The spans to learn from: of each kind those with the smallest hashes, whatever the partitions are."""

    def run(batches):
        best: list[list] = [[] for _ in KINDS]
        seen: list[set] = [set() for _ in KINDS]
        for b in batches:
            for t in b.column(0).to_pylist():
                for kind, a, e in base_spans(t):
                    if e - a > 120:
                        continue
                    row = (t[max(0, a - AROUND) : a], t[a:e], t[e : e + AROUND])
                    h = zlib.crc32("\0".join(row).encode("utf-8", "surrogatepass"))
                    item = (-h, *row)
                    if item in seen[kind]:
                        continue
                    if len(best[kind]) < spans:
                        heapq.heappush(best[kind], item)
                    elif item > best[kind][0]:
                        seen[kind].discard(heapq.heapreplace(best[kind], item))
                    else:
                        continue
                    seen[kind].add(item)
        rows = [(k, -h, *r) for k, items in enumerate(best) for h, *r in items]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["kind", "h", "before", "span", "after"])

    offered = materialize(docs.select(whole_text(text_col).alias("text")).mapInArrow(run, "kind int, h long, before string, span string, after string"), "pii-sample")
    out = []
    for k in range(len(KINDS)):
        out += [tuple(r) for r in offered.where(F.col("kind") == k).distinct().orderBy("h", "before", "span", "after").limit(spans).select("kind", "before", "span", "after").collect()]
    return sorted(out, key=lambda r: zlib.crc32("\0".join(map(str, r)).encode("utf-8", "surrogatepass")))  # kinds in turn


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def fitted(docs: DataFrame, text_col: str = "text") -> dict[str, float] | None:
    """A model of the spans of docs, trained in one task on the bounded sample; None if there is none."""
    rows = sample(docs, text_col)
    if not rows:
        return None
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(rows)

    def run(batches):
        for _ in batches:
            pass
        weights = train(held.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(weights)), pa.array(list(weights.values()))], ["name", "weight"])

    return {r["name"]: r["weight"] for r in spark.range(0, 1, 1, 1).mapInArrow(run, "name string, weight double").collect()}


def find_pii(docs: DataFrame, weights: dict[str, float] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row of docs; weights: of a trained model, None for the patterns alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        model = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in text_chunks(texts):
                found = [[(KINDS[k], a, e, base) for k, a, e, base in all_spans(t, model)] for t in texts[i:j]]
                rows = pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in x] for x in found], kind)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), rows], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the patterns' spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone count the patterns' spans, n_added those that the random field adds."""
    docs = load(spark, sf_dir, "documents")
    return digests(find_pii(docs, fitted(docs)))
