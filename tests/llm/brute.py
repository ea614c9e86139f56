"""Brute-force versions of the contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def joined(ids, links):
    """Smallest id reachable of each."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def lowered(text):
    return (text or "").encode().lower().split()


def shingles(text):
    w = lowered(text)
    return set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} - {()}


def near_copies(rows, percent=75):
    sets, holders, links = {d: shingles(t) for d, t in rows}, defaultdict(list), []
    for d, s in sorted(sets.items()):
        common = Counter(e for x in s for e in holders[x])
        links += [(d, e) for e, n in common.items() if 100 * n >= percent * (len(s) + len(sets[e]) - n)]
        for x in s:
            holders[x].append(d)
    first = joined(sets, links)
    return {d: (len(s), first[d]) for d, s in sets.items()}


def language_model(rows, order=3, held_out=lambda d: zlib.crc32(str(d).encode()) % 7 == 2):
    """Scores by absolute discounting, written as the recursion it is."""
    tokens = {d: [*lowered(t), None] for d, t in rows}
    out = {d: held_out(d) for d in tokens}
    grams = [Counter() for _ in range(order)]
    for d, w in tokens.items():
        if not out[d]:
            for m, c in enumerate(grams):
                c.update(zip(*(w[k:] for k in range(m + 1)), strict=False))
    follow = [Counter(g[:-1] for g in c) for c in grams]
    once, twice = ([sum(n == k for n in c.values()) for c in grams] for k in (1, 2))
    discount = [min(max(a / (a + 2 * b) if a else 0.5, 0.05), 0.95) for a, b in zip(once, twice, strict=True)]
    total, types = sum(grams[0].values()), len(grams[0])

    def p(context, w):
        if not context:
            return (grams[0][w,] + 1) / (total + types + 1)
        m, n = len(context), grams[len(context) - 1][context]
        shorter = p(context[1:], w)
        return (max(grams[m][*context, w] - discount[m], 0) + discount[m] * follow[m][context] * shorter) / n if n else shorter

    made = {}
    for d, w in tokens.items():
        base = sum(math.log10(p((), x)) for x in w)
        score = sum(math.log10(p(tuple(w[max(0, k - order + 1) : k]), x)) for k, x in enumerate(w))
        made[d] = out[d], len(w), sum(grams[0][x,] > 0 for x in w), total, base, score
    return made


def without_repeats(rows, window=50):
    """Of each document: its words, and those that stay."""
    parts, least = {d: (t or "").encode().split() for d, t in rows}, {}
    for d, w in sorted(parts.items()):
        for k in range(len(w) - window + 1):
            least.setdefault(tuple(w[k : k + window]), d)
    made = {}
    for d, w in parts.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        made[d] = w, [x for x, g in zip(w, gone, strict=True) if not g]
    return made


def kept_words(rows, window=50):
    return {d: (len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()) for d, (w, left) in without_repeats(rows, window).items()}


def importance(rows, told, noise, buckets, size, kept):
    """Log weight and features of each document, and the documents drawn."""
    grams = {d: Counter(buckets(t).tolist()) for d, t in rows}
    raw, target = Counter(), Counter()
    for d, g in grams.items():
        raw.update(g)
        if told.get(d):
            target.update(g)
    total = {of: [sum(n for b, n in c.items() if b // size == of) for c in (target, raw)] for of in range(3)}

    def ratio(b):
        t, r = total[b // size]
        seen, expected = target[b] + 3.0, raw[b] * t / r + 3.0
        x = math.log(seen / expected)
        return math.copysign(max(0.0, abs(x) - math.sqrt(1 / seen + 1 / expected)), x)

    weight = {d: sum(n * ratio(b) for b, n in g.items()) for d, g in grams.items()}
    good = sorted(weight[d] for d, yes in told.items() if yes and d in weight)
    place = kept * (len(good) - 1)
    low, high = good[math.floor(place)], good[math.ceil(place)]
    k = sum(w >= low + (high - low) * (place - math.floor(place)) for w in weight.values())
    ranked = sorted(weight, key=lambda d: -weight[d] - noise[d])
    return weight, {d: sum(g.values()) for d, g in grams.items()}, ranked, k


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def strong_spans(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


#: Weak kinds: rank, name, pattern, and what a match must hold.
WEAK = (
    (3, "key_id", re.compile(r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{15,}(?![A-Za-z0-9])"), ("[0-9]",)),
    (4, "key_secret", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}"), ("[0-9]", "[a-z]", "[A-Z]")),
    (5, "endpoint", re.compile(r"(?<![A-Za-z0-9])(?:https?|s3|redis|postgres|mysql|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}"), ()),
)


def all_spans(text, reach=256):
    """Strong spans, and the weak ones that are linked: every scope is looked at alone."""
    strong = strong_spans(text)
    weak = []
    for rank, kind, pattern, needs in WEAK:
        for m in pattern.finditer(text or ""):
            if all(re.search(n, m[0]) for n in needs):
                weak.append((m.start(), rank, kind, m.end()))
    weak = [w for w in weak if w[1] == 5 or not any(s[0] < w[3] and w[0] < s[3] for s in strong)]
    linked = set()
    for k in range(-1, len(text or "") // reach + 1):
        inside = [s for s in strong + weak if s[0] < (k + 2) * reach and s[3] > k * reach]
        kinds = {s[2] for s in inside}
        if kinds & {"access", "key_id"} and kinds & {"assign", "hex", "key_secret"}:
            linked |= {s for s in inside if s[1] > 2}
    return sorted([*strong, *linked])


def redacted(text, mark="[secret]"):
    out, at = "", 0
    for start, _, _, end in all_spans(text):
        if start >= at:
            out += text[at:start] + mark
        at = max(at, end)
    return out + text[at:]
