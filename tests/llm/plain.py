"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def decontaminate(docs, items, window=10):
    queries = collections.defaultdict(set)
    widths = set()
    for i, t in items:
        w = LETTERED.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        if n:
            widths.add(n)
            for s in range(len(w) - n + 1):
                queries[tuple(w[s : s + n])].add(i)
    out = []
    for d, t in docs:
        w = LETTERED.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in widths:
            for s in range(len(w) - n + 1):
                if (p := tuple(w[s : s + n])) in queries:
                    hit |= set(range(s, s + n))
                    found |= queries[p]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return sorted(out)


def near_items(docs, items, window, within):
    """{doc: items that have a window all of whose words stand near its first word}, looking at every place."""
    words = {d: LETTERED.findall((t or "").translate(LOWER)) for d, t in docs}
    out = {d: set() for d, _ in docs}
    for i, t in items:
        w = LETTERED.findall((t or "").translate(LOWER))
        for s in range(max(1, len(w) - window + 1) if w else 0):
            part = w[s : s + window]
            for d, ws in words.items():
                places = [k for k, x in enumerate(ws) if x == part[0]]
                if any(set(part) <= set(ws[max(0, k - within) : k + within + 1]) for k in places):
                    out[d].add(i)
    return {d: sorted(x) for d, x in out.items()}


def letter_grams(text):
    """All 3- to 5-byte n-grams of letters and single spaces (digits and signs are spaces), a space at both ends."""
    raw = re.sub(rb"[\x00-\x60\x7B-\x7F]+", b" ", b" " + text.translate(LOWER).encode() + b" ")
    return [raw[i : i + n] for n in (3, 4, 5) for i in range(len(raw) - n + 1)]


def best_fit_cost(pieces, lengths, cost):
    """Cost of best fit, longest first, one piece at a time, each bin downsized at last."""
    lengths, bins, left = sorted(lengths), [], sum(pieces)
    for n in pieces:
        fitting = [b for b in bins if b[0] - b[1] >= n]
        if fitting:
            best = min(fitting, key=lambda b: b[0] - b[1])
        else:
            best = [min((c for c in lengths if c >= n), key=lambda c: (cost(c) / max(n, min(c, left)), c)), 0]
            bins.append(best)
        best[1] += n
        left -= n
    return sum(cost(min(c for c in lengths if c >= used)) for _, used in bins)


def byte_dedup(docs, n=50):
    first: dict = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            first[b[i : i + n]] = min(first.get(b[i : i + n], d), d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < d:
                m[i : i + n] = b"\1" * n
        out.append((d, len(b), sum(m), len(re.findall(b"\1+", bytes(m))), sha(bytes(x for x, y in zip(b, m, strict=True) if not y))))
    return sorted(out)


def word_dedup(docs, n=20):
    first: dict = {}
    for d, t in docs:
        w = SPACED.findall(t or "")
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, (d, i)), (d, i))
    out = []
    for d, t in docs:
        w = SPACED.findall(t or "")
        m = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (d, i):
                m[i : i + n] = [True] * n
        out.append((d, len(w), sum(m), sha(" ".join(x for x, y in zip(w, m, strict=True) if not y))))
    return sorted(out)


def near_duplicates(docs, words=4, percent=80):
    sets = {}
    for d, t in docs:
        w = SPACED.findall((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    found = []
    for k, (pattern, group, least) in enumerate(((ASSIGN, 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24))):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    found.sort()
    names = ("assign", "access", "hex")
    return [sum(k == i for _, k, _ in found) for i in range(3)] + [sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in found))]


def _p_values(s):
    """p-values of a string by the three tests, each by its own formula on plain lists."""
    def erfc(x):
        t = 1 / (1 + 0.3275911 * x)
        poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        return min(1.0, max(1e-30, poly * math.exp(-x * x)))

    digits, upper, lower = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s):
        s, classes = s.lower(), [(c, 1 / 16) for c in "0123456789abcdef"]
    elif re.fullmatch("[A-Z2-7]+", s):
        classes = [(upper[:13], 13 / 32), (upper[13:], 13 / 32), ("234567", 6 / 32)]
    else:
        size = 62 if re.fullmatch("[A-Za-z0-9]+", s) else 64
        classes = [(part, len(part) / size) for part in (upper[:13], upper[13:], lower[:13], lower[13:], digits)]
        classes += [("+-/_", 2 / 64)] if size == 64 else []
    n = len(s)
    x = sum((sum(c in part for c in s) - n * share) ** 2 / (n * share) for part, share in classes)
    k = len(classes) - 1
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    uniform = max(1e-30, erfc(z / math.sqrt(2)) / 2 if z >= 0 else 1 - erfc(-z / math.sqrt(2)) / 2)
    v = [(digits + upper + lower + "+-/_").index(c) for c in s]
    d = [a - sum(v) / n for a in v]
    above, turns = sum(a > 0 for a in d), sum(a * b < 0 for a, b in zip(d, d[1:], strict=False))
    mean = 1 + 2 * above * (n - above) / n
    z_runs = 9.0 if mean <= 1 else abs(turns + 1 - mean) / math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    var = sum(a * a for a in d)
    z_serial = 9.0 if var <= 0 else abs(sum(a * b for a, b in zip(d, d[1:], strict=False)) / var + 1 / n) * math.sqrt(n)
    h = -math.log(uniform) - math.log(erfc(z_runs / math.sqrt(2))) - math.log(erfc(z_serial / math.sqrt(2)))
    return math.exp(-h) * (1 + h + h * h / 2)


def random_spans(docs, level=0.05, alarms=0.1):
    """{doc: random spans outside base spans}: both error rates by counting strings over and under each bar."""
    found = [(d, m.start(), m.end(), m[0]) for d, t in docs for m in re.finditer("[A-Za-z0-9+/_-]{20,}", t or "") if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    of = collections.defaultdict(list)
    for row in found:
        p = _p_values(row[3])
        of[sum(len(row[3]) >= n for n in (24, 32, 64))].append((min(199, math.floor(-8 * math.log10(max(p, 1e-30)))), row))
    out = {d: [] for d, _ in docs}
    for rows in of.values():
        bins = [b for b, _ in rows]
        rejected = [b for b in set(bins) if 10 ** (-b / 8) <= level * sum(x >= b for x in bins) / len(bins)]
        keys = sum(b < 3 for b in bins) / (1 - 10 ** (-3 / 8))
        clear = [b for b in set(bins) if (n := sum(x <= b for x in bins)) - keys * (1 - (0 if b == 199 else 10 ** (-(b + 1) / 8))) <= alarms * n]
        for b, (d, lo, hi, _) in rows:
            if clear and b <= max(clear) and not (rejected and b >= min(rejected)):
                out[d].append((lo, hi))
    texts = dict(docs)
    for d, spans in out.items():
        base = [m.span() for pattern, group, least in ((ASSIGN, 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24)) for m in pattern.finditer(texts[d]) if len(m[group]) >= least]
        out[d] = sorted(s for s in spans if not any(a <= s[0] and s[1] <= b for a, b in base))
    return out


def perplexity(docs, discounts):
    """(doc_id, held out, tokens, known, training tokens, base score, score) by plain counting."""
    seqs = [(d, SPACED.findall((t or "").translate(LOWER)) + ["\0end"]) for d, t in docs]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    one, two, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for d, s in seqs:
        if not held(d):
            one.update(s)
            pairs = list(zip(["\0begin", *s], s, strict=False))
            two.update(pairs)
            ctx.update(v for v, _ in pairs)
    total, distinct = sum(one.values()), len(one)
    again = collections.Counter(w for _, w in two)
    follow = collections.defaultdict(lambda: [0, 0, 0])
    for (v, _), c in two.items():
        follow[v][min(c, 3) - 1] += 1
    n, m = collections.Counter(two.values()), collections.Counter(again.values())
    d2, d1 = discounts(*(n[i] for i in range(1, 5))), discounts(*(m[i] for i in range(1, 5)))
    free = (d1[1] * m[1] + d1[2] * m[2] + d1[3] * sum(c for k, c in m.items() if k > 2)) / max(1, len(two))

    def p(v, w):
        low = (again[w] - d1[min(again[w], 3)]) / len(two) + free / (distinct + 1) if two else 1 / (distinct + 1)
        if not ctx[v]:
            return low
        f = follow[v]
        return (two[v, w] - d2[min(two[v, w], 3)]) / ctx[v] + (d2[1] * f[0] + d2[2] * f[1] + d2[3] * f[2]) / ctx[v] * low

    out = []
    for d, s in seqs:
        base = sum(math.log10((one[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in s)
        out.append((d, held(d), len(s), sum(one[w] > 0 for w in s), total, base, sum(math.log10(p(v, w)) for v, w in zip(["\0begin", *s], s, strict=False))))
    return sorted(out)


def _scrambled(h):
    h ^= h >> 31
    h = h * 0x7FB5D329728EA185 & WORD
    h ^= h >> 27
    h = h * 0x81DADEF4BC2DD44D & WORD
    return h ^ h >> 33


WORD = (1 << 64) - 1


def phrases(text):
    """The distinct phrases of a text's bytes: each the longest one known so far and a byte more."""
    known, at = {b""}, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at:end] in known:
            end += 1
        if text[at:end] in known:
            break  # the text ends within a known phrase
        known.add(text[at:end])
        at = end
    return known - {b""}


def fingerprint(text, base, size=128):
    """The smallest 32-bit hashes of the phrases, `base` being the multiplier of the polynomial."""
    hashes = set()
    for phrase in phrases(text.encode()):
        h = 0
        for c in reversed(phrase):
            h = (h * base + c + 1) & WORD
        hashes.add(_scrambled((h + len(phrase) * 0xD6E8FEB86659FD93) & WORD) >> 32)
    return sorted(hashes)[:size]


def alike(a, b, size=128):
    union = sorted({*a, *b})[:size]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def fingerprints(docs, base):
    """Rows of the fingerprint query for (doc_id, text), ties by text."""
    docs = sorted([(-(1 << 63) if d is None else d, t or "") for d, t in docs], key=lambda x: (-x[0], x[1]))
    out = []
    for (d, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        n = len(t) // 2
        edit = t[: len(t) - n] + after[:n]
        own, edited, following = (fingerprint(x, base) for x in (t, edit, after))
        text = lambda f: "".join(f"{x:08x}" for x in f)
        out.append((None if d == -(1 << 63) else d, len(t), sha(edit), text(own), text(edited), alike(own, edited), alike(own, following)))
    return out
