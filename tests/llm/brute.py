"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import string
from collections import Counter, defaultdict
from itertools import combinations

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def low(t):
    return (t or "").translate(AZ)


def grams(words, n):
    return [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]


def rules(text):
    words = BLANK_WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if BLANK_WORD.search(x)]
    tri = grams(words, 3)
    n = Counter(tri)
    covered = {i + k for i, g in enumerate(tri) if n[g] > 1 for k in range(3)}
    failed = []
    for line in lines:
        w = BLANK_WORD.findall(line)
        chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in line)
        marks = sum(x in "|>" for x in w)
        from fleetlake.llm.quality_rules import BOILERPLATE
        failed.append(100 * symbols > 10 * chars or (marks >= 2 and len(w) - marks < 4 * marks)
                      or any(p in low(line) for p in BOILERPLATE))
    lost = sum(sum(map(len, BLANK_WORD.findall(x))) for x, f in zip(lines, failed) if f)
    chars = sum(map(len, words))
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            base, not base and 100 * lost <= 30 * chars)


def contaminated(text, items):
    words = ALNUM_WORD.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        w = ALNUM_WORD.findall(low(t))
        if not w:
            continue
        k = min(10, len(w))
        wanted = set(grams(w, k))
        for i, g in enumerate(grams(words, k)):
            if g in wanted:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def shingles(text):
    w = BLANK_WORD.findall(low(text))
    return {tuple(w)} if 0 < len(w) < 5 else set(grams(w, 5))


def near(docs):
    """{row number: (set size, component id)}; rows of one id are one document."""
    sets = [shingles(t) for _, t in docs]
    key = [(1, 0) if i is None else (0, i) for i, _ in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) or key[a] == key[b]:
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for x in range(len(docs)):
        groups[root(x)].append(x)
    out = {}
    for g in groups.values():
        least = min(key[x] for x in g)
        for x in g:
            out[x] = (len(sets[x]), None if least[0] else least[1])
    return out


def line_dedup(docs):
    """Per row (number of lines, dropped, text left)."""
    def key_of(line):
        return low(line.strip(" \t\n\x0b\x0c\r"))

    owner, order = {}, lambda i: math.inf if i is None else i
    for i, t in docs:
        for line in (t or "").split("\n"):
            k = key_of(line)
            if len(k) >= 10:
                owner[k] = min(owner.get(k, math.inf), order(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if owner.get(key_of(x), order(i)) == order(i)]
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return out


def unigram(docs, train):
    """{row: (tokens, known, train tokens, base score)}"""
    tokens = [BLANK_WORD.findall(low(t)) + [None] for _, t in docs]
    c = Counter(w for ws, x in zip(tokens, train) if x for w in ws)
    n, v = sum(c.values()), len(c)
    return [(len(ws), sum(c[w] > 0 for w in ws), n,
             sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in ws)) for ws in tokens]


def context_tree(train, depth):
    """A function of (context bytes, byte) giving log10 of its probability."""
    counts = defaultdict(lambda: [0, 0])
    seen = defaultdict(set)

    def steps(byte):
        return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]

    for t in train:
        data = b"\0" * depth + t + b"\xff"
        for p in range(depth, len(data)):
            for d in range(depth + 1):
                for node, bit in steps(data[p]):
                    ctx = data[p - d:p]
                    counts[ctx, node][bit] += 1
                    if d < depth:
                        seen[ctx, node].add(data[p - d - 1:p])

    def log_kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(ctx, node):
        a, b = counts.get((ctx, node), (0, 0))
        own = log_kt(a, b)
        if len(ctx) == depth:
            return own
        below = sum(weighted(c, node) for c in seen.get((ctx, node), ()))
        m = max(own, below)
        return m + math.log(math.exp(own - m) + math.exp(below - m)) - math.log(2)

    def p_one(data, d, node):
        """Probability of a 1 at a node, from depth d down."""
        ctx = data[len(data) - d:]
        a, b = counts.get((ctx, node), (0, 0))
        own = (b + .5) / (a + b + 1)
        if d == depth:
            return own
        ratio = math.exp(min(700, log_kt(a, b) - sum(weighted(c, node) for c in seen.get((ctx, node), ()))))
        return (ratio * own + p_one(data, d + 1, node)) / (ratio + 1)

    def log_p(ctx, byte):
        return sum(math.log10(p_one(ctx, 0, n) if bit else 1 - p_one(ctx, 0, n)) for n, bit in steps(byte))

    return log_p
