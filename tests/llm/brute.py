"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def components(nodes, links):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {n: find(n) for n in nodes}


def shingles(text, k=5):
    w = words((text or "").translate(_LOWER))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def near(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for x, a in enumerate(ids)
        for b in ids[x + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {i: len(s) for i, s in sets.items()}, components(ids, links)


def substring(rows, k=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone[j : j + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def factors(rows, k=13):
    """(start, length) of the longest runs of words from left to right that some earlier text has, and what they may be copied from.

    A plain parser: at each place every place of every earlier text is tried; the next factor begins k - 1
    words before the last one's end. Values are lists of (start, length, {(id, place)}).
    """
    said = {i: words(t) for i, t in rows}
    out = {}
    for i, w in said.items():
        places = {}
        for other in said:
            if other < i:
                for p in range(len(said[other]) - k + 1):
                    places.setdefault(tuple(said[other][p : p + k]), []).append((other, p))
        found, j = [], 0
        while j + k <= len(w):
            best, copied = 0, set()
            for other, p in places.get(tuple(w[j : j + k]), ()):
                n = k
                while j + n < len(w) and p + n < len(said[other]) and w[j + n] == said[other][p + n]:
                    n += 1
                if n >= best:
                    copied = copied if n == best else set()
                    best = n
                    copied.add((other, p))
            if best:
                found.append((j, best, copied))
                j += best - k + 1 if j + best < len(w) else len(w)
            else:
                j += 1
        out[i] = found
    return out


def base_metrics(text):
    text = text or ""
    w = words(text)
    count = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    inside = set()
    for j in range(len(w) - 2):
        if count[tuple(w[j : j + 3])] > 1:
            inside |= {j, j + 1, j + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    out = (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside))
    return (*out, len(w) < 50 or 100 * len(inside) > 50 * len(w))


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        over = sum(weight[s] for s in names if s not in full)
        out = {s: cap * sizes[s] if s in full else left * weight[s] / over for s in names}
        more = {s for s in names if s not in full and out[s] > cap * sizes[s]}
        if not more:
            return out
        full |= more


_MASK = (1 << 64) - 1


def mix64(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def grams(text, word_hash, bits=22, gaps=(1, 2, 3)):
    """Distinct coordinates of a text's words and of its pairs of words up to two words apart."""
    w = [word_hash(x) for x in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (text or "").translate(_LOWER))]
    out = {mix64(h ^ 1) for h in w}
    for gap in gaps:
        out |= {mix64((a * 3 + mix64((b + gap) & _MASK)) & _MASK) for a, b in zip(w, w[gap:], strict=False)}
    return {h & ((1 << bits) - 1) for h in out}


def ftrl(rows, alpha, beta, l1, l2, epochs):
    """Weights by coordinate, with None for the bias, which has no L1 term, from (coordinates, label) rows in turn."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        bound = 0.0 if i is None else l1
        if abs(z[i]) <= bound and i is not None:
            return 0.0
        return -(z[i] - math.copysign(bound, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for coordinates, label in rows:
            w = {i: weight(i) for i in [*coordinates, None]}
            g = sigmoid(sum(w.values())) - label
            for i, old in w.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * old
                n[i] += g * g
    return {i: weight(i) for i in list(z)}


def sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def quality_features(text):
    text = text or ""
    w, (n, chars, symbols, dup, repeat, _) = words(text), base_metrics(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    share = lambda a, b: a / max(b, 1)
    upper, marks, bars = (len(re.findall(p, text)) for p in ("[A-Z]", "!", r"\|"))
    return {
        "symbol_share": share(symbols, chars), "dup_line_share": share(dup, len(lines)), "repeat_share": share(repeat, n), "mean_word": share(chars, n),
        "upper_share": share(upper, chars), "mark_share": share(marks, n), "bar_share": share(bars, n), "distinct_share": share(len(set(w)), n),
    }


def decision_list(rows, cuts=48, most_conditions=3, most_rules=12, precision=0.9, support=3):
    """Sequential covering over (features, label) rows in order: rules of (feature, above, threshold) that find label 0."""
    names = list(rows[0][0]) if rows else []
    bad = {i for i, r in enumerate(rows) if r[1] == 0}
    tests = []
    for f in names:
        values = sorted(r[0][f] for r in rows)
        known = sorted({rows[i][0][f] for i in bad} | set(values[:: max(1, len(values) // 256)]))
        for cut in sorted({known[len(known) * c // cuts] for c in range(cuts)}):
            over = {i for i, r in enumerate(rows) if r[0][f] >= cut}
            tests += [((f, True, cut), over), ((f, False, cut), set(range(len(rows))) - over)]
    left, rules = set(range(len(rows))), []
    grow, prune = {i for i in left if i % 3}, {i for i in left if i % 3 == 0}
    while len(rules) < most_rules and left & grow & bad:
        rule, covered = [], left & grow
        while len(rule) < most_conditions and covered - bad:
            before = math.log2(len(covered & bad) / len(covered)) if covered & bad else 0.0
            best, gain = None, 0.0
            for t in tests:
                p = len(covered & t[1] & bad)
                if p and p * (math.log2(p / len(covered & t[1])) - before) > gain + 1e-12:
                    best, gain = t, p * (math.log2(p / len(covered & t[1])) - before)
            if best is None:
                break
            rule.append(best)
            covered &= best[1]

        def worth(upto):
            c = set.intersection(left & prune, *(t[1] for t in rule[:upto]))
            return (len(c & bad) - len(c - bad)) / len(c) if c else -1.0

        keep = len(rule)
        for upto in range(len(rule) - 1, 0, -1):
            keep = upto if worth(upto) >= worth(keep) else keep
        rule = rule[:keep]
        all_ = set.intersection(left, *(t[1] for t in rule)) if rule else set()
        hits = len(all_ & prune & bad)
        if not rule or hits < support or hits < precision * len(all_ & prune):
            break
        rules.append([t[0] for t in rule])
        left -= all_
    return rules


def caught(rules, features):
    return any(all((features[f] >= cut) == above for f, above, cut in rule) for rule in rules)
