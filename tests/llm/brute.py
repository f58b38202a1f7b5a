"""Plain-Python forms of the text operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import lgamma, log, log10, pi

WHITE = r"[^\x20\x09-\x0D]+"
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(A_TO_Z)


def words(text):
    return re.findall(WHITE, text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(docs):
    """(doc_id, text) rows in the order of the operators: nulls last, then texts, nulls last."""
    return sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] is None, d[1] or ""))


def decontamination(docs, items, k=10):
    letters = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for item, text in items:
        w = re.findall(letters, lower(text))
        for i in range(max(1, len(w) - k + 1)) if w else ():
            windows[tuple(w[i:i + k])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = re.findall(letters, lower(text))
        hit, met = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    met |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit)))
    return out


def repeats(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_chars, longest_repeat"""
    w = words(text)
    longest, best = 0, [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            if i != j:
                n = 0
                while max(i, j) + n < len(w) and w[i + n] == w[j + n]:
                    n += 1
                best[i] = max(best[i], n)
    longest = max(best, default=0)

    def covered(least):
        return {x for i, n in enumerate(best) if n >= least for x in range(i, i + n)}

    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(covered(8)), sum(len(w[i]) for i in covered(6)), longest)


def passes(text, covered_limit=0.40, longest_limit=100):
    """The repetition verdict by sets of windows: covered by windows of 6, none of longest_limit + 1 twice."""
    w = words(text)

    def again(k):
        seen = Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        return {j for i in range(len(w) - k + 1) if seen[tuple(w[i:i + k])] > 1 for j in range(i, i + k)}

    chars = sum(map(len, w))
    return (len(w) >= 20 and 100 * len(again(8)) <= 30 * len(w) and sum(len(w[j]) for j in again(6)) <= covered_limit * chars
            and not again(longest_limit + 1))


def line_dedup(docs, run=2):
    """(doc_id, text left, lines, removed) in the order of by_id"""
    seen, out = set(), []
    for doc, text in by_id(docs):
        raw = (text or "").split("\n")
        solid = [i for i, x in enumerate(raw) if words(x)]
        key = [raw[i].strip(" \t\n\v\f\r") for i in solid]
        gone = set()
        for i in range(len(key) - run + 1):
            window = tuple(key[i:i + run])
            if window in seen:
                gone.update(solid[i:i + run])
            seen.add(window)
        out.append((doc, None if text is None else "\n".join(x for i, x in enumerate(raw) if i not in gone), len(solid), len(gone)))
    return out


def lone_line_dedup(docs, lone):
    """line_dedup with lines of that many words, and only lines, as runs of their own."""
    pairs, singles, out = set(), set(), []
    for doc, text in by_id(docs):
        raw = (text or "").split("\n")
        solid = [i for i, x in enumerate(raw) if words(x)]
        key = [raw[i].strip(" \t\n\v\f\r") for i in solid]
        gone = set()
        for i in range(len(key)):
            if key[i:i + 2] in [list(p) for p in pairs if p[0] == key[i]]:
                gone.update(solid[i:i + 2])
            if i + 1 < len(key):
                pairs.add((key[i], key[i + 1]))
            if len(key) == 1 or len(words(key[i])) >= lone:
                if key[i] in singles:
                    gone.add(solid[i])
                singles.add(key[i])
        out.append((doc, None if text is None else "\n".join(x for i, x in enumerate(raw) if i not in gone), len(solid), len(gone)))
    return out


def window_dedup(docs, k=20):
    seen, out = set(), []
    for doc, text in by_id(docs):
        w, gone = words(text), set()
        for i in range(len(w) - k + 1):
            window = tuple(w[i:i + k])
            if window in seen:
                gone.update(range(i, i + k))
            seen.add(window)
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def similar(docs, n=4, percent=85):
    """(doc_id, set size, smallest doc_id reachable) in the order of by_id"""
    rows = by_id(docs)
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows))]


def secret_spans(text):
    """Base spans (kind, start, end) by start, then kind."""
    text = text or ""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    names = ("assign", "access", "hex")
    return [(names[k], a, b) for a, k, b in sorted(out)]


def held_out(doc):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def baseline(docs):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)"""
    counts = Counter()
    for doc, text in docs:
        if not held_out(doc):
            counts.update([*words(lower(text)), None])
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for doc, text in docs:
        t = [*words(lower(text)), None]
        out.append((doc, held_out(doc), len(t), sum(counts[x] > 0 for x in t), total, sum(log10((counts[x] + 1) / (total + kinds + 1)) for x in t)))
    return out


class ContextTree:
    """Context-tree weighting with a dictionary of nodes; contexts are tuples, nearest byte first."""

    def __init__(self, docs, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        for doc, text in docs:
            if not held_out(doc):
                for context, prefix, bit in self.decisions(text):
                    for d in range(depth + 1):
                        self.counts[context[:d], prefix][bit] += 1
        self.children = defaultdict(set)
        for context, prefix in self.counts:
            if context:
                self.children[context[:-1], prefix].add((context, prefix))
        self.weights = {}

    def decisions(self, text):
        data = lower(text).encode() + b"\xff"
        past = b"\xff" * self.depth
        for byte in data:
            prefix = 1
            for i in range(7, -1, -1):
                bit = byte >> i & 1
                yield tuple(reversed(past)), prefix, bit
                prefix = prefix * 2 + bit
            past = past[1:] + bytes([byte])

    def own(self, node):
        a, b = self.counts[node]
        return lgamma(a + .5) + lgamma(b + .5) - lgamma(a + b + 1) - log(pi)

    def total(self, node):
        if node not in self.weights:
            own = self.own(node)
            if len(node[0]) == self.depth:
                self.weights[node] = own, 1.0
            else:
                below = sum(self.total(c)[0] for c in self.children[node])
                top = max(own, below)
                both = top + log(.5 * (2.718281828459045 ** (own - top)) + .5 * (2.718281828459045 ** (below - top)))
                self.weights[node] = both, 2.718281828459045 ** (log(.5) + own - both)
        return self.weights[node]

    def chance(self, context, prefix, bit, d=0):
        node = (context[:d], prefix)
        if node not in self.counts:
            return .5
        a, b = self.counts[node]
        kt = ((b if bit else a) + .5) / (a + b + 1)
        weight = self.total(node)[1]
        deeper = (context[:d + 1], prefix)
        if d == self.depth or deeper not in self.counts:
            return kt
        return weight * kt + (1 - weight) * self.chance(context, prefix, bit, d + 1)

    def score(self, text):
        return sum(log10(self.chance(*x)) for x in self.decisions(text))


def hard_negatives(rows, every=100, positives=5, negatives=10):
    """(anchor, positive, rank, negative, positive score, negative score) of (vec_id, label, vector) rows"""
    from math import floor, isfinite

    own = [(i, label, [floor(256 * x) for x in v]) for i, label, v in rows
           if i is not None and label is not None and v is not None and all(x is not None and isfinite(x) for x in v)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for a, label, v in own:
        if a % every:
            continue
        same = sorted((-score(v, w), i) for i, other, w in own if other == label and i != a)[:positives]
        rest = sorted((-score(v, w), i) for i, other, w in own if other != label and i != a)
        for p, positive in same:
            found = [(i, -s) for s, i in rest if 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(a, positive, n, i, -p, s) for n, (i, s) in enumerate(found, 1)]
    return out


def collocations(docs, least=100, longest=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) rows"""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    wanted = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    inside = defaultdict(int)
    for (lang, phrase), c in wanted.items():
        for k in range(2, len(phrase)):
            for i in range(len(phrase) - k + 1):
                inside[lang, phrase[i:i + k]] = max(inside[lang, phrase[i:i + k]], c)
    found = defaultdict(list)
    for (lang, phrase), a in wanted.items():
        if inside[lang, phrase] < a:
            cuts = []
            for k in range(1, len(phrase)):
                left, right = f[lang, phrase[:k]], f[lang, phrase[k:]]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found[lang].append((-score, -a, " ".join(phrase).encode(), left, right))
    return [(lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, rows in found.items() for rank, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
