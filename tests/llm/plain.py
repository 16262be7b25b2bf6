"""Plain versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = r"[^\x20\x09-\x0D]+"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op1(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for i in range(max(1, len(w) - 9)):
                windows[tuple(w[i : i + 10])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, owners = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    owners |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(owners), sha(",".join(sorted(owners))), bool(hit)))
    return out


def op2(docs):
    sets = []
    for _, text in docs:
        w = re.findall(SPACE, (text or "").translate(FOLD))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        least[root(i)] += [doc] if doc is not None else []
    return [(doc, len(sets[i]), min(least[root(i)], default=None)) for i, (doc, _) in enumerate(docs)]


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def op3(docs):
    out = []
    for doc, text in docs:
        t = text or ""
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        kinds = Counter(k for _, k, _ in spans)
        out.append((doc, kinds[0], kinds[1], kinds[2], sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)))))
    return out


def op5(docs):
    out = []
    for doc, text in docs:
        t = text or ""
        w = re.findall(SPACE, t)
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        seen, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        out.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed))
    return out


def op7(docs, model):
    """Ids of each document as bytes."""
    import numpy as np

    return [(doc, np.asarray([*model.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for doc, text in docs]


def op10(docs):
    least, words = {}, [re.findall(SPACE, t or "") for _, t in docs]
    for (doc, _), w in zip(docs, words):
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if doc is not None:
                least[k] = min(doc, least.get(k, doc))
    out = []
    for (doc, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            if doc is not None and least[k] < doc:
                gone.update(range(i, i + 50))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def remainder(doc, divisor: int) -> int:
    return zlib.crc32(str("" if doc is None else doc).encode()) % divisor


def op11(docs, keep=10):
    """``docs``: (lang, source, text)."""
    groups, held, count, by_lang = {}, Counter(), Counter(), Counter()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        held.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
        by_lang.update((lang, t) for t in terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for (g, t), n in held.items() if g == lang and n >= keep]
        share = lambda n, total: 1 + 1_000_000_000 * (n + 2) // (total + 2 * len(kept))  # noqa: B023, E731
        of = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        p = {s: {t: share(n, sum(of[s].values())) for t, n in of[s].items()} for s in sources}
        q = {t: share(by_lang[lang, t], sum(by_lang[lang, t] for t in kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s}))
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if of[s][t] and p[s][t] > q[t])[:10]
            for part, rows in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(rows)]
    return out


def op12(docs, least=100, longest=5, top=2000):
    """``docs``: (lang, text)."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(a, inside.get(p[i : i + m], 0))
        rows = []
        for p, a in candidates.items():
            if 100 * inside.get(p, 0) >= 100 * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return out


def op13(docs, least, discount, gain):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) by the recursion over contexts."""
    tokens = [(doc, [*re.findall(SPACE, (text or "").translate(FOLD)), None]) for doc, text in docs]
    held = [remainder(doc, 7) == 2 for doc, _ in tokens]
    one, two, three = Counter(), Counter(), Counter()
    for (_, w), out in zip(tokens, held):
        if not out:
            one.update(w)
            two.update(zip(w, w[1:]))
            three.update(zip(w, w[1:], w[2:]))
    total, distinct = sum(one.values()), len(one)
    mass2, mass3 = Counter(), Counter()
    lifts = lambda c, of, below: c >= least and c * math.log10(c / of / below) >= gain

    def p(w, *context):
        if not context:
            return (one[w] + 1) / (total + distinct + 1)
        counts, mass, of = (two, mass2, one.get(context[0])) if len(context) == 1 else (three, mass3, two.get(context))
        key = context if len(context) == 2 else context[0]
        if key not in mass:
            return p(w, *context[1:])
        return max(counts.get((*context, w), discount) - discount, 0) / of + (1 - mass[key] / of) * p(w, *context[1:])

    two = {(a, b): c for (a, b), c in two.items() if lifts(c, one[a], p(b))}
    for (a, _), c in two.items():
        mass2[a] += c - discount
    three = {(a, b, w): c for (a, b, w), c in three.items() if (a, b) in two and (b, w) in two and lifts(c, two[a, b], p(w, b))}
    for (a, b, _), c in three.items():
        mass3[a, b] += c - discount

    rows = []
    for (doc, w), out in zip(tokens, held):
        score = sum(math.log10(p(x, *w[max(0, i - 2) : i])) for i, x in enumerate(w))
        rows.append((doc, out, len(w), sum(x in one for x in w), total, sum(math.log10(p(x)) for x in w), score))
    return rows
