"""Plain-Python answers for the training-data queries, straight from their contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def op1(rows, templates, percent):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    out = []
    for doc_id, text in rows:
        low = (text or "").translate(LOW)
        w = ALNUM.findall(low)
        places, labels, score = [], set(), 0.0
        for p, label in phrases.items():
            p = p.split()
            at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        base, found = sorted(labels), set()
        for line in low.split("\n"):
            held = set(ALNUM.findall(line))
            hits = [(len(held & set(t.split())), len(set(t.split())), label) for label, t in templates]
            hits = [((n / m, n), label) for n, m, label in hits if 100 * n >= percent * m]
            if hits:
                best = max(hits)[0]
                found |= {label for c, label in hits if c == best}
                score = max(score, best[0])
        out.append((doc_id, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted({*base, *found})), 1.0 if places else score))
    return out


def op2(rows, k=20):
    seen, docs = {}, []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        w = SPACED.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if key in seen:
                gone[i : i + k] = [True] * k
            else:
                seen[key] = 1
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        docs.append((doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return docs


def op3(rows):
    out = []
    for doc_id, text in rows:
        text = text or ""
        w = SPACED.findall(text)
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        out.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    return out


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c)
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def op8(rows):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and _luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    out = []
    for doc_id, text in rows:
        spans = [(m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text or "") if ok(m[0])]
        n = Counter(k for *_, k in spans)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
        out.append((doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined.encode()).hexdigest(), joined))
    return out


def op6(rows, k, percent):
    """doc_id, n_shingles, component_id, kept by comparing every pair of sets that share a shingle."""
    sets = []
    for doc_id, text in rows:
        w = SPACED.findall((text or "").translate(LOW))
        sets.append((doc_id, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = {d: d for d, _ in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders: dict = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = Counter((i, j) for own in holders.values() for a, i in enumerate(own) for j in own[a + 1 :])
    for (i, j), n in pairs.items():
        if 100 * n >= percent * (len(sets[i][1]) + len(sets[j][1]) - n):
            a, b = sorted((top(sets[i][0]), top(sets[j][0])))
            parent[b] = a
    return [(d, len(s), top(d), top(d) == d) for d, s in sets]


def op9(rows, d_of, unigram_of, trust=0.001):
    """doc_id, held_out, n_tokens, n_known, N, base score, Katz score by the textbook recursion over dictionaries."""
    import math

    docs = [(i, [*SPACED.findall((t or "").translate(LOW)), None]) for i, t in rows]
    one, two, follow = Counter(), Counter(), {}
    trained = 0
    for i, w in docs:
        if fold(i, 10):
            trained += 1
            one.update(w)
            two.update(zip([("begin",), *w[:-1]], w))
    for h, w in two:
        follow.setdefault(h, []).append(w)
    n = sum(one.values())
    of_one, of_two = Counter(one.values()), Counter(two.values())
    p1 = unigram_of([n, len(one), *(of_one[r] for r in range(1, 7))])
    d = d_of([of_two[r] for r in range(1, 7)])
    c_h = {**one, ("begin",): trained}
    disc = lambda c: d[c - 1] if c <= 5 else 1 - trust
    weight = {}
    for h, ws in follow.items():
        left = 1 - sum(disc(two[h, w]) * two[h, w] for w in ws) / c_h[h]
        weight[h] = left / (1 - sum(p1(one[w]) for w in ws))
    out = []
    for i, w in docs:
        base = sum(math.log10((one[x] + 0.1) / (n + 0.1 * (len(one) + 1))) for x in w)
        score = 0.0
        for h, x in zip([("begin",), *w[:-1]], w):
            c = two[h, x]
            score += math.log10(disc(c) * c / c_h[h]) if c else math.log10(weight.get(h, 1.0) * p1(one[x]))
        out.append((i, fold(i, 10) == 0, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


def op12(rows, k=8, rounds=10):
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in rows]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(rows, at) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    inertia = Counter()
    for far, j in at:
        inertia[j] += far
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, far, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (far, j) in zip(rows, at)]


def simhash(text):
    import xxhash

    w = SPACED.findall(text.translate(LOW))
    ones = [0] * 128
    for a, b in zip(w, [*w[1:], None]):
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
        both = h << 64 | xxhash.xxh64_intdigest((1).to_bytes(4, "little"), h)
        for i in range(128):
            ones[i] += both >> i & 1
    return sum(1 << i for i in range(128) if 2 * ones[i] > len(w))


def op13(rows, every=50, radius=6):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    prints = [simhash(t) for _, t in rows]
    out = []
    for k, (i, t) in enumerate(rows):
        after = (k + 1) % len(rows)
        half = len(t) // 2
        edited = t[: len(t) - half] + rows[after][1][:half]
        e = simhash(edited)
        near = sum((prints[k] ^ p).bit_count() <= radius for p in prints) - 1 if i % every == 0 else None
        same = [1 - (prints[k] ^ x).bit_count() / 128 for x in (e, prints[after])]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{prints[k]:032x}", f"{e:032x}", *same, near))
    return out


def op8_terms(rows, sanitise):
    """Spans of every document: the base ones, and those of disclosing terms counted over whole documents."""
    rows = [(i, t or "") for i, t in rows]
    base = [sanitise.base_spans(t) for _, t in rows]
    held = [{f"{sanitise.KINDS[k]}:{v}" for _, k, _, v in b} for b in base]
    words = []
    for (_, t), b in zip(rows, base):
        found = [(m[0].translate(LOW), m.start(), m.end(), m[0]) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
        words.append([w for w in found if not any(w[1] < e and s < w[2] for s, _, e, _ in b)])
    everything = [{m.translate(LOW) for m in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)} for _, t in rows]
    first = {t: k for k, (_, t) in reversed(list(enumerate(rows)))}
    n, n_e, n_et, n_t = len(rows), Counter(), Counter(), Counter(w for e in everything for w in e)
    least = Counter()
    for k, (_, t) in enumerate(rows):
        if not held[k]:
            continue
        own = {w[0] for w in words[k]}
        if first[t] == k:
            n_e.update(held[k])
            n_et.update((e, w) for e in held[k] for w in own)
            least.update(own)
        else:
            n_t.subtract(own)
    weak, strict = set(), set()
    for (e, w), both in n_et.items():
        among, z = max(n_t[w], least[w]), sanitise.Z
        p = both / among
        bound = (p + z * z / (2 * among) - z * (p * (1 - p) / among + z * z / (4 * among * among)) ** 0.5) / (1 + z * z / among)
        if n_e[e] < n and bound >= sanitise.EVIDENCE and math.log(n * bound / n_e[e]) / math.log(n / n_e[e]) >= sanitise.THRESHOLD:
            weak.add((e, w))
            strict |= {w} if bound >= sanitise.STRICT else set()

    def kind(word):
        return "number" if word.isdigit() else "code" if re.search("[0-9]", word) else "name" if word[0].isupper() else "word"

    out = {}
    for (i, _), b, h, ws in zip(rows, base, held, words):
        terms = [(s, kind(raw), e) for w, s, e, raw in ws if w in strict or any((x, w) in weak for x in h)]
        order = sanitise.KINDS.index
        out[i] = sorted([(s, sanitise.KINDS[k], e) for s, k, e, _ in b] + terms, key=lambda x: (x[0], order(x[1])))
    return out
