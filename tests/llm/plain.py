"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def shingles(text):
    w = words(text)
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    """doc_id -> (set size, smallest id reachable)."""
    sets = {i: shingles(t) for i, t in texts.items()}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def without_repeats(texts, length=200):
    """One (bytes, removed, spans, digest) for each text of a list."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def base_spans(text):
    """The contract's patterns as they stand."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    order = ("email", "ip", "card", "phone")
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def trains(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


def language_model(texts, short_list, kept, least, discount):
    """doc_id -> (n_tokens, n_known, train_tokens, base_score, score), by the backoff recursion word by word."""
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    train = [tokens[i] for i in texts if trains(i)]
    c = collections.Counter(w for t in train for w in t)
    total, scale = sum(c.values()), sum(c.values()) + len(c) + 1
    short = {w for w, n in c.items() if n >= max(least, short_list * total)} | {None}
    c2, c3 = collections.Counter(), collections.Counter()
    for t in train:
        s = [None, *t]
        c2.update(p for p in zip(s, s[1:], strict=False) if set(p) <= short)
        c3.update(p for p in zip(s, s[1:], s[2:], strict=False) if set(p) <= short)
    enough = max(least, kept * total)
    c2, c3 = ({k: v for k, v in x.items() if v >= enough} for x in (c2, c3))

    def p1(w):
        return (c[w] + 1) / scale

    left2, free2, left3, free3 = (collections.defaultdict(float) for _ in range(4))
    for (v, w), n in c2.items():
        left2[v] += (n - discount) / c[v]
        free2[v] += p1(w)

    def p2(v, w):
        if (v, w) in c2:
            return (c2[v, w] - discount) / c[v]
        return (1 - left2[v]) / (1 - free2[v]) * p1(w) if v in left2 else p1(w)

    for (u, v, w), n in c3.items():
        left3[u, v] += (n - discount) / c2[u, v]
        free3[u, v] += p2(v, w)

    def p3(u, v, w):
        if (u, v, w) in c3:
            return (c3[u, v, w] - discount) / c2[u, v]
        return (1 - left3[u, v]) / (1 - free3[u, v]) * p2(v, w) if (u, v) in left3 else p2(v, w)

    out = {}
    for i, t in tokens.items():
        s = [object(), None, *t]
        score = sum(math.log10(p3(*x)) for x in zip(s, s[1:], s[2:], strict=False))
        out[i] = (len(t), sum(c[w] > 0 for w in t), total, sum(math.log10(p1(w)) for w in t), score)
    return out
