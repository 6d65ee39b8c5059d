"""Plain Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED, ALNUM = re.compile("[^\x20\x09-\x0D]+"), re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return (text or "").translate(FOLD)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def repeated_spans(docs, length=200):
    seen = Counter()
    raws = [(d, (t or "").encode()) for d, t in docs]
    for _, raw in raws:
        seen.update(raw[i:i + length] for i in range(len(raw) - length + 1))
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), sum(gone), spans, sha(kept)))
    return out


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def pii(text):
    text, spans = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def language_model_base(docs):
    tokens = {i: [*SPACED.findall(fold(t)), None] for i, (_, t) in enumerate(docs)}
    count = Counter(w for i, (d, _) in enumerate(docs) if crc(d) % 7 != 2 for w in tokens[i])
    n, v = sum(count.values()), len(count)
    return [(d, crc(d) % 7 == 2, len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n,
             sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[i])) for i, (d, _) in enumerate(docs)]


def decontaminate(docs, items, window=10):
    patterns = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(fold(text))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[i:i + n])].add(item)
    lengths = {len(p) for p in patterns}
    out = []
    for d, text in docs:
        w = ALNUM.findall(fold(text))
        hit, found = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i:i + n])) in patterns:
                    found |= patterns[p]
                    hit[i:i + n] = [True] * n
        names = sorted(str(x) for x in found if x is not None)
        out.append((d, len(w), sum(hit), len(names), sha(",".join(names)), any(hit)))
    return out


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def licences(text):
    w = ALNUM.findall(fold(text))
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if tuple(w[i:i + len(p)]) == p)
    return (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))


def mixing_targets(docs):
    """(source, text) rows to {source: (size, target)}."""
    size = Counter()
    for source, text in docs:
        size[source] += len(SPACED.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left, free = left - sum(2 * size[s] for s in over), free - over
    return {s: (size[s], target[s]) for s in order}


def shingles(text):
    w = SPACED.findall(fold(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def similar(docs):
    sets = [shingles(t) for _, t in docs]
    holders, links = defaultdict(list), []
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x])
        links += [(j, i) for j, n in shared.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
        for x in s:
            holders[x].append(i)
    label = classes(range(len(docs)), links)
    ids = defaultdict(list)
    for i, c in label.items():
        if docs[i][0] is not None:
            ids[c].append(docs[i][0])
    return [(d, len(sets[i]), min(ids[label[i]], default=None) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def remainder(a, b):
    """The remainder with the sign of ``a``, as in SQL."""
    return abs(a) % b * (1 if a >= 0 else -1)


def conversation_trie(rows):
    """(conv_id, turn, role, text) rows to one tuple for each node."""
    def turn_id(role, text):
        role, text = role or "", text or ""
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), len(text.encode())

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, turn_id(role, text)))
    own = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    built = {c: tuple(own.get(c - remainder(c, 5), [])[:crc(c) % 9] + ts[crc(c) % 9:]) for c, ts in own.items()}
    members, children, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * (path[-1][1] if path else 0) + sum(saved[k] for k in children[path])
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
             sha(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)))) for p, m in members.items()]


def exact_copies(docs):
    """(doc_id, text) rows, in input order, to (doc_id, keep_id, group_size, kept, text_sha256)."""
    bodies = [re.sub("[\x20\x09-\x0D]+", " ", t or "") for _, t in docs]
    groups = defaultdict(list)
    for i, body in enumerate(bodies):
        groups[body].append((docs[i][0] is None, docs[i][0], i))
    out = []
    for i, body in enumerate(bodies):
        first = min(groups[body], key=lambda x: (x[0], x[1] or 0, x[2]))
        out.append((docs[i][0], first[1], len(groups[body]), first[2] == i, sha(body)))
    return out
