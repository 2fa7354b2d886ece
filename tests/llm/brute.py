"""Brute-force versions of the contracts, in plain Python."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def shards(rows, n):
    out = {}
    for i, t in rows:
        key = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:16], 16)
        raw = (t or "").encode()
        out[i] = (len(raw) + 16, zlib.crc32(raw), jump(key, n), jump(key, n + 1))
    return out


def licenses(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        hits = [(k, label) for label, p in PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        out[i] = (len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None),
                  ",".join(sorted({x for _, x in hits})))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(rows):
    out = {}
    for i, t in rows:
        got = []
        for n, (kind, pattern) in enumerate(KINDS.items()):
            for m in re.finditer(pattern, t or ""):
                d = re.sub("[^0-9]", "", m.group())
                ok = (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                      or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15)
                if ok:
                    got.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
        got.sort()
        counts = collections.Counter(x[1] for x in got)
        spans = [x[2] for x in got]
        out[i] = (*(counts[n] for n in range(4)), hashlib.sha256(",".join(spans).encode()).hexdigest(), spans)
    return out


def grams(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1))


def joined(rows, width, percent):
    sets = {i: grams(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]),
                hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def cut(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if raw[k:k + length] in seen:
                covered[k:k + length] = b"\1" * length
            seen.add(raw[k:k + length])
        kept = bytes(x for x, c in zip(raw, covered, strict=True) if not c)
        out[i] = (len(raw), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest())
    return out


def contaminated(rows, items, width):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k:k + width])].add(str(item))
    out = {}
    for i, t in rows:
        w, owners = WORD.findall(low(t)), set()
        hit = [0] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k:k + n])):
                    owners |= found
                    hit[k:k + n] = [1] * n
        out[i] = (len(w), sum(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), sum(hit) > 0)
    return out


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle(rows, fan=3):
    """rows: (doc_id, source, lang, n_chars, text), unique ids.  doc_id -> the contract's columns."""
    def leaf(r):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i:i + fan]) for i in range(0, len(out[-1]), fan)])
        return out

    def path(up, i):
        for nodes in up[:-1]:
            start = i // fan * fan
            yield nodes[start:i], nodes[i + 1:start + fan]
            i //= fan

    first = lambda v, none: (0, none) if v is None else (1, v)
    groups = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: first(r[0], 0)):
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: first(None if s is None else s.encode(), b""))
    trees = {s: levels([leaf(r) for r in groups[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order]) if order else []
    out = {}
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            damaged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4].replace("\n", ""))) if damaged else leaf(r)
            for left, right in steps:
                node = digest(*left, node, *right)
            out[r[0]] = (leaf(r), trees[s][-1][0], top[-1][0], digest(*(x for a, b in steps for x in a + b)), node, node == top[-1][0])
    return out


def damaged_words(rows, damage):
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            yield run[:h % len(run)] + run[h % len(run) + 1:] if damage and h % damage == 0 else run


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def variants(rows, least_length=6, least_count=5, ratio=5, damage=199):
    counts = collections.Counter(w for w in damaged_words(rows, damage) if len(w) >= least_length)
    counts = {w: n for w, n in counts.items() if n >= least_count}
    form, n_near = {}, {}
    for w, n in counts.items():
        close = [x for x in counts if abs(len(x) - len(w)) < 2 and near(w, x)]
        n_near[w] = len(close)
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * n else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (counts[w], n_near[w], form[w], counts.get(form[w]), root)
    return out


def edits(rows):
    """doc_id -> (n_chars, edited text, next doc_id), unique ids."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(rows):
        t, (j, after) = t or "", rows[(k + 1) % len(rows)]
        n = len(t) // 3
        out[i] = (len(t), t[:len(t) - n] + (after or "")[:n], j)
    return out


def weights(text):
    return collections.Counter(w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w)


def generalised_jaccard(a, b):
    a, b = weights(a), weights(b)
    if not a or not b:
        return float(a == b)
    return sum((a & b).values()) / sum((a | b).values())


def sample_keys(text, samples):
    """(term hash, occurrences, keys) of each word, from Spark's hash functions as xxhash has them."""
    import xxhash
    signed = lambda x: x - (x >> 63 << 64)
    part = lambda bits, shift: ((bits >> shift & 0xFFFFFFFF) + 0.5) * 2.0 ** -32
    for word, n in weights(text).items():
        term = xxhash.xxh64_intdigest(word.encode(), 42)
        keys = []
        for k in range(samples):
            first, second = (xxhash.xxh64_intdigest((term ^ (2 * k + i) * 0x9E3779B97F4A7).to_bytes(8, "little"), 42) for i in (0, 1))
            u1, u2 = part(first, 0), part(first, 32)
            r, b = -math.log(u1 * u2), math.log(u2) / math.log(u1 * u2)
            c = -math.log(part(second, 0) * part(second, 32))
            t = math.floor(math.log(n) / r + b)
            keys.append(c / (math.exp(r * (t - b)) * math.exp(r)))  # as the method has it
        yield signed(term), n, keys
