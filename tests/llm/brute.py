"""Brute-force versions of operators, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def substring(docs, window=20):
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                gone.update(range(i, i + window))
            seen.add(g)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, k=4):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def jaccard_components(docs, percent=85, k=4):
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), find(d)) for d in sets)


def jaccard_links(docs, percent=85, k=4):
    """Other distinct sets that reach the threshold, by document."""
    sets = {d: shingles(t, k) for d, t in docs}
    distinct = set(sets.values()) - {frozenset()}
    near = lambda x, y: 100 * len(x & y) >= percent * len(x | y)
    return {d: sum(x != y and near(x, y) for y in distinct) if x else 0 for d, x in sets.items()}


def quality(text):
    w = words(text)
    dup, seen = 0, set()
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def source_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """(target words, place in weights) of each source.

    Sources in code point order, null last, take the weights in turn. All share
    ``share`` times the total by weight; a target stops at ``most`` times its
    source's size and the excess is shared again until no target is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = {}
    left = share * sum(sizes.values())
    free = list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not full:
            target |= {s: unit * weight[s] for s in free}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            free.remove(s)
    return {s: (float(target[s]), i % len(weights)) for i, s in enumerate(order)}


def rendezvous(key, n_shards, seed):
    """The shard of the highest draw: XXH64 of key, shard and seed, one after the other, from Spark's seed 42."""
    import struct

    import xxhash

    def draw(shard):
        h = 42
        for form, value in (("<q", key), ("<i", shard), ("<i", seed)):
            if value is not None:
                h = xxhash.xxh64_intdigest(struct.pack(form, value), seed=h)
        return h - (1 << 64) if h >> 63 else h

    return max(range(n_shards), key=lambda s: (draw(s), s))


def grey_jpeg(data):
    """(width, height, rows of pixels) of a grey baseline JPEG, by the standard's own formulas."""
    import math

    quant, huff, at, size, scan = {}, {}, 2, None, None
    while True:
        assert data[at] == 0xFF
        marker, length = data[at + 1], data[at + 2] << 8 | data[at + 3]
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            quant[body[0]] = list(body[1:65])
        elif marker == 0xC4:
            while body:
                counts, values, code = body[1:17], body[17:], 0
                table, k = {}, 0
                for bits, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[bits, code] = values[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                huff[body[0]], body = table, body[17 + k :]
        elif marker == 0xC0:
            assert body[0] == 8 and body[5] == 1
            size = body[1] << 8 | body[2], body[3] << 8 | body[4]
        elif marker == 0xDA:
            scan = data[at:]
            break
    bits = []
    i = 0
    while not (scan[i] == 0xFF and scan[i + 1] != 0):
        bits += [scan[i] >> s & 1 for s in range(7, -1, -1)]
        i += 2 if scan[i] == 0xFF else 1
    assert scan[i + 1] == 0xD9
    pos = 0

    def take(n):
        nonlocal pos
        value = 0
        for b in bits[pos : pos + n]:
            value = value << 1 | b
        pos += n
        return value

    def symbol(table):
        code = 0
        for n in range(1, 17):
            code = code << 1 | take(1)
            if (n, code) in table:
                return table[n, code]
        raise AssertionError("no such code")

    def number(n):
        value = take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1

    zigzag = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
    height, width = size
    pixels = [[0] * width for _ in range(height)]
    dc = 0
    scale = lambda u: math.sqrt(0.5) if u == 0 else 1.0
    for by in range(0, height, 8):
        for bx in range(0, width, 8):
            block = [0] * 64
            dc += number(symbol(huff[0x00]))
            block[0] = dc * quant[0][0]
            k = 1
            while k < 64:
                rs = symbol(huff[0x10])
                if rs == 0:
                    break
                k += rs >> 4
                block[zigzag[k]] = number(rs & 15) * quant[0][k]
                k += 1
            only_dc = not any(block[1:])
            for y in range(8):
                for x in range(8):
                    if only_dc:
                        value = block[0] / 8
                    else:
                        value = sum(scale(u) * scale(v) * block[8 * v + u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for u in range(8) for v in range(8)) / 4
                    pixels[by + y][bx + x] = min(255, max(0, round(value + 128)))
    return width, height, pixels


def riff(data):
    """(name, body) of the chunks of a RIFF file, lists opened in place."""
    out = []

    def walk(at, end):
        while at < end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            if name in (b"RIFF", b"LIST"):
                walk(at + 12, at + 8 + size)
            else:
                out.append((name, data[at + 8 : at + 8 + size]))
            at += 8 + size + size % 2

    walk(0, len(data))
    return out
